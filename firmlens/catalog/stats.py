"""Queries: descriptive statistics, profiles, personas, gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.catalog.base import (
    LABELLED, MEGA, company, each, labelled, mega_labelled, on_company, query, r, rounded,
)
from firmlens.catalog.features import ENGINEERED_CTES, engineered
from firmlens.functions import bands
from firmlens.operators import features as ft
from firmlens.operators import profile_stats as ps
from firmlens.operators import segments as sg
from firmlens.operators import shapes as sh

COLS = ["revenue", "market_value", "it_spend", "employees", "sites", "servers"]


def q(c, p):
    return f"quantile_cont(CAST({c} AS DOUBLE), {p})"


def moments_sql(table, by=""):
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return each(COLS, "SELECT " + key + "'{c}' AS feature, count({c}) AS n, round(avg({c}),2) AS mean, round(stddev_samp({c}),2) AS std, "
                "round(CAST(min({c}) AS DOUBLE),6) AS min, round(CAST(max({c}) AS DOUBLE),6) AS max, "
                "round(quantile_cont(CAST({c} AS DOUBLE),0.25),6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE),0.5),6) AS q50, "
                "round(quantile_cont(CAST({c} AS DOUBLE),0.75),6) AS q75 FROM " + table + group)


def _describe(df):
    return df.withColumns({c: r(c, 2) for c in ("mean", "std")} | {c: r(c) for c in ("min", "max", "q25", "q50", "q75")})


@query("describe_table", "A1", on_company(moments_sql("company")))
def _(spark, sf_dir):
    return _describe(ps.describe(company(spark, sf_dir), COLS))


@query("describe_by_cluster", "A1", on_company(moments_sql("labelled", "cluster"), LABELLED))
def _(spark, sf_dir):
    return _describe(ps.describe(labelled(spark, sf_dir), COLS, "cluster"))


MISSABLE = ["country", "revenue", "it_budget", "employees", "ownership_type", "nace_desc", "sites"]


@query("missing_profile", "A2", on_company(each(
    MISSABLE, "SELECT '{c}' AS feature, count(*)-count({c}) AS missing, round(100.0*(count(*)-count({c}))/count(*),6) AS missing_pct FROM company")))
def _(spark, sf_dir):
    return rounded(ps.missing_profile(company(spark, sf_dir), MISSABLE))


@query("value_counts", "A3", on_company(
    "SELECT country AS value, count(*) AS n FROM company WHERE country IS NOT NULL GROUP BY country"))
def _(spark, sf_dir):
    return ps.value_counts(company(spark, sf_dir), "country")


@query("value_share_by_cluster", "A3", on_company(
    "SELECT cluster, ownership_type AS value, count(*) AS n, round(CAST(count(*) AS DOUBLE)/sum(count(*)) OVER (PARTITION BY cluster),6) "
    "AS share FROM labelled WHERE ownership_type IS NOT NULL GROUP BY cluster, ownership_type", LABELLED))
def _(spark, sf_dir):
    return rounded(ps.value_counts(labelled(spark, sf_dir), "ownership_type", "cluster", normalize=True))


CATS = ["entity_type", "ownership_type", "industry", "country"]


@query("modes_by_cluster", "A4", on_company(
    "SELECT cluster, feature, value AS mode FROM (SELECT *, row_number() OVER (PARTITION BY cluster, feature ORDER BY n DESC, value) AS k "
    "FROM (" + each(CATS, "SELECT cluster, '{c}' AS feature, {c} AS value, count(*) AS n FROM labelled WHERE {c} IS NOT NULL GROUP BY cluster, {c}")
    + ") a) b WHERE k = 1", LABELLED))
def _(spark, sf_dir):
    return ps.modes(labelled(spark, sf_dir), CATS, "cluster")


@query("cardinality", "A5", on_company(each(
    [*CATS, "sic_desc"], "SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM company")))
def _(spark, sf_dir):
    return ps.cardinality(company(spark, sf_dir), [*CATS, "sic_desc"])


METRIC_SQL = {
    "revenue_per_employee": "revenue/nullif(employees,0)", "market_value_per_employee": "market_value/nullif(employees,0)",
    "it_spend_ratio": "it_spend/nullif(revenue,0)", "employees_per_site": "CAST(employees AS DOUBLE)/nullif(sites,0)",
    "technology_density_index": "CASE WHEN servers<>0 OR storage<>0 THEN CAST(servers+storage AS DOUBLE)/nullif(employees,0) END",
    "company_age": "CASE WHEN 2026-year_founded BETWEEN 0 AND 500 THEN 2026-year_founded END",
    "geographic_dispersion": "(country IS NOT NULL)::INT+(region IS NOT NULL)::INT",
}
DERIVED = "d AS (SELECT company_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in METRIC_SQL.items()) + " FROM company)"


@query("metric_summary", "A6", on_company(each(
    list(METRIC_SQL), "SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}),4) AS mean, round(min({c}),4) AS min, "
    "round(max({c}),4) AS max, round(quantile_cont({c},0.5),4) AS median FROM d HAVING count({c}) > 0"), DERIVED))
def _(spark, sf_dir):
    df = ft.derived_metrics(company(spark, sf_dir), 2026)
    return rounded(ps.metric_summary(df, ft.DERIVED_METRICS), 4)


@query("impute", "A7", on_company(
    "SELECT company_id, coalesce(revenue, mr) AS revenue, CAST(coalesce(employees, me) AS DOUBLE) AS employees, "
    "coalesce(ownership_type, mo) AS ownership_type, coalesce(country, mc) AS country FROM company CROSS JOIN "
    "(SELECT quantile_cont(revenue,0.5) AS mr, quantile_cont(CAST(employees AS DOUBLE),0.5) AS me FROM company) m CROSS JOIN "
    "(SELECT ownership_type AS mo FROM company WHERE ownership_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) o CROSS JOIN "
    "(SELECT country AS mc FROM company WHERE country IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) c"))
def _(spark, sf_dir):
    return ps.impute(company(spark, sf_dir), ["revenue", "employees"], ["ownership_type", "country"]).select(
        "company_id", "revenue", "employees", "ownership_type", "country")


FENCES = "fence AS (SELECT " + ", ".join(
    f"{q(c, 0.25)} AS a_{c}, {q(c, 0.75)} AS b_{c}" for c in COLS) + " FROM company)"


def lo(c):
    return f"(a_{c}-1.5*(b_{c}-a_{c}))"


def hi(c):
    return f"(b_{c}+1.5*(b_{c}-a_{c}))"


@query("cap_outliers", "A8", on_company(
    "SELECT company_id, " + ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN round(greatest(least(CAST({c} AS DOUBLE),{hi(c)}),{lo(c)}),6) END AS {c}" for c in COLS)
    + " FROM company CROSS JOIN fence", FENCES))
def _(spark, sf_dir):
    df, _ = ps.handle_outliers_iqr(company(spark, sf_dir), COLS)
    return df.select("company_id", *[r(c).alias(c) for c in COLS])


@query("remove_outliers", "A8,U1", on_company(
    "SELECT company_id FROM company CROSS JOIN fence WHERE NOT (" + " OR ".join(
        f"coalesce({c} < {lo(c)} OR {c} > {hi(c)}, false)" for c in COLS) + ")", FENCES))
def _(spark, sf_dir):
    df, _ = ps.handle_outliers_iqr(company(spark, sf_dir), COLS, method="remove")
    return df.select("company_id")


@query("outlier_report", "A8", on_company(each(
    COLS, "SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} < (a_{c}-1.5*(b_{c}-a_{c})) OR {c} > (b_{c}+1.5*(b_{c}-a_{c}))) AS n_out, "
    "round(100.0*count(*) FILTER (WHERE {c} < (a_{c}-1.5*(b_{c}-a_{c})) OR {c} > (b_{c}+1.5*(b_{c}-a_{c})))/count(*),4) AS pct_out, "
    "round(any_value(a_{c}-1.5*(b_{c}-a_{c})),3) AS lower, round(any_value(b_{c}+1.5*(b_{c}-a_{c})),3) AS upper "
    "FROM company CROSS JOIN fence"), FENCES))
def _(spark, sf_dir):
    _, report = ps.handle_outliers_iqr(company(spark, sf_dir), COLS)
    return report.select("feature", "n_out", r("pct_out", 4).alias("pct_out"), r("lower", 3).alias("lower"), r("upper", 3).alias("upper"))


@query("iqr_outlier_report", "A9", on_company("SELECT * FROM (" + each(
    COLS, "SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} < (a_{c}-1.5*(b_{c}-a_{c})) OR {c} > (b_{c}+1.5*(b_{c}-a_{c}))) AS n_out, "
    "round(100.0*count(*) FILTER (WHERE {c} < (a_{c}-1.5*(b_{c}-a_{c})) OR {c} > (b_{c}+1.5*(b_{c}-a_{c})))/count(*),4) AS pct_out "
    "FROM company CROSS JOIN fence") + ") z WHERE n_out > 0", FENCES))
def _(spark, sf_dir):
    return rounded(ps.iqr_outlier_report(company(spark, sf_dir), COLS), 4)


@query("correlation_matrix", "A10", on_company(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, " + ("CAST(1 AS DOUBLE)" if a == b else f"round(corr({a},{b}),6)")
    + " AS corr FROM company" + (" GROUP BY 1, 2" if a == b else "")
    for a in COLS for b in COLS)))
def _(spark, sf_dir):
    return rounded(ps.correlation_matrix(company(spark, sf_dir), COLS))


# --- segments ------------------------------------------------------------------------

@query("cluster_sizes", "A11", on_company(
    "SELECT cluster, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (),6) AS pct FROM mega GROUP BY cluster", MEGA))
def _(spark, sf_dir):
    return rounded(sg.cluster_sizes(mega_labelled(spark, sf_dir)))


@query("compare_clusters", "A12", on_company(each(
    COLS, "SELECT cluster, '{c}' AS feature, round(avg({c}),2) AS mean, round(stddev_samp({c}),2) AS std FROM labelled GROUP BY cluster"), LABELLED))
def _(spark, sf_dir):
    return rounded(sg.compare_clusters(labelled(spark, sf_dir), COLS), 2)


@query("compare_one_feature", "A12", on_company(
    "SELECT cluster, round(avg(revenue),2) AS mean, round(stddev_samp(revenue),2) AS std, round(min(revenue),2) AS min, "
    "round(max(revenue),2) AS max, count(revenue) AS n FROM labelled GROUP BY cluster", LABELLED))
def _(spark, sf_dir):
    return rounded(sg.compare_clusters(labelled(spark, sf_dir), COLS, "revenue"), 2)


@query("analyze_clusters", "A13", on_company(
    "SELECT cluster, 'size' AS feature, 'n' AS stat, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM labelled GROUP BY cluster "
    "UNION ALL SELECT cluster, 'size', 'pct', round(100.0*count(*)/sum(count(*)) OVER (),2), NULL FROM labelled GROUP BY cluster UNION ALL "
    + each(["sites", "servers"], " UNION ALL ".join(
        "SELECT cluster, '{c}', '" + s + "', round(CAST(" + e + " AS DOUBLE),2), NULL FROM labelled GROUP BY cluster" for s, e in {
            "n": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
            "q25": "quantile_cont(CAST({c} AS DOUBLE),0.25)", "q50": "quantile_cont(CAST({c} AS DOUBLE),0.5)",
            "q75": "quantile_cont(CAST({c} AS DOUBLE),0.75)"}.items()))
    + " UNION ALL SELECT cluster, 'entity_type', 'share', round(CAST(count(*) AS DOUBLE)/sum(count(*)) OVER (PARTITION BY cluster),2), entity_type "
    "FROM labelled GROUP BY cluster, entity_type UNION ALL SELECT cluster, 'entity_type', 'mode', NULL, entity_type FROM (SELECT cluster, entity_type, "
    "row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, entity_type) AS k FROM labelled GROUP BY cluster, entity_type) z WHERE k = 1", LABELLED))
def _(spark, sf_dir):
    return rounded(sg.analyze_clusters(labelled(spark, sf_dir), ["sites", "servers"], ["entity_type"]), 2)


@query("cluster_vs_rest", "A14", on_company("SELECT * FROM (" + each(
    [*COLS, "laptops", "routers"],
    "SELECT cluster, '{c}' AS feature, round(m,3) AS cluster_mean, round(o,3) AS other_mean, round((m-o)/abs(o)*100,4) AS difference_pct FROM "
    "(SELECT a.cluster, (SELECT avg({c}) FROM labelled b WHERE b.cluster = a.cluster) AS m, (SELECT avg({c}) FROM labelled b WHERE b.cluster <> a.cluster) AS o "
    "FROM (SELECT DISTINCT cluster FROM labelled) a) x WHERE abs(o) > 1e-10 AND abs(m-o) > 0.1*abs(o)") + ") z", LABELLED))
def _(spark, sf_dir):
    out = sg.cluster_vs_rest(labelled(spark, sf_dir), [*COLS, "laptops", "routers"])
    return out.withColumns({"cluster_mean": r("cluster_mean", 3), "other_mean": r("other_mean", 3), "difference_pct": r("difference_pct", 4)})


@query("cluster_profiles", "A15", on_company(each(
    COLS, "SELECT cluster, '{c}' AS feature, round(avg({c}),2) AS mean, round(quantile_cont(CAST({c} AS DOUBLE),0.5),2) AS median, "
    "CAST(NULL AS VARCHAR) AS mode, count(*) AS size FROM labelled GROUP BY cluster")
    + " UNION ALL SELECT cluster, 'industry', NULL, NULL, industry, size FROM (SELECT cluster, industry, row_number() OVER "
    "(PARTITION BY cluster ORDER BY count(*) DESC, industry) AS k, sum(count(*)) OVER (PARTITION BY cluster)::BIGINT AS size FROM labelled "
    "GROUP BY cluster, industry) z WHERE k = 1", LABELLED))
def _(spark, sf_dir):
    return rounded(sg.cluster_profiles(labelled(spark, sf_dir), COLS, ["industry"]), 2)


def _scaled(stat, expr):
    return each(COLS, "SELECT cluster, '{c}' AS feature, round(v,2) AS value, round(" + expr + ",6) AS scaled FROM (SELECT cluster, "
                + stat + " AS v FROM labelled GROUP BY cluster) z")


@query("normalised_means", "A16", on_company(_scaled(
    "avg({c})", "(v-min(v) OVER ())/nullif(max(v) OVER ()-min(v) OVER (),0)"), LABELLED))
def _(spark, sf_dir):
    out = sg.normalised_profile(labelled(spark, sf_dir), COLS)
    return out.withColumns({"value": r("value", 2), "scaled": r("scaled")})


@query("normalised_medians", "A16", on_company(_scaled(
    "quantile_cont(CAST({c} AS DOUBLE),0.5)", "v/nullif(max(v) OVER (),0)"), LABELLED))
def _(spark, sf_dir):
    out = sg.normalised_profile(labelled(spark, sf_dir), COLS, "median", "max")
    return out.withColumns({"value": r("value", 2), "scaled": r("scaled")})


FEAT_LABELLED = "fl AS (SELECT *, CAST(company_id % 4 AS INT) AS cluster FROM feat)"
PERSONA = (
    "pm AS (SELECT cluster, count(*) AS n, 100.0*count(*)/sum(count(*)) OVER () AS pct, quantile_cont(employees,0.5) AS me, "
    "quantile_cont(it_spend_ratio,0.5) AS mi, quantile_cont(company_age,0.5) AS ma, quantile_cont(revenue_per_emp,0.5) AS mp, "
    "quantile_cont(technology_density,0.5) AS mt, avg(it_spend_ratio_industry_zscore) AS z FROM fl GROUP BY cluster)",
    "po AS (SELECT quantile_cont(revenue_per_emp,0.25) AS p25, quantile_cont(revenue_per_emp,0.5) AS op, quantile_cont(it_spend_ratio,0.5) AS oi, "
    "quantile_cont(technology_density,0.5) AS ot FROM fl)",
    "pn AS (SELECT cluster, 'Tier1_Cluster_' || cluster || ': ' || CASE WHEN me < 50 THEN 'Micro' WHEN me < 250 THEN 'Small' WHEN me < 1000 THEN 'Medium' ELSE 'Enterprise' END "
    "|| ' ' || CASE WHEN mi > 0.05 THEN 'Tech-Forward' WHEN mi > 0.02 THEN 'Digitally Moderate' ELSE 'Tech-Conservative' END || ' ' || "
    "CASE WHEN ma < 5 THEN 'Startup' WHEN ma < 15 THEN 'Growth Stage' ELSE 'Established' END AS persona FROM pm)",
)


def feat_labelled(spark, sf_dir):
    return engineered(spark, sf_dir).withColumn("cluster", (F.col("company_id") % 4).cast("int"))


PERSONA_FEATURES = ["employees", "it_spend_ratio", "revenue_per_emp"]


@query("build_personas", "A18,F34", on_company(
    "SELECT cluster, n, round(pct,6) AS pct, persona, round(mp,4) AS revenue_per_emp_median, round((mp-op)/op*100,4) AS revenue_per_emp_vs_market, "
    "round((mi-oi)/oi*100,4) AS it_spend_ratio_vs_market, round((mt-ot)/ot*100,4) AS technology_density_vs_market, round(z,6) AS mean_z, "
    "nullif(concat_ws('; ', CASE WHEN z < -0.5 THEN 'Under-investing in IT vs peers' END, CASE WHEN mp < p25 THEN 'Low productivity per employee' END),'') AS risk, "
    "CASE WHEN z < -0.5 THEN 'Potential for digital transformation services' WHEN z > 0.5 THEN 'Early adopter segment - premium pricing potential' END AS opportunity "
    "FROM pm JOIN pn USING (cluster) CROSS JOIN po", *ENGINEERED_CTES, FEAT_LABELLED, *PERSONA))
def _(spark, sf_dir):
    out = sg.build_personas(feat_labelled(spark, sf_dir), PERSONA_FEATURES)
    return out.select("cluster", "n", r("pct").alias("pct"), "persona", r("revenue_per_emp_median", 4).alias("revenue_per_emp_median"),
                      *[r(f"{m}_vs_market", 4).alias(f"{m}_vs_market") for m in ("revenue_per_emp", "it_spend_ratio", "technology_density")],
                      r("mean_z").alias("mean_z"), "risk", "opportunity")


@query("persona_summary", "A17,J3", on_company(
    "SELECT persona, count(employees) AS employees_count, round(avg(employees),2) AS employees_mean, round(quantile_cont(employees,0.5),2) AS employees_median, "
    "round(quantile_cont(revenue,0.5),2) AS revenue_median, round(quantile_cont(it_spend,0.5),2) AS it_spend_median, "
    "round(quantile_cont(it_spend_ratio,0.5),2) AS it_spend_ratio_median FROM fl JOIN pn USING (cluster) GROUP BY persona",
    *ENGINEERED_CTES, FEAT_LABELLED, *PERSONA))
def _(spark, sf_dir):
    df = feat_labelled(spark, sf_dir)
    return sg.persona_summary(sg.attach_personas(df, sg.build_personas(df, PERSONA_FEATURES)))


@query("attach_personas", "J3", on_company(
    "SELECT company_id, CASE WHEN cluster IN (0,1) THEN persona ELSE 'Strategic Outlier' END AS persona FROM fl JOIN pn USING (cluster)",
    *ENGINEERED_CTES, FEAT_LABELLED, *PERSONA))
def _(spark, sf_dir):
    df = feat_labelled(spark, sf_dir)
    personas = sg.build_personas(df, PERSONA_FEATURES)
    return sg.attach_personas(df, sg.rows_in_clusters(personas, [0, 1])).select("company_id", "persona")


GAP = (
    "SELECT segment, gap, metric, n, round(m,4) AS group_median, round(o,4) AS overall_median, round(100*(m-o)/o,4) AS deviation_pct, "
    "round(CASE WHEN metric = 'it_spend' AND m < o THEN (o-m)*n END,2) AS opportunity_value FROM ("
    "SELECT {s} AS segment, 'IT Investment Gap' AS gap, 'it_spend' AS metric, count(*) AS n, quantile_cont(it_spend,0.5) AS m, "
    "(SELECT quantile_cont(it_spend,0.5) FROM {t}) AS o, 25 AS lim FROM {t} GROUP BY {g} UNION ALL "
    "SELECT {s}, 'Efficiency Gap', 'revenue_per_emp', count(*), quantile_cont(revenue_per_emp,0.5), "
    "(SELECT quantile_cont(revenue_per_emp,0.5) FROM {t}), 30 FROM {t} GROUP BY {g}) z WHERE o > 0 AND abs(100*(m-o)/o) > lim"
)


def _gap(df):
    return df.withColumns({c: r(c, 4) for c in ("group_median", "overall_median", "deviation_pct")} | {"opportunity_value": r("opportunity_value", 2)})


VALID = ("v AS (SELECT *, revenue/employees AS revenue_per_emp, CAST(CASE WHEN employees < 10 THEN 'Micro' WHEN employees < 50 THEN 'Small' "
         "WHEN employees < 250 THEN 'Mid-Market' WHEN employees < 1000 THEN 'Upper Mid-Market' ELSE 'Enterprise' END AS VARCHAR) AS scale "
         "FROM company WHERE employees <> 0 AND market_value <> 0 AND revenue <> 0)")


@query("it_gap_by_employee_scale", "A19,P8,F20", on_company(GAP.format(s="scale", g="scale", t="v"), VALID))
def _(spark, sf_dir):
    from firmlens.functions.clean import filter_valid
    from firmlens.functions.ratios import revenue_per_employee

    df = filter_valid(company(spark, sf_dir)).withColumns({
        "revenue_per_emp": revenue_per_employee(), "scale": bands.employee_scale(F.col("employees"))})
    return _gap(sg.gap_analysis(df, "scale"))


@query("gap_analysis_by_subcluster", "A19,F35", on_company(
    GAP.format(s="'Tier2_Subcluster_0.' || sub", g="sub", t="s"),
    *ENGINEERED_CTES, "s AS (SELECT *, CAST(company_id % 5 AS INT) AS sub FROM feat)"))
def _(spark, sf_dir):
    df = engineered(spark, sf_dir).withColumn("sub", (F.col("company_id") % 5).cast("int"))
    return _gap(sg.gap_analysis(df, "sub", mega=0))


@query("mega_clusters", "A20", on_company(
    "SELECT cluster, n, round(pct,6) AS pct FROM (SELECT cluster, count(*) AS n, 100.0*count(*)/sum(count(*)) OVER () AS pct FROM mega GROUP BY cluster) z "
    "WHERE pct >= 40", MEGA))
def _(spark, sf_dir):
    return rounded(sg.mega_clusters(mega_labelled(spark, sf_dir)))


@query("small_cluster_warning", "A22", on_company(
    "SELECT cluster, n, round(pct,6) AS pct FROM (SELECT cluster, count(*) AS n, 100.0*count(*)/sum(count(*)) OVER () AS pct, sum(count(*)) OVER () AS t "
    "FROM mega GROUP BY cluster) z WHERE n < greatest(10, 0.01*t)", MEGA))
def _(spark, sf_dir):
    return rounded(sg.small_cluster_warning(mega_labelled(spark, sf_dir)))


@query("balance_report", "A23", on_company(
    "SELECT count(*) AS k, round(max(pct),6) AS largest_pct, min(n) AS smallest, max(n) AS largest, CASE WHEN max(pct) < 40 THEN 1 ELSE 0 END AS balanced FROM "
    "(SELECT count(*) AS n, 100.0*count(*)/sum(count(*)) OVER () AS pct FROM mega GROUP BY cluster) z", MEGA))
def _(spark, sf_dir):
    return rounded(sg.balance_report(mega_labelled(spark, sf_dir)))


@query("cluster_status", "F37", on_company(
    "SELECT cluster, n, round(pct,6) AS pct, CASE WHEN pct >= 40 THEN 'mega' WHEN pct < 0.5 THEN 'minor' ELSE 'ok' END AS status FROM "
    "(SELECT cluster, count(*) AS n, 100.0*count(*)/sum(count(*)) OVER () AS pct FROM mega GROUP BY cluster) z", MEGA))
def _(spark, sf_dir):
    return rounded(sg.cluster_status(mega_labelled(spark, sf_dir)))


@query("reference_percentiles", "A24", on_company(
    "SELECT round(quantile_cont(revenue_per_emp,0.99),4) AS p99_revenue_per_emp, round(quantile_cont(company_age,0.1),4) AS p10_age FROM feat", *ENGINEERED_CTES))
def _(spark, sf_dir):
    limits = sg.reference_percentiles(engineered(spark, sf_dir))
    return rounded(spark.createDataFrame([tuple(limits.values())], ", ".join(f"{k} double" for k in limits)), 4)


@query("subcluster_summary", "A25,F35", on_company(
    "SELECT sub, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (),4) AS pct, round(quantile_cont(revenue,0.5),4) AS median_revenue, "
    "round(quantile_cont(it_spend,0.5),4) AS median_it_spend, round(quantile_cont(CAST(employees AS DOUBLE),0.5),4) AS median_employees, "
    "'Tier2_Subcluster_0.' || sub AS name FROM (SELECT *, CAST(company_id % 5 AS INT) AS sub FROM mega WHERE cluster = 0) z GROUP BY sub", MEGA))
def _(spark, sf_dir):
    df = sg.rows_in_clusters(mega_labelled(spark, sf_dir), [0]).withColumn("sub", (F.col("company_id") % 5).cast("int"))
    return rounded(sg.subcluster_summary(df, 0), 4)


PLANE = "plane AS (SELECT company_id, CAST(company_id % 4 AS INT) AS cluster, ln(1+coalesce(revenue,0)) AS pc1, ln(1+market_value) AS pc2 FROM company)"


@query("projection_cluster_stats", "A26", on_company(
    "SELECT cluster, n, round(100.0*n/sum(n) OVER (),6) AS pct, round(cx,6) AS cx, round(cy,6) AS cy, round(md,6) AS mean_dist, round(x0,6) AS x_min, "
    "round(x1,6) AS x_max, round(y0,6) AS y_min, round(y1,6) AS y_max FROM (SELECT p.cluster, count(*) AS n, any_value(cx) AS cx, any_value(cy) AS cy, "
    "avg(sqrt((pc1-cx)*(pc1-cx)+(pc2-cy)*(pc2-cy))) AS md, min(pc1) AS x0, max(pc1) AS x1, min(pc2) AS y0, max(pc2) AS y1 FROM plane p JOIN "
    "(SELECT cluster, avg(pc1) AS cx, avg(pc2) AS cy FROM plane GROUP BY cluster) c USING (cluster) GROUP BY p.cluster) z", PLANE))
def _(spark, sf_dir):
    from firmlens.functions.ratios import log1p_of

    df = labelled(spark, sf_dir).select("cluster", log1p_of("revenue").alias("pc1"), log1p_of("market_value").alias("pc2"))
    return rounded(sg.projection_cluster_stats(df))


@query("distribution_stats", "A27,F31", on_company(
    "SELECT cluster, 'revenue' AS feature, count(x) AS n, round(avg(x),4) AS mean, round(stddev_samp(x),4) AS std, round(min(x),6) AS min, round(max(x),6) AS max, "
    "round(quantile_cont(x,0.25),6) AS q25, round(quantile_cont(x,0.5),6) AS q50, round(quantile_cont(x,0.75),6) AS q75, any_value(wide) AS log_scale FROM "
    "(SELECT cluster, wide, CASE WHEN wide = 1 THEN log10(revenue+1) ELSE revenue END AS x FROM labelled CROSS JOIN (SELECT CASE WHEN max(revenue)/"
    "(min(revenue) FILTER (WHERE revenue > 0)+1e-10) > 100 THEN 1 ELSE 0 END AS wide FROM labelled) w) z GROUP BY cluster", LABELLED))
def _(spark, sf_dir):
    out = sg.distribution_stats(labelled(spark, sf_dir), "revenue")
    return rounded(out, skip=("mean", "std")).withColumns({c: r(c, 4) for c in ("mean", "std")})


# Revenue is on a log scale in these tables if it spans two decades, as in distribution_stats.
SHAPE = ("wide AS (SELECT CASE WHEN max(revenue)/(min(revenue) FILTER (WHERE revenue > 0)+1e-10) > 100 THEN 1 ELSE 0 END AS wide FROM labelled)",
         "v AS (SELECT cluster, CASE WHEN wide = 1 THEN log10(revenue+1) ELSE revenue END AS x FROM labelled CROSS JOIN wide WHERE revenue IS NOT NULL)",
         "s AS (SELECT cluster, count(*) AS n, min(x) AS low, max(x) AS high, stddev_samp(x)*pow(count(*), -0.2) AS h FROM v GROUP BY cluster)")


@query("violin_densities", "A27", on_company(
    "SELECT s.cluster, 'revenue' AS feature, CAST(i AS INT) AS i, round(any_value(low+(high-low)*i/99),6) AS x, "
    "round(sum(w*exp(-0.5*pow((low+(high-low)*i/99-(low+(high-low)*cell/399))/h, 2)))/(any_value(n)*any_value(h)*sqrt(2*pi())),6) AS density "
    "FROM s JOIN binned USING (cluster) CROSS JOIN range(100) g(i) GROUP BY s.cluster, i", LABELLED, *SHAPE,
    "placed AS (SELECT cluster, (x-low)/(high-low)*399 AS p FROM v JOIN s USING (cluster))",
    "binned AS (SELECT cluster, cell, sum(w) AS w FROM (SELECT cluster, floor(p) AS cell, 1-(p-floor(p)) AS w FROM placed UNION ALL "
    "SELECT cluster, floor(p)+1, p-floor(p) FROM placed) z GROUP BY cluster, cell)"))
def _(spark, sf_dir):
    return rounded(sh.violin_densities(labelled(spark, sf_dir), ["revenue"]))


@query("box_whiskers", "A27", on_company(
    "SELECT cluster, 'revenue' AS feature, count(*) AS n, round(avg(x),4) AS mean, round(any_value(a),6) AS q25, round(any_value(m),6) AS q50, round(any_value(b),6) AS q75, "
    "round(least(min(x) FILTER (WHERE x BETWEEN a-1.5*(b-a) AND b+1.5*(b-a)), any_value(a)),6) AS whisker_low, "
    "round(greatest(max(x) FILTER (WHERE x BETWEEN a-1.5*(b-a) AND b+1.5*(b-a)), any_value(b)),6) AS whisker_high, "
    "count(*) FILTER (WHERE x NOT BETWEEN a-1.5*(b-a) AND b+1.5*(b-a)) AS beyond FROM v JOIN (SELECT cluster, quantile_cont(x,0.25) AS a, "
    "quantile_cont(x,0.5) AS m, quantile_cont(x,0.75) AS b FROM v GROUP BY cluster) q USING (cluster) GROUP BY cluster", LABELLED, *SHAPE))
def _(spark, sf_dir):
    return rounded(sh.box_whiskers(labelled(spark, sf_dir), ["revenue"]), skip=("mean",)).withColumn("mean", r("mean", 4))


@query("rule_insights", "M9", on_company(
    "SELECT 'segment_size' AS insight, CAST(cluster AS VARCHAR) AS subject, 'pct' AS metric, round(100.0*count(*)/sum(count(*)) OVER (),4) AS value FROM labelled GROUP BY cluster UNION ALL "
    + each(COLS[:3], "SELECT 'segment_mean', CAST(cluster AS VARCHAR), '{c}', round(avg({c}),2) FROM labelled GROUP BY cluster") + " UNION ALL "
    "SELECT 'segment_difference', CAST(cluster AS VARCHAR), feature, round(diff,4) FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pos) AS k FROM ("
    + " UNION ALL ".join(
        f"SELECT cluster, '{c}' AS feature, {i} AS pos, (m-o)/abs(o)*100 AS diff FROM (SELECT a.cluster, (SELECT avg({c}) FROM labelled b WHERE b.cluster = a.cluster) AS m, "
        f"(SELECT avg({c}) FROM labelled b WHERE b.cluster <> a.cluster) AS o FROM (SELECT DISTINCT cluster FROM labelled) a) x WHERE abs(o) > 1e-10 AND abs(m-o) > 0.1*abs(o)"
        for i, c in enumerate(COLS)) + ") y) w WHERE k <= 3 UNION ALL SELECT 'outliers', feature, 'pct', round(pct,4) FROM (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS pos, 100.0*count(*) FILTER (WHERE {c} < {lo(c)} OR {c} > {hi(c)})/count(*) AS pct FROM company CROSS JOIN fence"
        for i, c in enumerate(COLS)) + ") y WHERE pct > 0) w WHERE k <= 5", LABELLED, FENCES))
def _(spark, sf_dir):
    out = sg.rule_insights(labelled(spark, sf_dir), COLS)
    return out.withColumn("value", F.when(F.col("insight") == "segment_mean", r("value", 2)).otherwise(r("value", 4)))
