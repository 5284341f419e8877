"""Queries: predictive models, reports, end-to-end pipelines."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from firmlens.catalog.base import (
    AS_OF_YEAR, LABELLED, MEGA, company, each, labelled, mega_labelled, on_company, query, r, rounded,
)
from firmlens.catalog.cleaning import raw
from firmlens.catalog.stats import METRIC_SQL
from firmlens.catalog.validation import tfidf_sql
from firmlens.functions import ratios
from firmlens.operators import features as ft
from firmlens.operators import kmeans as km
from firmlens.operators import models as md
from firmlens.operators import profile_stats as ps
from firmlens.operators import ranking as rk
from firmlens.operators import segments as sg
from firmlens.plans import model_store as store
from firmlens.plans import pipelines as pl
from firmlens.session import local_rows, scratch_path

Y = AS_OF_YEAR
FEATURES = ["market_value", "it_spend", "sites", "servers", "pcs"]
PRED = ("pred AS (SELECT company_id, CAST(company_id % 4 AS INT) AS label, CAST(CASE WHEN company_id % 7 = 0 THEN (company_id+1) % 4 ELSE company_id % 4 END AS INT) AS p FROM company)")


def predicted(spark, sf_dir):
    k = F.col("company_id")
    return company(spark, sf_dir).select(
        "company_id", (k % 4).cast("int").alias("label"), F.when(k % 7 == 0, (k + 1) % 4).otherwise(k % 4).cast("int").alias("p"))


# The cut is the 0.8 quantile of a class's distinct hashes: rows from the next rank on are test rows.
@query("train_test_split", "M1", on_company(
    "SELECT cluster, is_test, CASE WHEN is_test THEN n - 1 - CAST(floor((n-1)*0.8::DOUBLE) AS BIGINT) ELSE 1 + CAST(floor((n-1)*0.8::DOUBLE) AS BIGINT) END AS n "
    "FROM (SELECT cluster, count(*) AS n FROM labelled GROUP BY cluster) z CROSS JOIN (SELECT unnest([true, false]) AS is_test) t", LABELLED))
def _(spark, sf_dir):
    return md.split(labelled(spark, sf_dir), stratify="cluster").groupBy("cluster", "is_test").agg(F.count("*").alias("n"))


@query("confusion_matrix", "M4", on_company("SELECT label, p AS prediction, count(*) AS n FROM pred GROUP BY label, p", PRED))
def _(spark, sf_dir):
    return md.confusion(predicted(spark, sf_dir), "label", "p")


@query("class_report", "M4", on_company(
    "SELECT class, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, CAST(support AS BIGINT) AS support FROM ("
    "SELECT CAST(c AS VARCHAR) AS class, precision, recall, f1, support FROM cls UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM cls UNION ALL "
    "SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support), sum(support) FROM cls UNION ALL "
    "SELECT 'accuracy', a, a, a, n FROM (SELECT avg((label = p)::INT) AS a, count(*) AS n FROM pred) q) z", PRED,
    "cls AS (SELECT *, 2*precision*recall/(precision+recall) AS f1 FROM (SELECT c, CAST(count(*) FILTER (WHERE label = c AND p = c) AS DOUBLE)/count(*) FILTER (WHERE p = c) AS precision, "
    "CAST(count(*) FILTER (WHERE label = c AND p = c) AS DOUBLE)/count(*) FILTER (WHERE label = c) AS recall, count(*) FILTER (WHERE label = c) AS support "
    "FROM pred CROSS JOIN (SELECT unnest([0,1,2,3]) AS c) k GROUP BY c) x)"))
def _(spark, sf_dir):
    return rounded(md.class_report(predicted(spark, sf_dir), "label", "p"))


@query("logistic_drivers", "M2,T1")
def _(spark, sf_dir):
    df = ps.impute(labelled(spark, sf_dir), FEATURES)
    train, test = md.parts(md.split(df, stratify="cluster"))
    model = md.fit_logistic(train, FEATURES)
    return rounded(rk.top_drivers(model.coefficients(spark), 5)).withColumn(
        "test_accuracy", F.lit(round(md.accuracy(model.predict(test)), 6)))


@query("kfold_accuracy", "M3")
def _(spark, sf_dir):
    return rounded(md.kfold_accuracy(ps.impute(labelled(spark, sf_dir), FEATURES), FEATURES))


# With one standardised feature z the penalised fits have closed forms in c = mean(z * y).
ONE = ("one AS (SELECT covar_pop(it_spend, market_value)/stddev_pop(it_spend) AS c, count(*) AS n FROM company)")


def penalised(name, ids, alpha, expr):
    @query(name, ids, on_company(f"SELECT 'it_spend' AS feature, round({expr},1) AS coefficient FROM one", ONE))
    def _(spark, sf_dir):
        model = md.fit_linear(company(spark, sf_dir), ["it_spend"], "market_value", name.split("_")[0], alpha)
        return rounded(model.coefficients(spark), 1)


penalised("ridge_coefficient", "M5", 50.0, "c*n/(n+50)")
penalised("lasso_coefficient", "M5", 5000.0, "CASE WHEN abs(c) > 5000 THEN sign(c)*(abs(c)-5000) ELSE 0 END")
penalised("elasticnet_coefficient", "M5", 2.0, "sign(c)*(abs(c)-1)/(1+1)")
penalised("none_coefficient", "M5", 0.0, "c")


@query("linear_analysis", "M5,M7,T2")
def _(spark, sf_dir):
    df = ps.impute(company(spark, sf_dir), FEATURES + ["it_budget", "employees"])
    _, metrics = md.linear_analysis(df, FEATURES + ["it_budget", "employees"])
    return rounded(metrics)


@query("regression_metrics", "M7", on_company(
    "SELECT count(*) AS n, round(avg(pow(revenue-market_value/4,2))/1e6,2) AS mse, round(1-sum(pow(revenue-market_value/4,2))/(var_pop(revenue)*count(*)),6) AS r2 FROM company WHERE revenue IS NOT NULL"))
def _(spark, sf_dir):
    df = company(spark, sf_dir).where("revenue IS NOT NULL").withColumn("predicted", F.col("market_value") / 4)
    return md.regression_metrics(df, "revenue").select("n", r(F.col("mse") / 1e6, 2).alias("mse"), r("r2").alias("r2"))


@query("exclude_leaky", "M6,P16", on_company(
    "SELECT feature FROM (" + each(["market_value", "sites", "servers"], "SELECT '{c}' AS feature, (SELECT abs(corr({c}, revenue)) FROM company) AS c")
    + " UNION ALL SELECT 'twin', (SELECT abs(corr(revenue*2+1, revenue)) FROM company)) z WHERE c <= 0.95"))
def _(spark, sf_dir):
    df = company(spark, sf_dir).withColumn("twin", F.col("revenue") * 2 + 1)
    kept = md.exclude_leaky(df, ["revenue", "market_value", "it_spend", "it_budget", "sites", "servers", "twin"], "revenue")
    return df.agg(F.array(*[F.lit(c) for c in kept]).alias("kept"), F.count("*")).select(F.explode("kept").alias("feature"))


@query("forest_importance", "M8,T3")
def _(spark, sf_dir):
    df = ps.impute(labelled(spark, sf_dir), FEATURES).withColumn("cluster", F.floor(F.col("sites") / 15).cast("int"))
    return rounded(rk.feature_importance_rank(md.forest_importance(df, FEATURES, trees=100, depth=20)))


# --- reports and pipelines ------------------------------------------------------------------------

@query("report_table", "S4", on_company(
    "SELECT 'sizes' AS section, CAST(cluster AS VARCHAR) AS subject, 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM labelled GROUP BY cluster UNION ALL "
    "SELECT 'sizes', CAST(cluster AS VARCHAR), 'pct', round(100.0*count(*)/sum(count(*)) OVER (),4) FROM labelled GROUP BY cluster UNION ALL "
    "SELECT 'missing', c, m, round(v,4) FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, 'missing' AS m, CAST(count(*)-count({c}) AS DOUBLE) AS v FROM company UNION ALL SELECT '{c}', 'missing_pct', 100.0*(count(*)-count({c}))/count(*) FROM company"
        for c in ("revenue", "country")) + ") z UNION ALL SELECT 'totals', 'all', 'companies', CAST(count(*) AS DOUBLE) FROM company", LABELLED))
def _(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return rounded(pl.report_table([
        pl.report_rows(sg.cluster_sizes(df), "sizes", "cluster", ["n", "pct"]),
        pl.report_rows(ps.missing_profile(df, ["revenue", "country"]), "missing", "feature", ["missing", "missing_pct"]),
        pl.report_values(spark, "totals", {"companies": df.count()}),
    ]), 4)


# A clean table with one dominant and one tiny cluster, all sections that follow from labels.
REPORTED = ["market_value", "sites", "servers"]
PAIRS = [(a, b) for a in REPORTED for b in REPORTED]


@query("segment_report", "L3,A13,S4", on_company(
    "SELECT 'sizes' AS section, CAST(cluster AS VARCHAR) AS subject, m AS metric, round(CASE WHEN m = 'n' THEN n ELSE 100.0*n/t END,4)::DOUBLE AS value FROM sz CROSS JOIN nm "
    "UNION ALL SELECT 'small_clusters', CAST(cluster AS VARCHAR), m, round(CASE WHEN m = 'n' THEN n ELSE 100.0*n/t END,4)::DOUBLE FROM sz CROSS JOIN nm WHERE n < greatest(10, t*0.01) UNION ALL "
    + each(REPORTED, " UNION ALL ".join(
        "SELECT 'statistics', cluster||'/{c}', '" + m + "', round(CAST(" + e + " AS DOUBLE),4) FROM mega GROUP BY cluster" for m, e in {
            "n": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "q25": "quantile_cont(CAST({c} AS DOUBLE),0.25)",
            "q50": "quantile_cont(CAST({c} AS DOUBLE),0.5)", "q75": "quantile_cont(CAST({c} AS DOUBLE),0.75)"}.items()))
    + " UNION ALL SELECT 'shares', cluster||'/entity_type', entity_type, round(share,4) FROM sh UNION ALL SELECT 'modes', cluster||'/entity_type', entity_type, round(share,4) FROM "
    "(SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY share DESC, entity_type) AS k FROM sh) z WHERE k = 1 UNION ALL "
    + each(REPORTED, "SELECT 'profile', cluster||'/{c}', 'mean', round(avg({c}),4) FROM mega GROUP BY cluster UNION ALL "
           "SELECT 'profile', cluster||'/{c}', 'std', round(stddev_samp({c}),4) FROM mega GROUP BY cluster") + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'correlation', '{a}/{b}', 'corr', round(corr({a},{b}),4) FROM mega" for a, b in PAIRS) + " UNION ALL "
    + each(REPORTED, "SELECT 'differences', cluster||'/{c}', 'difference_pct', round((m-o)/abs(o)*100,4) FROM (SELECT cluster, sum({c})*1.0::DOUBLE/count({c}) AS m, "
           "(sum(sum({c})) OVER () - sum({c}))*1.0::DOUBLE/(sum(count({c})) OVER () - count({c})) AS o FROM mega GROUP BY cluster) z WHERE abs(o) > 1e-10 AND abs(m-o) > 0.1*abs(o)"),
    MEGA, "sz AS (SELECT cluster, count(*) AS n, sum(count(*)) OVER () AS t FROM mega GROUP BY cluster)", "nm AS (SELECT unnest(['n', 'pct']) AS m)",
    "sh AS (SELECT cluster, entity_type, CAST(count(*) AS DOUBLE)/sum(count(*)) OVER (PARTITION BY cluster) AS share FROM mega WHERE entity_type IS NOT NULL GROUP BY cluster, entity_type)"))
def _(spark, sf_dir):
    return rounded(pl.report_table(pl.segment_report(mega_labelled(spark, sf_dir), REPORTED, ["entity_type"])), 4)


@query("process_counts", "P7,P8,L1", on_company(
    "SELECT * FROM (SELECT (SELECT count(*) FROM company) + (SELECT count(*) FROM company WHERE country IS NULL) AS rows_read, "
    "(SELECT count(*) FROM company WHERE country IS NULL) AS copies, count(*) FILTER (WHERE NOT coalesce(v, false)) AS not_valid, count(*) FILTER (WHERE v) AS kept "
    "FROM (SELECT employees <> 0 AND market_value <> 0 AND revenue <> 0 AS v FROM company) z) q"))
def _(spark, sf_dir):
    df = raw(spark, sf_dir)
    doubled = df.unionByName(df.where(F.col("Country").isNull()))
    counts = pl.process(doubled, Y, keep=("company_id",), path=scratch_path(spark, "processed")).counts
    return local_rows(spark, [tuple(counts.values())], ", ".join(f"{c} long" for c in counts))


@query("process_companies", "L1", on_company(
    "SELECT company_id, " + ", ".join(f"round(CAST({e} AS DOUBLE),4) AS {n}" for n, e in METRIC_SQL.items() if n != "geographic_dispersion")
    + ", CAST((country IS NOT NULL)::INT+(region IS NOT NULL)::INT AS INT) AS geographic_dispersion FROM company WHERE employees <> 0 AND market_value <> 0 AND revenue <> 0"))
def _(spark, sf_dir):
    df = raw(spark, sf_dir)
    doubled = df.unionByName(df.where(F.col("Country").isNull()))
    return rounded(pl.process(doubled, Y, keep=("company_id",)).table.select("company_id", *ft.DERIVED_METRICS), 4)


ROLE_COLS = ["revenue", "market_value", "employees", "single_site_employees", "it_budget", "it_spend", "company_age"]
PREP = (
    "my AS (SELECT quantile_cont(CAST(year_founded AS DOUBLE), 0.5) AS m FROM company)",
    f"a1 AS (SELECT company_id, greatest({Y} - CASE WHEN year_founded > {Y} OR year_founded < 1800 THEN m ELSE CAST(year_founded AS DOUBLE) END, 0) AS a FROM company CROSS JOIN my)",
    "num AS (SELECT c.company_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ROLE_COLS if c != "company_age")
    + ", CASE WHEN a > 200 THEN (SELECT quantile_cont(a,0.5) FROM a1) ELSE a END AS company_age FROM company c JOIN a1 USING (company_id))",
    "fil AS (SELECT company_id, " + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c},0.5) FROM num)) AS {c}" for c in ROLE_COLS) + " FROM num)",
    "fen AS (SELECT " + ", ".join(f"quantile_cont({c},0.25) AS a_{c}, quantile_cont({c},0.75) AS b_{c}" for c in ROLE_COLS) + " FROM fil)",
    "cap AS (SELECT company_id, " + ", ".join(f"CASE WHEN b_{c} > a_{c} THEN greatest(least({c}, b_{c}+1.5*(b_{c}-a_{c})), a_{c}-1.5*(b_{c}-a_{c})) ELSE {c} END AS {c}" for c in ROLE_COLS) + " FROM fil CROSS JOIN fen)",
    "ind0 AS (SELECT *, CASE WHEN revenue > 0 THEN market_value/revenue END AS mvr, CASE WHEN revenue > 0 THEN (it_budget+it_spend)/revenue END AS iti FROM cap)",
    "ind1 AS (SELECT company_id, " + ", ".join(ROLE_COLS) + ", coalesce(mvr, (SELECT quantile_cont(mvr,0.5) FROM ind0)) AS mvr, coalesce(iti, (SELECT quantile_cont(iti,0.5) FROM ind0)) AS iti FROM ind0)",
)


@query("preprocess", "L2", on_company(
    "SELECT company_id, " + ", ".join(f"round(({c}-avg({c}) OVER ())/stddev_pop({c}) OVER (),5) AS {c}" for c in [*ROLE_COLS, "mvr", "iti"]) + " FROM ind1", *PREP))
def _(spark, sf_dir):
    prepared = pl.preprocess(company(spark, sf_dir), Y)
    names = [*ROLE_COLS, "market_value_to_revenue_ratio", "it_investment_intensity"]
    out = [F.get("features", F.lit(prepared.numeric.index(n))) for n in names]
    return prepared.frame.select("company_id", *[r(c, 5).alias(a) for c, a in zip(out, [*ROLE_COLS, "mvr", "iti"])])


# What a stored model holds of its fit, read back from the table.
@query("stored_model", "M10,L2", on_company(
    each(ROLE_COLS, "SELECT 'median' AS part, '{c}' AS name, round(quantile_cont({c},0.5),2) AS value FROM num") + " UNION ALL "
    + each(ROLE_COLS, "SELECT 'fence.lower', '{c}', round(a_{c}-1.5*(b_{c}-a_{c}),2) FROM fen WHERE b_{c} > a_{c} UNION ALL "
           "SELECT 'fence.upper', '{c}', round(b_{c}+1.5*(b_{c}-a_{c}),2) FROM fen WHERE b_{c} > a_{c}")
    + " UNION ALL SELECT 'meta', 'as_of_year', " + str(Y), *PREP))
def _(spark, sf_dir):
    df = company(spark, sf_dir)
    prepared = pl.preprocess(df, Y)
    fit = km.kmeans(km.spread_out(prepared.frame.select("company_id", "features")).persist(), 4)
    path = scratch_path(spark, "models")
    rows = store.parameters(spark, path, store.save_model(spark, path, prepared, fit, Y))
    known = F.col("part").isin("median", "fence.lower", "fence.upper") & F.col("name").isin(*ROLE_COLS)
    return rows.where(known | (F.col("name") == "as_of_year")).select("part", "name", r("value", 2).alias("value"))


@query("assign_stored_segment", "M10,J2")
def _(spark, sf_dir):
    df = company(spark, sf_dir)
    prepared = pl.preprocess(df, Y)
    path = scratch_path(spark, "models")
    store.save_model(spark, path, prepared, km.kmeans(km.spread_out(prepared.frame.select("company_id", "features")).persist(), 4), Y)
    return store.load_model(spark, path).assign(df).select("company_id", "cluster")


# The one column that the text roles find here.
@query("preprocess_text", "L2,X1", tfidf_sql("company", "company_id", "coalesce(nace_desc,'')"))
def _(spark, sf_dir):
    prepared = pl.preprocess(company(spark, sf_dir), Y)
    text = F.slice("features", len(prepared.numeric) + 1, len(prepared.tfidf.vocabulary))
    return rounded(prepared.tfidf.explode(prepared.frame.select("company_id", array_to_vector(text).alias("tfidf")), "company_id"))


@query("run_full", "L3")
def _(spark, sf_dir):
    return rounded(pl.run_full(company(spark, sf_dir), Y).report)


@query("run_standard", "L4")
def _(spark, sf_dir):
    table = ft.derived_metrics(company(spark, sf_dir), Y)
    return rounded(pl.run_standard(table).report)


@query("run_enhanced", "L5")
def _(spark, sf_dir):
    table = ft.derived_metrics(company(spark, sf_dir), Y).drop("it_spend_ratio", "market_value_per_employee", "employees_per_site")
    return rounded(pl.run_enhanced(table).report)


@query("assign_segment", "M10,J2")
def _(spark, sf_dir):
    df = company(spark, sf_dir)
    prepared = pl.preprocess(df, Y)
    data = km.spread_out(prepared.frame.select("company_id", "features")).persist()
    fit = km.kmeans(data, 4)
    return pl.assign_segment(df, prepared, fit, Y).select("company_id", "cluster")
