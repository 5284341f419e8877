"""Queries: significance tests, scaling, collinearity, cluster quality, rankings, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.catalog.base import LABELLED, company, each, labelled, on_company, query, r, rounded
from firmlens.functions.clean import combine_text
from firmlens.operators import profile_stats as ps
from firmlens.operators import ranking as rk
from firmlens.operators import segments as sg
from firmlens.operators import significance as sig
from firmlens.operators import validate as va
from firmlens.operators import vectors as ve
from firmlens.functions.stopwords import ENGLISH
from firmlens.operators.text import fit_tfidf

COLS = ["revenue", "market_value", "it_spend", "employees", "sites", "servers"]

# --- contingency and tests ---------------------------------------------------------

CELLS = (
    "cells AS (SELECT cat, cluster, row_total, col_total, coalesce(o.n,0) AS observed, CAST(row_total AS DOUBLE)*col_total/t AS expected FROM "
    "(SELECT {c} AS cat, count(*) AS row_total FROM labelled WHERE {c} IS NOT NULL GROUP BY 1) a CROSS JOIN "
    "(SELECT cluster, count(*) AS col_total FROM labelled WHERE {c} IS NOT NULL GROUP BY 1) b CROSS JOIN (SELECT count({c}) AS t FROM labelled) x "
    "LEFT JOIN (SELECT {c} AS cat, cluster, count(*) AS n FROM labelled GROUP BY 1, 2) o USING (cat, cluster))"
)


@query("contingency", "A28", on_company(
    "SELECT cat AS category, CAST(cluster AS INT) AS cluster, observed, round(expected,6) AS expected FROM cells", LABELLED, CELLS.format(c="ownership_type")))
def _(spark, sf_dir):
    out = sig.contingency(labelled(spark, sf_dir), "ownership_type")
    return rounded(out.select("category", "cluster", "observed", "expected"))


@query("crosstab", "A28", on_company(
    "SELECT industry AS category, " + ", ".join(f"count(*) FILTER (WHERE cluster = {c}) AS cluster_{c}" for c in range(4))
    + " FROM labelled GROUP BY industry", LABELLED))
def _(spark, sf_dir):
    return sig.crosstab(labelled(spark, sf_dir), "industry", [0, 1, 2, 3])


# With an even number of degrees of freedom 2m the tail is exp(-x/2) * sum over j < m of (x/2)^j / j!.
def chi_sql(c):
    return (
        f"SELECT '{c}' AS feature, chi2, CAST(dof AS INT) AS dof, exp(-chi2/2)*list_sum(list_transform(range(0, (dof//2)::BIGINT), lambda j: pow(chi2/2, j)/"
        "gamma(j+1))) AS p, me AS min_expected, CAST(b5 AS INT) AS cells_below_5 FROM (SELECT sum((observed-expected)*(observed-expected)/expected) AS chi2, "
        f"(count(DISTINCT cat)-1)*(count(DISTINCT cluster)-1) AS dof, min(expected) AS me, count(*) FILTER (WHERE expected < 5) AS b5 FROM cells_{c}) z"
    )


TESTED = ["entity_type", "industry", "region"]
CHI = ("chi AS (" + " UNION ALL ".join(chi_sql(c) for c in TESTED) + ")")
CHI_CTES = (LABELLED, *[CELLS.format(c=c).replace("cells AS", f"cells_{c} AS") for c in TESTED], CHI)


@query("chi_square", "V8", on_company(
    "SELECT feature, round(chi2,6) AS chi2, dof, round(p,6) AS p, round(min_expected,6) AS min_expected, cells_below_5, "
    "CASE WHEN min_expected < 5 THEN 1 ELSE 0 END AS assumption_violated FROM chi", *CHI_CTES))
def _(spark, sf_dir):
    return rounded(sig.chi_square(labelled(spark, sf_dir), TESTED))


@query("chi_square_2x2_corrected", "V8", on_company(
    "SELECT 'ownership_type' AS feature, round(sum(pow(greatest(abs(observed-expected)-0.5,0),2)/expected),6) AS chi2, 1 AS dof FROM cells",
    "labelled AS (SELECT *, CAST(company_id % 3 // 2 AS INT) AS cluster FROM company)", CELLS.format(c="ownership_type")))
def _(spark, sf_dir):
    df = company(spark, sf_dir).withColumn("cluster", F.floor(F.col("company_id") % 3 / 2).cast("int"))
    return rounded(sig.chi_square(df, ["ownership_type"]).select("feature", "chi2", "dof"))


@query("chi_square_all", "V9,W4", on_company(
    "SELECT feature, round(chi2,6) AS chi2, round(p,6) AS p, round(least(1.0, p*count(*) OVER ()),6) AS p_adjusted, "
    "CASE WHEN least(1.0, p*count(*) OVER ()) < 0.05 THEN 1 ELSE 0 END AS significant FROM chi", *CHI_CTES))
def _(spark, sf_dir):
    out = sig.chi_square_all(labelled(spark, sf_dir), TESTED)
    return rounded(out.select("feature", "chi2", "p", "p_adjusted", "significant"))


PVALS = ("pv AS (SELECT industry || '/' || entity_type AS feature, pow(CAST(count(*) AS DOUBLE)/(SELECT count(*) FROM company), 2) AS p FROM company GROUP BY industry, entity_type)")


def pvalues(spark, sf_dir):
    """Stand-in p-values that come from the table: squared shares of category pairs."""
    df = company(spark, sf_dir)
    total = float(df.count())
    return df.groupBy("industry", "entity_type").agg(F.count("*").alias("n")).select(
        F.concat_ws("/", "industry", "entity_type").alias("feature"), F.pow(F.col("n") / total, F.lit(2.0)).alias("p"))


@query("adjust_pvalues_bh", "W4", on_company(
    "SELECT feature, round(p,9) AS p, round(least(1.0, min(p*m/k) OVER (ORDER BY k DESC)),9) AS p_adjusted FROM "
    "(SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, feature) AS k FROM pv) z", PVALS))
def _(spark, sf_dir):
    return rounded(sig.adjust_pvalues(pvalues(spark, sf_dir), "bh"), 9)


@query("adjust_pvalues_by", "W4", on_company(
    "SELECT feature, round(p,9) AS p, round(least(1.0, min(p*m*h/k) OVER (ORDER BY k DESC)),9) AS p_adjusted FROM "
    "(SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, feature) AS k, (SELECT list_sum(list_transform(range(1, (count(*)+1)::BIGINT), lambda i: 1.0::DOUBLE/i)) FROM pv) AS h FROM pv) z", PVALS))
def _(spark, sf_dir):
    return rounded(sig.adjust_pvalues(pvalues(spark, sf_dir), "by"), 9)


# With two between-group degrees of freedom the tail is (1 + 2F/d)^(-d/2).
THREE = "three AS (SELECT *, CAST(company_id % 3 AS INT) AS cluster FROM company)"


@query("anova", "V10,F36", on_company(each(
        ["market_value", "sites", "laptops"],
        "SELECT '{c}' AS feature, round(f,6) AS f, CAST(2 AS INT) AS df_between, d AS df_within, round(pow(1+2*f/d, -d/2.0),6) AS p, CASE WHEN pow(1+2*f/d, -d/2.0) < 0.001 THEN '***' "
        "WHEN pow(1+2*f/d, -d/2.0) < 0.01 THEN '**' WHEN pow(1+2*f/d, -d/2.0) < 0.05 THEN '*' ELSE 'ns' END AS stars FROM (SELECT (sum(n*(m-g)*(m-g))/2)/(sum(ss)/(sum(n)-3)) AS f, "
        "CAST(sum(n)-3 AS BIGINT) AS d FROM (SELECT cluster, count(x) AS n, avg(x) AS m, var_pop(x)*count(x) AS ss, any_value(g) AS g FROM (SELECT cluster, x, avg(x) OVER () AS g FROM "
        "(SELECT cluster, CASE WHEN max({c}) OVER ()/(min(CASE WHEN {c} > 0 THEN {c} END) OVER ()+1e-10) > 100 THEN log10({c}+1) ELSE {c} END AS x FROM three) y) v GROUP BY cluster) z) q"), THREE))
def _(spark, sf_dir):
    df = company(spark, sf_dir).withColumn("cluster", (F.col("company_id") % 3).cast("int"))
    return rounded(sig.anova(df, ["market_value", "sites", "laptops"]))


# --- scaling ------------------------------------------------------------------------------

@query("standard_scale", "E1", on_company(
    "SELECT company_id, " + ", ".join(f"round(({c}-a_{c})/s_{c},6) AS {c}" for c in COLS) + " FROM company CROSS JOIN (SELECT "
    + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in COLS) + " FROM company) x"))
def _(spark, sf_dir):
    df = company(spark, sf_dir)
    return rounded(ve.standard_scaler(df, COLS).transform(df).select("company_id", *COLS))


ROBUST = ("x AS (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE),0.5) AS m_{c}, coalesce(nullif(quantile_cont(CAST({c} AS DOUBLE),0.75)-quantile_cont(CAST({c} AS DOUBLE),0.25),0),1) AS s_{c}"
    for c in [*COLS, "constant"]) + " FROM (SELECT *, 7 AS constant FROM company) y)")


@query("robust_scale", "E2", on_company(
    "SELECT company_id, " + ", ".join(f"round(({c}-m_{c})/s_{c},6) AS {c}" for c in [*COLS, "constant"])
    + " FROM (SELECT *, 7 AS constant FROM company) y CROSS JOIN x", ROBUST))
def _(spark, sf_dir):
    df = company(spark, sf_dir).withColumn("constant", F.lit(7))
    return rounded(ve.robust_scaler(df, [*COLS, "constant"]).transform(df).select("company_id", *COLS, "constant"))


@query("auto_scale", "E3", on_company(
    "SELECT company_id, CASE WHEN worst > 5 THEN 'robust' ELSE 'standard' END AS kind, round((market_value - CASE WHEN worst > 5 THEN m ELSE a END)/"
    "CASE WHEN worst > 5 THEN b-q ELSE s END,6) AS market_value FROM company CROSS JOIN (SELECT max(pct) AS worst FROM (" + each(
        ["market_value", "sites"], "SELECT 100.0*count(*) FILTER (WHERE {c} < a-1.5*(b-a) OR {c} > b+1.5*(b-a))/count(*) AS pct FROM company CROSS JOIN "
        "(SELECT quantile_cont(CAST({c} AS DOUBLE),0.25) AS a, quantile_cont(CAST({c} AS DOUBLE),0.75) AS b FROM company) z") + ") y) w CROSS JOIN "
    "(SELECT avg(market_value) AS a, stddev_pop(market_value) AS s, quantile_cont(market_value,0.5) AS m, quantile_cont(market_value,0.25) AS q, "
    "quantile_cont(market_value,0.75) AS b FROM company) v"))
def _(spark, sf_dir):
    df = company(spark, sf_dir)
    scaler = ve.auto_scaler(df, ["market_value", "sites"])
    return rounded(df.select("company_id", F.lit(scaler.kind).alias("kind"), scaler.column("market_value").alias("market_value")))


@query("choose_metric", "E7", on_company(
    "SELECT 'euclidean' AS plain, 'mixed' AS with_categories, 'gower' AS mostly_categories, count(*) AS n FROM company"))
def _(spark, sf_dir):
    df = company(spark, sf_dir)
    numeric = len(ps.select_available_numeric(df, exclude=["company_id"]))
    text = len([c for c, t in df.dtypes if t == "string" and c not in ("company_name", "employee_band", "status")])
    kinds = [ve.choose_metric(numeric, 0), ve.choose_metric(numeric, text), ve.choose_metric(2, text)]
    return df.agg(*[F.lit(k).alias(n) for k, n in zip(kinds, ("plain", "with_categories", "mostly_categories"))], F.count("*").alias("n"))


# --- collinearity ---------------------------------------------------------------------------

COLLINEAR = "co AS (SELECT *, it_spend*2+1 AS twin FROM company)"


@query("prune_correlated", "E8", on_company(
    "SELECT feature FROM (" + each(["market_value", "it_spend", "sites"], "SELECT '{c}' AS feature") + ") z UNION ALL SELECT 'twin' FROM "
    "(SELECT corr(it_spend, twin) AS c, var_samp(twin) AS a, var_samp(it_spend) AS b FROM co) x WHERE c <= 0.9 OR a > b "
    "EXCEPT SELECT 'it_spend' FROM (SELECT corr(it_spend, twin) AS c, var_samp(twin) AS a, var_samp(it_spend) AS b FROM co) y WHERE c > 0.9 AND b < a", COLLINEAR))
def _(spark, sf_dir):
    df = company(spark, sf_dir).withColumn("twin", F.col("it_spend") * 2 + 1)
    kept = ve.prune_correlated(df, ["market_value", "it_spend", "sites", "twin"])
    return df.agg(F.array(*[F.lit(c) for c in kept]).alias("kept"), F.count("*")).select(F.explode("kept").alias("feature"))


# Three columns: the inflation of a against b and c has a closed form in the correlations.
VIF3 = ("c3 AS (SELECT corr(market_value,it_spend) AS ab, corr(market_value,sites) AS ac, corr(it_spend,sites) AS bc FROM company)",
        "v3 AS (SELECT 'market_value' AS feature, 1/(1-(ab*ab+ac*ac-2*ab*ac*bc)/(1-bc*bc)) AS vif FROM c3 UNION ALL "
        "SELECT 'it_spend', 1/(1-(ab*ab+bc*bc-2*ab*ac*bc)/(1-ac*ac)) FROM c3 UNION ALL SELECT 'sites', 1/(1-(ac*ac+bc*bc-2*ab*ac*bc)/(1-ab*ab)) FROM c3)")


@query("vif_report", "E10", on_company("SELECT feature, round(vif,6) AS vif, CASE WHEN vif > 10 THEN 1 ELSE 0 END AS high FROM v3", *VIF3))
def _(spark, sf_dir):
    return rounded(ve.vif_report(company(spark, sf_dir), ["market_value", "it_spend", "sites"]))


@query("rank_vif", "T6", on_company(
    "SELECT feature, round(vif,6) AS vif, CASE WHEN vif > 10 THEN 1 ELSE 0 END AS high, CAST(row_number() OVER (ORDER BY vif DESC, feature) AS INT) AS rank, "
    "CASE WHEN vif > 10 AND row_number() OVER (ORDER BY vif DESC, feature) = 1 THEN 1 ELSE 0 END AS remove FROM v3", *VIF3))
def _(spark, sf_dir):
    return rounded(rk.rank_vif(ve.vif_report(company(spark, sf_dir), ["market_value", "it_spend", "sites"])))


@query("vif_prune", "E9,U3", on_company(
    "SELECT feature FROM (" + each(["market_value", "sites"], "SELECT '{c}' AS feature")
    + ") z UNION ALL SELECT 'twin' FROM (SELECT corr(it_spend, twin) AS c FROM co) x WHERE c > 0.9999", COLLINEAR))
def _(spark, sf_dir):
    df = company(spark, sf_dir).withColumn("twin", F.col("it_spend") * 2 + 1)
    kept = ve.vif_prune(df, ["it_spend", "market_value", "sites", "twin"])
    return df.agg(F.array(*[F.lit(c) for c in kept]).alias("kept"), F.count("*")).select(F.explode("kept").alias("feature"))


# --- cluster quality on a fixed labelling ------------------------------------------------------

VEC = {"f1": "coalesce(revenue,0)/1000000", "f2": "market_value/10000000", "f3": "coalesce(CAST(employees AS DOUBLE),0)/1000", "f4": "sites/10.0::DOUBLE"}
POINTS = "pts AS (SELECT company_id, CAST(company_id % 4 AS INT) AS cluster, " + ", ".join(f"{e} AS {n}" for n, e in VEC.items()) + " FROM company)"


def points(spark, sf_dir):
    z = F.coalesce(F.col("revenue"), F.lit(0.0)) / 1000000
    return labelled(spark, sf_dir).select(
        "company_id", "cluster",
        F.array(z, F.col("market_value") / 10000000, F.coalesce(F.col("employees").cast("double"), F.lit(0.0)) / 1000,
                F.col("sites").cast("double") / 10).alias("features"))


SIL = ("pairs AS (SELECT a.company_id, a.cluster AS own, b.cluster, sum(sqrt(" + "+".join(f"(a.{f}-b.{f})*(a.{f}-b.{f})" for f in VEC)
       + ")) AS s, count(*) AS n FROM pts a CROSS JOIN pts b GROUP BY 1, 2, 3)",
       "one AS (SELECT company_id, sum(s) FILTER (WHERE cluster = own)/nullif(sum(n) FILTER (WHERE cluster = own)-1,0) AS a, "
       "min(s/n) FILTER (WHERE cluster <> own) AS b FROM pairs GROUP BY company_id)")


@query("silhouette", "V1", on_company(
    "SELECT round(avg(CASE WHEN a IS NULL OR greatest(a,b) = 0 THEN 0 ELSE (b-a)/greatest(a,b) END),6) AS silhouette, count(*) AS n FROM one", POINTS, *SIL))
def _(spark, sf_dir):
    got = va.silhouette(points(spark, sf_dir), anchors=None)
    return rounded(spark.createDataFrame([(got.score, got.rows)], "silhouette double, n long"))


@query("silhouette_of_vectors", "V1", """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id, a.label AS own, b.label, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM v a CROSS JOIN v b GROUP BY 1, 2, 3),
one AS (SELECT vec_id, sum(s) FILTER (WHERE label = own)/nullif(sum(n) FILTER (WHERE label = own)-1,0) AS a,
 min(s/n) FILTER (WHERE label <> own) AS b FROM pairs GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL OR greatest(a,b) = 0 THEN 0 ELSE (b-a)/greatest(a,b) END),5) AS silhouette, count(*) AS n FROM one""")
def _(spark, sf_dir):
    got = va.silhouette(embedded(spark, sf_dir), "label", key="vec_id", anchors=None)
    return rounded(spark.createDataFrame([(got.score, got.rows)], "silhouette double, n long"), 5)


def embedded(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


CENTRES = ("cen AS (SELECT cluster, count(*) AS n, " + ", ".join(f"avg({f}) AS {f}" for f in VEC) + " FROM pts GROUP BY cluster)",
           "gap AS (SELECT p.cluster, " + "+".join(f"(p.{f}-c.{f})*(p.{f}-c.{f})" for f in VEC) + " AS d2 FROM pts p JOIN cen c USING (cluster))",
           "spr AS (SELECT cluster, avg(sqrt(d2)) AS s, sum(d2) AS w FROM gap GROUP BY cluster)")


@query("davies_bouldin", "V2", on_company(
    "SELECT round(avg(worst),6) AS davies_bouldin FROM (SELECT a.cluster, max((x.s+y.s)/sqrt(" + "+".join(f"(a.{f}-b.{f})*(a.{f}-b.{f})" for f in VEC)
    + ")) AS worst FROM cen a JOIN cen b ON a.cluster <> b.cluster JOIN spr x ON x.cluster = a.cluster JOIN spr y ON y.cluster = b.cluster GROUP BY a.cluster) z",
    POINTS, *CENTRES))
def _(spark, sf_dir):
    return rounded(spark.createDataFrame([(va.davies_bouldin(points(spark, sf_dir)),)], "davies_bouldin double"))


@query("calinski_harabasz", "V3", on_company(
    "SELECT round((b/(k-1))/(w/(n-k)),6) AS calinski_harabasz FROM (SELECT sum(c.n*(" + "+".join(f"(c.{f}-g.{f})*(c.{f}-g.{f})" for f in VEC)
    + ")) AS b, count(*) AS k, sum(c.n) AS n FROM cen c CROSS JOIN (SELECT " + ", ".join(f"avg({f}) AS {f}" for f in VEC)
    + " FROM pts) g) x CROSS JOIN (SELECT sum(w) AS w FROM spr) y", POINTS, *CENTRES))
def _(spark, sf_dir):
    return rounded(spark.createDataFrame([(va.calinski_harabasz(points(spark, sf_dir)),)], "calinski_harabasz double"))


@query("adjusted_rand", "V4", on_company(
    "SELECT round((s-a*b/t)/((a+b)/2-a*b/t),6) AS adjusted_rand FROM (SELECT (SELECT sum(n*(n-1)/2.0) FROM (SELECT count(*) AS n FROM two GROUP BY x, y) q) AS s, "
    "(SELECT sum(n*(n-1)/2.0) FROM (SELECT count(*) AS n FROM two GROUP BY x) q) AS a, (SELECT sum(n*(n-1)/2.0) FROM (SELECT count(*) AS n FROM two GROUP BY y) q) AS b, "
    "(SELECT count(*)*(count(*)-1)/2.0 FROM two) AS t) z", "two AS (SELECT industry AS x, sites // 10 AS y FROM company)"))
def _(spark, sf_dir):
    df = company(spark, sf_dir).select("industry", F.floor(F.col("sites") / 10).alias("y"))
    return rounded(spark.createDataFrame([(va.adjusted_rand(df, "industry", "y"),)], "adjusted_rand double"))


@query("nearest_centre_distance", "J4", on_company(
    "SELECT p.company_id, round(min(sqrt(" + "+".join(f"(p.{f}-c.{f})*(p.{f}-c.{f})" for f in VEC) + ")),6) AS nearest FROM pts p CROSS JOIN cen c GROUP BY p.company_id",
    POINTS, *CENTRES[:1]))
def _(spark, sf_dir):
    df = points(spark, sf_dir)
    centres = df.groupBy("cluster").agg(*[F.avg(F.col("features")[i]).alias(f"f{i}") for i in range(4)]).select(
        F.array("f0", "f1", "f2", "f3").alias("centre"))
    return rounded(va.nearest_centre_distance(df, centres).select("company_id", "nearest"))


# --- choice of K on fixed labellings ----------------------------------------------------------------

LABELLINGS = list(range(2, 8))


@query("select_k", "T5", on_company(
    "SELECT k, round(silhouette,6) AS silhouette, round(davies_bouldin,6) AS davies_bouldin, round(calinski_harabasz,6) AS calinski_harabasz, round(combined,5) AS combined, business FROM "
    "(SELECT *, CASE WHEN bp >= ms*0.7 THEN 1 ELSE 0 END AS business, CASE WHEN bp >= ms*0.7 THEN CASE WHEN k BETWEEN 4 AND 8 THEN silhouette END ELSE combined END AS pick FROM (SELECT *, "
    "0.4*silhouette+0.3*(max(davies_bouldin) OVER ()-davies_bouldin)/(max(davies_bouldin) OVER ()-min(davies_bouldin) OVER ()+1e-10)+0.3*(calinski_harabasz-min(calinski_harabasz) OVER ())/"
    "(max(calinski_harabasz) OVER ()-min(calinski_harabasz) OVER ()+1e-10) AS combined, max(silhouette) OVER () AS ms, max(CASE WHEN k BETWEEN 4 AND 8 THEN silhouette END) OVER () AS bp FROM met) y) z "
    "ORDER BY pick DESC NULLS LAST, k LIMIT 1",
    POINTS, "lab AS (SELECT k, company_id, CAST(floor(f4*10) AS BIGINT) % k AS cl, " + ", ".join(VEC) + " FROM pts CROSS JOIN (SELECT unnest(range(2,8)) AS k) r)",
    "c2 AS (SELECT k, cl, count(*) AS n, " + ", ".join(f"avg({f}) AS {f}" for f in VEC) + " FROM lab GROUP BY k, cl)",
    "g2 AS (SELECT l.k, l.cl, avg(sqrt(d)) AS s, sum(d) AS w FROM (SELECT l.k, l.cl, " + "+".join(f"(l.{f}-c.{f})*(l.{f}-c.{f})" for f in VEC)
    + " AS d FROM lab l JOIN c2 c ON c.k=l.k AND c.cl=l.cl) l GROUP BY l.k, l.cl)",
    "db AS (SELECT k, avg(worst) AS davies_bouldin FROM (SELECT a.k, a.cl, max((x.s+y.s)/sqrt(" + "+".join(f"(a.{f}-b.{f})*(a.{f}-b.{f})" for f in VEC)
    + ")) AS worst FROM c2 a JOIN c2 b ON a.k=b.k AND a.cl<>b.cl JOIN g2 x ON x.k=a.k AND x.cl=a.cl JOIN g2 y ON y.k=b.k AND y.cl=b.cl GROUP BY a.k, a.cl) z GROUP BY k)",
    "ch AS (SELECT k, (b/(m-1))/(w/(n-m)) AS calinski_harabasz FROM (SELECT c.k, sum(c.n*(" + "+".join(f"(c.{f}-g.{f})*(c.{f}-g.{f})" for f in VEC)
    + ")) AS b, count(*) AS m, sum(c.n) AS n FROM c2 c CROSS JOIN (SELECT " + ", ".join(f"avg({f}) AS {f}" for f in VEC) + " FROM pts) g GROUP BY c.k) x JOIN (SELECT k, sum(w) AS w FROM g2 GROUP BY k) y USING (k))",
    "pr AS (SELECT a.company_id, b.company_id AS other, sqrt(" + "+".join(f"(a.{f}-b.{f})*(a.{f}-b.{f})" for f in VEC) + ") AS d FROM pts a CROSS JOIN pts b)",
    "sm AS (SELECT b.k, p.company_id, b.cl, sum(p.d) AS s, count(*) AS n FROM pr p JOIN lab b ON b.company_id = p.other GROUP BY 1, 2, 3)",
    "si AS (SELECT k, avg(CASE WHEN a IS NULL OR greatest(a,b) = 0 THEN 0 ELSE (b-a)/greatest(a,b) END) AS silhouette FROM (SELECT s.k, s.company_id, sum(s.s) FILTER (WHERE s.cl=l.cl)/"
    "nullif(sum(s.n) FILTER (WHERE s.cl=l.cl)-1,0) AS a, min(s.s/s.n) FILTER (WHERE s.cl<>l.cl) AS b FROM sm s JOIN lab l ON l.k=s.k AND l.company_id=s.company_id GROUP BY 1, 2) q GROUP BY k)",
    "met AS (SELECT k, silhouette, davies_bouldin, calinski_harabasz FROM si JOIN db USING (k) JOIN ch USING (k))"))
def _(spark, sf_dir):
    df = points(spark, sf_dir)
    site = F.floor(F.col("features")[3] * 10).cast("long")
    df = df.withColumns({f"k{k}": (site % k).cast("int") for k in LABELLINGS})
    scores = va.silhouettes(df, [f"k{k}" for k in LABELLINGS], anchors=None)
    rows = []
    for k, s in zip(LABELLINGS, scores):
        stats = va.centroid_stats(df, f"k{k}")
        rows.append((k, s.score, stats.davies_bouldin(), stats.calinski_harabasz()))
    metrics = spark.createDataFrame(rows, "k long, silhouette double, davies_bouldin double, calinski_harabasz double")
    return rounded(rk.select_k(metrics)).withColumn("combined", r("combined", 5))


# --- rankings ----------------------------------------------------------------------------------------

MEANS = ("coef AS (" + each(COLS, "SELECT cluster, '{c}' AS feature, (avg({c})-any_value(g))/any_value(s) AS coefficient FROM labelled CROSS JOIN "
                            "(SELECT avg({c}) AS g, stddev_pop({c}) AS s FROM labelled) x GROUP BY cluster") + ")")


def coefficients(spark, sf_dir):
    """Stand-in coefficients from the table: standardised cluster means."""
    df = labelled(spark, sf_dir)
    scaled = ve.standard_scaler(df, COLS).transform(df)
    return ps.per_feature(scaled, COLS, {"coefficient": F.avg}, "cluster")


@query("top_drivers", "T1", on_company(
    "SELECT cluster, feature, round(coefficient,6) AS coefficient, rank, direction FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY abs(coefficient) DESC, feature) AS INT) AS rank, "
    "CASE WHEN coefficient >= 0 THEN 'increases' ELSE 'decreases' END AS direction FROM coef) z WHERE rank <= 5", LABELLED, MEANS))
def _(spark, sf_dir):
    return rounded(rk.top_drivers(coefficients(spark, sf_dir), 5))


CORR_COEF = "cc AS (" + each(["market_value", "it_spend", "it_budget", "employees", "sites", "servers"],
                             "SELECT '{c}' AS feature, corr(revenue, {c}) AS coefficient FROM company") + ")"


@query("top_coefficients", "T2", on_company(
    "SELECT feature, round(coefficient,6) AS coefficient FROM cc ORDER BY abs(coefficient) DESC, feature LIMIT 3", CORR_COEF))
def _(spark, sf_dir):
    corr = ps.correlation_matrix(company(spark, sf_dir), ["revenue", "market_value", "it_spend", "it_budget", "employees", "sites", "servers"])
    frame = corr.where("feature_a = 'revenue' AND feature_b <> 'revenue'").select(
        F.col("feature_b").alias("feature"), F.col("corr").alias("coefficient"))
    return rounded(rk.top_coefficients(frame, 3))


LOADED = "ld AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS component, '{b}' AS feature, " + ("CAST(1 AS DOUBLE)" if a == b else f"corr({a},{b})") + " AS loading FROM company" + (" GROUP BY 1, 2" if a == b else "")
    for a in COLS[:3] for b in COLS) + ")"


def loadings(spark, sf_dir):
    """Stand-in loadings from the table: correlations with three columns."""
    corr = ps.correlation_matrix(company(spark, sf_dir), COLS)
    return corr.where(F.col("feature_a").isin(*COLS[:3])).select(
        F.col("feature_a").alias("component"), F.col("feature_b").alias("feature"), F.col("corr").alias("loading"))


@query("top_loadings", "T4", on_company(
    "SELECT component, feature, round(loading,6) AS loading, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY component ORDER BY loading DESC, feature) AS INT) AS rank FROM ld) z WHERE rank <= 4", LOADED))
def _(spark, sf_dir):
    return rounded(rk.top_loadings(loadings(spark, sf_dir), 4))


@query("top_loadings_together", "T4", on_company(
    "SELECT feature, round(sum(abs(loading)),6) AS weight FROM ld WHERE component IN ('revenue','market_value') GROUP BY feature ORDER BY sum(abs(loading)) DESC, feature LIMIT 4", LOADED))
def _(spark, sf_dir):
    return rounded(rk.top_loadings_together(loadings(spark, sf_dir), ["revenue", "market_value"], 4))


@query("cumulative_variance", "W3", on_company(
    "SELECT component, round(explained,6) AS explained, round(cumulative,6) AS cumulative, CASE WHEN cumulative-explained < 0.85 THEN 1 ELSE 0 END AS kept FROM "
    "(SELECT *, sum(explained) OVER (ORDER BY component) AS cumulative FROM spec) z",
    "spec AS (SELECT CAST(row_number() OVER (ORDER BY v DESC) AS INT) AS component, v/sum(v) OVER () AS explained FROM (SELECT country, sum(market_value) AS v FROM company "
    "WHERE country IS NOT NULL GROUP BY country) q)"))
def _(spark, sf_dir):
    from pyspark.sql import Window as W

    sums = company(spark, sf_dir).where("country IS NOT NULL").groupBy("country").agg(F.sum("market_value").alias("v"))
    every = W.partitionBy(F.lit(0))  # one row per country
    spec = sums.select(F.row_number().over(every.orderBy(F.desc("v"))).alias("component"), (F.col("v") / F.sum("v").over(every)).alias("explained"))
    return rounded(rk.cumulative_variance(spec))


BAND_SQL = {
    "silhouette": "CASE WHEN v > 0.7 THEN 'strong' WHEN v > 0.5 THEN 'reasonable' WHEN v > 0.25 THEN 'weak' ELSE 'none' END",
    "silhouette_tier": "CASE WHEN v > 0.5 THEN 'good' WHEN v > 0.3 THEN 'moderate' ELSE 'weak' END",
    "r2": "CASE WHEN v > 0.7 THEN 'strong' WHEN v > 0.5 THEN 'moderate' ELSE 'limited' END",
    "variance": "CASE WHEN v > 0.9 THEN 'excellent' WHEN v > 0.7 THEN 'good' WHEN v > 0.5 THEN 'moderate' ELSE 'limited' END",
    "ari": "CASE WHEN v > 0.8 THEN 'highly stable' WHEN v > 0.6 THEN 'moderately stable' ELSE 'unstable' END",
    "stars": "CASE WHEN v < 0.001 THEN '***' WHEN v < 0.01 THEN '**' WHEN v < 0.05 THEN '*' ELSE 'ns' END",
}


@query("interpretation_bands", "F36", on_company(
    "SELECT company_id, " + ", ".join(f"{e} AS {n}" for n, e in BAND_SQL.items()) + " FROM (SELECT company_id, (it_spend/market_value)*20 AS v FROM company) z"))
def _(spark, sf_dir):
    from firmlens.functions.bands import BANDS, interpretation, p_value_stars

    v = (F.col("it_spend") / F.col("market_value")) * 20
    return company(spark, sf_dir).select(
        "company_id", *[interpretation(k, v).alias(k) for k in BANDS], p_value_stars(v).alias("stars"))


# --- text -----------------------------------------------------------------------------------------------

def tfidf_sql(source: str, key: str, text: str, ctes=(), company_based=True) -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
    parts = (
        *ctes,
        f"tok AS (SELECT {key} AS id, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({stops})) AS t FROM {source})",
        "trm AS (SELECT id, unnest(t) AS term FROM tok UNION ALL SELECT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1])) FROM tok WHERE len(t) > 1)",
        "voc AS (SELECT term FROM trm GROUP BY term ORDER BY count(*) DESC, term LIMIT 100)",
        "tf AS (SELECT id, term, count(*) AS tf FROM trm JOIN voc USING (term) GROUP BY id, term)",
        "wt AS (SELECT id, term, tf*(ln((1.0+(SELECT count(*) FROM tok))/(1+count(*) OVER (PARTITION BY term)))+1) AS w FROM tf)",
    )
    body = f"SELECT id AS {key}, term, round(w/sqrt(sum(w*w) OVER (PARTITION BY id)),6) AS weight FROM wt"
    return on_company(body, *parts) if company_based else "WITH " + ",\n".join(parts) + "\n" + body


COMBINED = "coalesce(sic_desc,'') || ' ' || coalesce(naics_desc,'') || ' ' || coalesce(nace_desc,'')"


@query("tfidf_descriptions", "X1,F38", tfidf_sql("company", "company_id", COMBINED))
def _(spark, sf_dir):
    df = company(spark, sf_dir)
    text = combine_text(["sic_desc", "naics_desc", "nace_desc"])
    model = fit_tfidf(df, text)
    return rounded(model.explode(model.transform(df.select("company_id", text.alias("text")), F.col("text")), "company_id"))


@query("tfidf_documents", "X1", tfidf_sql("documents", "doc_id", "text", company_based=False))
def _(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_tfidf(df, F.col("text"))
    return rounded(model.explode(model.transform(df, F.col("text")), "doc_id"))


@query("numeric_and_text_features", "J1", tfidf_sql("company", "company_id", COMBINED).rsplit("SELECT id AS company_id", 1)[0]
    + "SELECT id AS company_id, n, round(s,6) AS market_value_scaled FROM (SELECT company_id AS id, (market_value-a)/d AS s FROM company CROSS JOIN "
    "(SELECT avg(market_value) AS a, stddev_pop(market_value) AS d FROM company) x) y JOIN (SELECT c.company_id AS id, count(tf.term) AS n FROM company c LEFT JOIN tf ON tf.id = c.company_id "
    "GROUP BY c.company_id) z USING (id)")
def _(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = company(spark, sf_dir)
    text = combine_text(["sic_desc", "naics_desc", "nace_desc"])
    scaler = ve.standard_scaler(df, ["market_value"])
    model = fit_tfidf(df, text)
    staged = model.transform(df.select("company_id", scaler.column("market_value").alias("scaled"), text.alias("text")), F.col("text"))
    both = VectorAssembler(inputCols=["scaled", "tfidf"], outputCol="features").transform(staged)
    values = vector_to_array("features")
    return both.select("company_id", F.size(F.filter(F.slice(values, 2, 100), lambda v: v > 0)).cast("long").alias("n"),
                       r(F.get(values, F.lit(0))).alias("market_value_scaled"))
