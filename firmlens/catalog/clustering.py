"""Queries: reduction, clustering, stability, consensus.

Fits have no SQL; their queries return what must hold (sizes, scores, labels)
over whole tables, and the tests compare them with brute force.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from firmlens.catalog.base import LABELLED, company, labelled, on_company, query, r, rounded
from firmlens.catalog.features import engineered
from firmlens.catalog.validation import POINTS, VEC, embedded, points
from firmlens.operators import consensus as cs
from firmlens.operators import density as ds
from firmlens.operators import density_tree as dt
from firmlens.operators import kmeans as km
from firmlens.operators import mixture as mx
from firmlens.operators import profile_stats as ps
from firmlens.operators import segments as sg
from firmlens.operators import validate as va
from firmlens.operators import vectors as ve
from firmlens.plans import pipelines as pl
from firmlens.session import local_rows

# Starts per fit in these queries; the library default is 10.
STARTS = 10

# --- reduction --------------------------------------------------------------------------------

# Two columns: the spectrum of a symmetric 2 x 2 matrix has a closed form.
EIGEN = ("m AS (SELECT avg(market_value)/1e6 AS ma, avg(it_spend)/1e3 AS mb, var_samp(market_value/1e6) AS a, var_samp(it_spend/1e3) AS b, "
         "covar_samp(market_value/1e6, it_spend/1e3) AS c, count(*) AS n FROM company)")


def two_columns(spark, sf_dir):
    return company(spark, sf_dir).select(
        "company_id", (F.col("market_value") / 1e6).alias("x"), (F.col("it_spend") / 1e3).alias("y"))


@query("pca_spectrum", "E4", on_company(
    "SELECT CAST(k AS INT) AS component, round(((a+b)/2 + s*sqrt((a-b)*(a-b)/4+c*c))/(a+b),6) AS explained FROM m CROSS JOIN "
    "(SELECT 1 AS k, 1 AS s UNION ALL SELECT 2, -1) t", EIGEN))
def _(spark, sf_dir):
    return rounded(ve.pca(two_columns(spark, sf_dir), ["x", "y"]).spectrum(spark))


@query("pca_projection", "E4", on_company(
    "SELECT company_id, round((market_value/1e6-ma)*cos(t)+(it_spend/1e3-mb)*sin(t),4) AS pc1 FROM company CROSS JOIN (SELECT *, 0.5*atan2(2*c, a-b) AS t FROM m) z", EIGEN))
def _(spark, sf_dir):
    df = two_columns(spark, sf_dir)
    return rounded(ve.pca(df, ["x", "y"], 1).transform(df).select("company_id", "pc1"), 4)


@query("truncated_svd", "E5", on_company(
    "SELECT CAST(1 AS INT) AS component, round((cos(t)*cos(t)*a+2*cos(t)*sin(t)*c+sin(t)*sin(t)*b)/(a+b),6) AS explained FROM "
    "(SELECT *, 0.5*atan2(2*((n-1)*c+n*ma*mb), ((n-1)*a+n*ma*ma)-((n-1)*b+n*mb*mb)) AS t FROM m) z", EIGEN))
def _(spark, sf_dir):
    return rounded(ve.truncated_svd(two_columns(spark, sf_dir), ["x", "y"], 1).spectrum(spark))


@query("pca_of_vectors", "E4,W3")
def _(spark, sf_dir):
    df = embedded(spark, sf_dir)
    cols = [f"f{i}" for i in range(64)]
    wide = df.select("vec_id", *[F.col("features")[i].alias(c) for i, c in enumerate(cols)])
    return rounded(ve.pca(wide, cols, 20).keep(0.85).spectrum(spark))


@query("famd", "E6")
def _(spark, sf_dir):
    numeric = ["revenue", "market_value", "it_spend", "sites", "servers"]
    df = ps.impute(company(spark, sf_dir), numeric, ["entity_type", "ownership_type"])
    frame, projection = ve.famd(df, numeric, ["entity_type", "ownership_type"])
    return rounded(projection.transform(frame, "famd").select("company_id", *[f"famd{i + 1}" for i in range(len(projection.explained))]))


# --- K-Means -----------------------------------------------------------------------------------

def vectors(spark, sf_dir):
    return km.spread_out(points(spark, sf_dir).drop("cluster")).persist()


@query("kmeans", "C1,J2")
def _(spark, sf_dir):
    data = vectors(spark, sf_dir)
    return sg.cluster_sizes(km.predict(data, km.kmeans(data, 5))).select("cluster", "n", r("pct").alias("pct"))


@query("kmeans_of_vectors", "C1")
def _(spark, sf_dir):
    data = km.spread_out(embedded(spark, sf_dir)).persist()
    fit = km.kmeans(data, 10, n_init=STARTS, key="vec_id")
    found = km.predict(data, fit)
    return local_rows(spark, [(fit.inertia, va.adjusted_rand(found, "cluster", "label"))], "inertia double, ari_with_label double")


# --- single steps from fixed centres, which SQL can repeat ------------------------------------------

FIRST = [f"c0 AS (SELECT company_id AS j, {', '.join(VEC)} FROM pts ORDER BY company_id LIMIT 4)"]
GAP = "+".join(f"(p.{f}-c.{f})*(p.{f}-c.{f})" for f in VEC)


def nearest_sql(name: str, centres: str) -> str:
    return (f"{name} AS (SELECT * FROM (SELECT p.*, c.j, {GAP} AS gap, row_number() OVER (PARTITION BY p.company_id ORDER BY {GAP}, c.j) AS k "
            f"FROM pts p CROSS JOIN {centres} c) z WHERE k = 1)")


@query("lloyd_step", "C1,J2", on_company(
    "SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, any_value(c.f1), any_value(c.f2)) - 1 AS INT) AS cluster, count(*) AS n, "
    + ", ".join(f"round(any_value(c.{f}),6) AS {f}" for f in VEC) + ", round(avg(sqrt(gap)),6) AS spread, round(sum(sum(gap)) OVER (),4) AS inertia "
    "FROM a1 JOIN c1 c USING (j) GROUP BY j", POINTS, *FIRST, nearest_sql("a0", "c0"),
    "c1 AS (SELECT j, " + ", ".join(f"avg({f}) AS {f}" for f in VEC) + " FROM a0 GROUP BY j)", nearest_sql("a1", "c1")))
def _(spark, sf_dir):
    data = vectors(spark, sf_dir)
    start = np.array([row["features"] for row in data.orderBy("company_id").select("features").limit(4).collect()])
    fit = km.fit_many(data, [(0, start)], max_iter=1)[0]
    rows = [(i, int(n), *map(float, c), float(s), fit.inertia) for i, (n, c, s) in enumerate(zip(fit.n, fit.centres, fit.spread))]
    return rounded(local_rows(spark, rows, "cluster int, n long, " + ", ".join(f"{f} double" for f in VEC) + ", spread double, inertia double"),
                   skip=("inertia",)).withColumn("inertia", r("inertia", 4))


# One dimension, where a component is a plain normal distribution: market value in millions around fixed centres.
CENTRES = [0.0, 10.0, 100.0, 1000.0]


@query("mixture_step", "C6", on_company(
    "SELECT CAST(c AS INT) AS component, round(w,6) AS weight, round(m,4) AS mean, round(v,2) AS variance, round(l,2) AS loglik, round(-2*l+(3*k-1)*ln(n),2) AS bic "
    "FROM comp CROSS JOIN lik", "x AS (SELECT company_id, market_value/1e6 AS x FROM company WHERE market_value IS NOT NULL)",
    "dealt AS (SELECT x, CASE WHEN x <= 5 THEN 0 WHEN x <= 55 THEN 1 WHEN x <= 550 THEN 2 ELSE 3 END AS c FROM x)",
    "comp AS (SELECT c, count(*)*1.0::DOUBLE/sum(count(*)) OVER () AS w, avg(x) AS m, var_pop(x)+1e-6 AS v, count(*) OVER () AS k FROM dealt GROUP BY c)",
    "lik AS (SELECT sum(ln(p)) AS l, count(*) AS n FROM (SELECT company_id, sum(w*exp(-0.5*(x-m)*(x-m)/v)/sqrt(2*pi()*v)) AS p FROM x CROSS JOIN comp GROUP BY company_id) z)"))
def _(spark, sf_dir):
    data = km.spread_out(company(spark, sf_dir).where("market_value IS NOT NULL").select(
        "company_id", F.array(F.col("market_value") / 1e6).alias("features"))).persist()
    nearest = F.get(km.nearest([np.array(CENTRES)[:, None]], F.col("features")), F.lit(0)).alias("c")
    used = [row["c"] for row in data.select(nearest).distinct().orderBy("c").collect()]  # centres without rows are left out
    model = mx.mixture_at(data, np.array([CENTRES[i] for i in used])[:, None])
    rows = [(c, float(w), float(m[0]), float(v[0, 0]), model.loglik, model.bic()) for c, w, m, v in zip(used, model.weights, model.means, model.covariances)]
    return local_rows(spark, rows, "component int, weight double, mean double, variance double, loglik double, bic double").select(
        "component", r("weight").alias("weight"), r("mean", 4).alias("mean"), r("variance", 2).alias("variance"), r("loglik", 2).alias("loglik"), r("bic", 2).alias("bic"))


@query("k_sweep", "C2,T5")
def _(spark, sf_dir):
    metrics, _ = pl.k_sweep(vectors(spark, sf_dir), n_init=STARTS)
    return rounded(metrics)


@query("kmeans_grid", "C3")
def _(spark, sf_dir):
    grid, _ = pl.kmeans_grid(vectors(spark, sf_dir), n_init=STARTS)
    return rounded(grid)


@query("stability_centres", "V5")
def _(spark, sf_dir):
    data = vectors(spark, sf_dir)
    shift, stable = km.stability_centres(data, km.kmeans(data, 4, n_init=STARTS), n_init=STARTS)
    return local_rows(spark, [(shift, int(stable))], "mean_shift double, stable int")


@query("validation_gate", "V7,F36")
def _(spark, sf_dir):
    data = vectors(spark, sf_dir)
    score = va.silhouette(km.predict(data, km.kmeans(data, 3, n_init=STARTS))).score
    return local_rows(spark, [(score, int(va.validation_gate(score)))], "silhouette double, passed int")


@query("silhouette_estimate", "V1")
def _(spark, sf_dir):
    got = va.silhouette(points(spark, sf_dir), anchors=500)
    return local_rows(spark, [(got.score, got.stderr, got.rows)], "silhouette double, stderr double, anchors long")


# --- density --------------------------------------------------------------------------------------

DIST2 = "+".join(f"(a.{f}-b.{f})*(a.{f}-b.{f})" for f in VEC)
NEIGHBOURS = ("nb AS (SELECT a.company_id AS x, b.company_id AS y FROM pts a CROSS JOIN pts b WHERE " + DIST2 + " <= 0.12*0.12)",
              "cores AS (SELECT x FROM nb GROUP BY x HAVING count(*) >= 5)",
              "ce AS (SELECT x, y FROM nb WHERE x IN (SELECT x FROM cores) AND y IN (SELECT x FROM cores))")
DBSCAN_SQL = on_company(
    "SELECT p.company_id, CASE WHEN c.x IS NOT NULL THEN 1 ELSE 0 END AS core, CAST(coalesce(k.comp, b.comp, -1) AS BIGINT) AS cluster FROM pts p LEFT JOIN cores c ON c.x = p.company_id "
    "LEFT JOIN comp k ON k.x = p.company_id LEFT JOIN (SELECT nb.x, min(comp) AS comp FROM nb JOIN comp ON comp.x = nb.y GROUP BY nb.x) b ON b.x = p.company_id",
    POINTS, *NEIGHBOURS, "reach AS (SELECT x, x AS r FROM cores UNION SELECT ce.y, reach.r FROM reach JOIN ce ON ce.x = reach.x)",
    "comp AS (SELECT x, min(r) AS comp FROM reach GROUP BY x)").replace("WITH company AS", "WITH RECURSIVE company AS", 1)


@query("dbscan", "C4", DBSCAN_SQL)
def _(spark, sf_dir):
    return ds.dbscan(points(spark, sf_dir).drop("cluster"), eps=0.12, min_samples=5).select("company_id", "core", "cluster")


@query("dbscan_core_vectors", "C4", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nb AS (SELECT a.vec_id, count(*) AS n FROM v a CROSS JOIN v b WHERE list_sum(list_transform(range(1, 65), lambda i: (a.e[i]-b.e[i])*(a.e[i]-b.e[i]))) <= 0.8*0.8 GROUP BY a.vec_id)
SELECT vec_id, CASE WHEN n >= 5 THEN 1 ELSE 0 END AS core FROM nb""")
def _(spark, sf_dir):
    return ds.dbscan(embedded(spark, sf_dir), eps=0.8, min_samples=5, key="vec_id").select("vec_id", "core")


@query("core_distances", "C7", on_company(
    "SELECT company_id, round(sqrt(d), 6) AS core FROM (SELECT a.company_id, " + DIST2 + " AS d, row_number() OVER (PARTITION BY a.company_id ORDER BY " + DIST2 + ") AS k "
    "FROM pts a JOIN pts b ON a.company_id <> b.company_id) z WHERE k = 10", POINTS))
def _(spark, sf_dir):
    return rounded(dt.with_core_distance(points(spark, sf_dir).drop("cluster")).select("company_id", "core"))


@query("density_segments", "C7")
def _(spark, sf_dir):
    data = points(spark, sf_dir)
    return dt.density_segments(data, 25, epsilon=0.0, group="cluster").select("company_id", "cluster", "sub")


@query("hierarchical_density_segments", "C7")
def _(spark, sf_dir):
    out = pl.hierarchical_segments(vectors(spark, sf_dir), n_init=STARTS, sub="density")
    return out.select("company_id", "macro", "sub", "cluster")


# --- medoids and Gower --------------------------------------------------------------------------------

@query("gower_to_medoids", "J6", on_company(
    "SELECT company_id, CAST(list_position(g, list_min(g)) - 1 AS INT) AS cluster, round(g[1],6) AS d0, round(g[2],6) AS d1 FROM (SELECT c.company_id, list(("
    "abs(c.market_value-m.market_value)/rm + abs(c.sites-m.sites)/rs + CASE WHEN c.entity_type <> m.entity_type THEN 1 ELSE 0 END + CASE WHEN c.industry <> m.industry THEN 1 ELSE 0 END)/4 "
    "ORDER BY m.company_id) AS g FROM company c CROSS JOIN (SELECT * FROM company WHERE company_id IN (10, 20)) m CROSS JOIN (SELECT max(market_value)-min(market_value) AS rm, "
    "CAST(max(sites)-min(sites) AS DOUBLE) AS rs FROM company) x GROUP BY c.company_id) z"))
def _(spark, sf_dir):
    df = company(spark, sf_dir)
    numeric, categorical = ["market_value", "sites"], ["entity_type", "industry"]
    medoids = [row.asDict() for row in df.where(F.col("company_id").isin(10, 20)).select("company_id", *numeric, *categorical).orderBy("company_id").collect()]
    out = cs.gower_to_medoids(df, numeric, categorical, medoids)
    return rounded(out.select("company_id", "cluster", F.col("gower")[0].alias("d0"), F.col("gower")[1].alias("d1")))


def mixed(spark, sf_dir):
    data, weights = cs.coded_features(company(spark, sf_dir), ["market_value", "sites"], ["entity_type", "ownership_type", "industry"])
    return km.spread_out(data.select("company_id", "features")).persist(), weights


@query("kmedoids_gower", "C5")
def _(spark, sf_dir):
    data, weights = mixed(spark, sf_dir)
    k, _, scores = cs.best_medoids(data, weights, pl.grid_ks(data.count()))
    return local_rows(spark, [(i, s.score, int(i == k)) for i, s in scores.items()], "k int, silhouette double, chosen int")


@query("stability_ari", "V6")
def _(spark, sf_dir):
    data, weights = mixed(spark, sf_dir)
    runs = data
    fits = cs.kmedoids_by_seed(data, weights, [4], [42 + i for i in range(6)])
    for i in range(6):
        runs = cs.predict_medoids(runs, fits[4, 42 + i][0], weights, f"run{i}")
    mean, stable = cs.stability_ari(runs, [f"run{i}" for i in range(1, 6)], "run0")
    return local_rows(spark, [(mean, int(stable))], "mean_ari double, stable int")


# --- mixtures -------------------------------------------------------------------------------------------

@query("gmm_bic", "C6")
def _(spark, sf_dir):
    _, bics = mx.gmm_bic(vectors(spark, sf_dir), [3, 4, 5, 6, 7], n_init=STARTS)
    best = min(bics, key=bics.get)
    return local_rows(spark, [(k, v, int(k == best)) for k, v in bics.items()], "k int, bic double, chosen int")


@query("gmm_labels", "C6")
def _(spark, sf_dir):
    data = vectors(spark, sf_dir)
    model, _ = mx.gmm_bic(data, [4], n_init=STARTS)
    return mx.predict_mixture(data, model).select("company_id", "cluster", r("confidence").alias("confidence"))


@query("hierarchical_segments", "C7")
def _(spark, sf_dir):
    return pl.hierarchical_segments(vectors(spark, sf_dir), n_init=STARTS).select("company_id", "macro", "sub", "cluster")


# --- consensus -----------------------------------------------------------------------------------------------

RUNS = "runs AS (SELECT company_id, CAST(company_id % 4 AS INT) AS a, CAST(sites // 12 AS INT) AS b, CAST(servers // 8 AS INT) AS c FROM company)"


def runs(spark, sf_dir):
    return company(spark, sf_dir).select(
        "company_id", (F.col("company_id") % 4).cast("int").alias("a"), F.floor(F.col("sites") / 12).cast("int").alias("b"),
        F.floor(F.col("servers") / 8).cast("int").alias("c"))


@query("coassociation", "J5", on_company(
    "SELECT x.a || '/' || x.b || '/' || x.c AS signature, y.a || '/' || y.b || '/' || y.c AS other, round(((x.a=y.a)::INT+(x.b=y.b)::INT+(x.c=y.c)::INT)/3.0::DOUBLE,6) AS share FROM "
    "(SELECT DISTINCT a, b, c FROM runs) x CROSS JOIN (SELECT DISTINCT a, b, c FROM runs) y WHERE x.a=y.a OR x.b=y.b OR x.c=y.c", RUNS))
def _(spark, sf_dir):
    out = cs.coassociation(cs.signatures(runs(spark, sf_dir), ["a", "b", "c"]), 3)
    return rounded(out.select(F.array_join("signature", "/").alias("signature"), F.array_join("other", "/").alias("other"), "share"))


@query("consensus_of_labels", "C8,J5")
def _(spark, sf_dir):
    done = cs.consensus_of(runs(spark, sf_dir), ["a", "b", "c"], 4)
    return done.labelled.select("company_id", "cluster", F.lit(round(done.mean_ari, 6)).alias("mean_ari"))


# Every renaming of three labels against the first run; the one that agrees on most rows.
VOTE_RUNS = ("v AS (SELECT company_id, CAST(company_id % 3 AS INT) AS a, CAST((company_id % 3 + (CASE WHEN sites % 5 = 0 THEN 2 ELSE 1 END)) % 3 AS INT) AS b, "
             "CAST(2 - (company_id + (CASE WHEN servers % 4 = 0 THEN 1 ELSE 0 END)) % 3 AS INT) AS c FROM company)")
PERMUTATIONS = "perm AS (SELECT * FROM (VALUES ([0,1,2]),([0,2,1]),([1,0,2]),([1,2,0]),([2,0,1]),([2,1,0])) t(p))"


def best_renaming(run):
    return f"best_{run} AS (SELECT arg_max(p, agree) AS p FROM (SELECT p, count(*) FILTER (WHERE p[{run} + 1] = a) AS agree FROM v CROSS JOIN perm GROUP BY p) z)"


@query("majority_vote", "C8", on_company(
    "SELECT company_id, CAST(CASE WHEN b = c THEN b ELSE CASE WHEN a = b OR a = c THEN a ELSE least(a, b, c) END END AS INT) AS cluster FROM "
    "(SELECT company_id, a, best_b.p[b + 1] AS b, best_c.p[c + 1] AS c FROM v CROSS JOIN best_b CROSS JOIN best_c) w", VOTE_RUNS, PERMUTATIONS, best_renaming("b"), best_renaming("c")))
def _(spark, sf_dir):
    k = F.col("company_id")
    df = company(spark, sf_dir).select(
        "company_id", (k % 3).cast("int").alias("a"), ((k % 3 + F.when(F.col("sites") % 5 == 0, 2).otherwise(1)) % 3).cast("int").alias("b"),
        (2 - (k + F.when(F.col("servers") % 4 == 0, 1).otherwise(0)) % 3).cast("int").alias("c"))
    return cs.majority_vote(df, ["a", "b", "c"]).select("company_id", "cluster")


@query("consensus", "C8")
def _(spark, sf_dir):
    done = cs.consensus(vectors(spark, sf_dir))
    return sg.cluster_sizes(done.labelled).select("cluster", "n", F.lit(round(done.mean_ari, 6)).alias("mean_ari"))


# --- two tiers ----------------------------------------------------------------------------------------------------

def tier_data(spark, sf_dir):
    df = engineered(spark, sf_dir)
    cols = ["revenue_log", "tech_intensity_log", "technology_density", "employees_per_site"]
    return km.spread_out(ve.robust_scaler(df, cols).vector(df)).persist()


@query("two_tier", "C10,A19,A21,F33")
def _(spark, sf_dir):
    tiers = pl.two_tier(tier_data(spark, sf_dir), n_init=STARTS)
    out = tiers.labelled.select("company_id", "cluster")
    if tiers.refined is None:
        return out.withColumn("sub", F.lit(None).cast("int"))
    return out.join(tiers.refined.select("company_id", "sub"), "company_id", "left")


@query("recluster_mega", "C9,F35")
def _(spark, sf_dir):
    data = tier_data(spark, sf_dir).withColumn("cluster", F.when(F.col("technology_density") < 0.05, 0).otherwise(1))
    refined, _ = pl.recluster_mega(data, 0, n_init=STARTS)
    return refined.select("company_id", "sub", r("sub_confidence").alias("sub_confidence"), "sub_name")
