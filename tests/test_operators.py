"""Operators against brute force and invariants on small inputs derived from the tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.catalog import REGISTRY
from firmlens.functions.clean import require_target
from firmlens.operators import consensus as cs
from firmlens.operators import density as ds
from firmlens.operators import features as ft
from firmlens.operators import kmeans as km
from firmlens.operators import mixture as mx
from firmlens.operators import models as md
from firmlens.operators import profile_stats as ps
from firmlens.operators import segments as sg
from firmlens.operators import significance as sig
from firmlens.operators import validate as va
from firmlens.operators import vectors as ve
from firmlens.operators.quantiles import quantiles
from firmlens.plans import pipelines as pl
from firmlens.session import cut_lineage, lookup_join
from firmlens.sources.files import read_companies

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def blobs(spark):
    """Four tight groups of different sizes around the corners of a square, keyed by supplier and part rows."""
    ids = spark.read.parquet(f"{SMALL}/orders.parquet").select(F.col("o_orderkey").alias("company_id")).distinct().limit(400)
    g = F.when(F.pmod(F.xxhash64("company_id"), F.lit(10)) < 4, 0).when(F.pmod(F.xxhash64("company_id"), F.lit(10)) < 7, 1).when(
        F.pmod(F.xxhash64("company_id"), F.lit(10)) < 9, 2).otherwise(3)
    noise = [(F.pmod(F.xxhash64("company_id", F.lit(s)), F.lit(1000)) / 1000.0 - 0.5) * 0.6 for s in (1, 2)]
    df = ids.withColumn("truth", g).withColumn(
        "features", F.array((F.col("truth") % 2) * 5 + noise[0], F.floor(F.col("truth") / 2) * 5 + noise[1]))
    return cut_lineage(df)


# --- quantiles ---------------------------------------------------------------------------------

@pytest.mark.parametrize("by", [None, "industry"])
@pytest.mark.parametrize("limit", [2, 20])
def test_narrowed_quantiles_are_exact(companies, by, limit):
    cols, probs = ["revenue", "sites"], [0.0, 0.01, 0.5, 0.77, 1.0]
    plain, narrowed = quantiles(companies, cols, probs, by), quantiles(companies, cols, probs, by, histogram_rows=limit)
    assert plain.keys() == narrowed.keys()
    for g, c in itertools.product(plain, cols):
        assert narrowed[g][c] == pytest.approx(plain[g][c], rel=1e-12)


def test_narrowed_quantiles_with_a_hot_value(companies):
    skewed = companies.select(F.when(F.col("company_id") % 3 > 0, 7.0).otherwise(F.col("revenue")).alias("x"))
    assert quantiles(skewed, ["x"], [0.1, 0.5, 0.9], histogram_rows=3)[None]["x"] == pytest.approx(quantiles(skewed, ["x"], [0.1, 0.5, 0.9])[None]["x"])


def test_quantiles_of_nothing(companies):
    empty = companies.select(F.lit(None).cast("double").alias("x"))
    assert quantiles(empty, ["x"], [0.5])[None]["x"] == [None]


# --- joins ---------------------------------------------------------------------------------------

def test_salted_lookup_equals_broadcast(companies):
    totals = companies.groupBy("industry").agg(F.count("*").alias("n"))
    small = lookup_join(companies.select("company_id", "industry"), totals, ["industry"])
    large = lookup_join(companies.select("company_id", "industry"), totals, ["industry"], max_broadcast_rows=1)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.select(*small.columns).collect()))


def test_zscore_of_a_single_row_group_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "industry string, x double")
    got = {(r["industry"], r["x"]): r["x_industry_zscore"] for r in ps.group_zscore(df, ["x"], "industry").collect()}
    assert got["a", 1.0] == 0.0 and got["b", 4.0] == pytest.approx(1 / math.sqrt(2))


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), (None,)], "v string")
    assert ps.modes(df, ["v"]).first()["mode"] == "a"


def test_constant_column_is_left_alone(companies):
    df = companies.withColumn("constant", F.lit(3.0))
    capped, report = ps.handle_outliers_iqr(df, ["revenue", "constant"])
    assert {r["feature"] for r in report.collect()} == {"revenue"}
    assert capped.select("constant").distinct().count() == 1
    assert ps.correlation_matrix(df, ["revenue", "constant"]).where("feature_a = 'constant' AND corr IS NOT NULL").isEmpty()


def test_cluster_vs_rest_threshold(spark):
    rows = [(0, 110.0, 111.0), (1, 100.0, 100.0)]
    df = spark.createDataFrame(rows, "cluster int, a double, b double")
    got = {(r["cluster"], r["feature"]): r["difference_pct"] for r in sg.cluster_vs_rest(df, ["a", "b"]).collect()}
    assert (0, "a") not in got and got[0, "b"] == pytest.approx(11.0)


def test_mega_share_of_exactly_forty_percent(spark):
    df = spark.createDataFrame([(c,) for c in [0, 0, 1, 2, 3]], "cluster int")
    assert sg.mega_cluster_ids(df) == [0]


def test_gap_thresholds(spark):
    rows = [(1, 75.0), (2, 74.0), (3, 100.0), (4, 100.0), (5, 100.0)]
    df = spark.createDataFrame([(s, v, 1.0) for s, v in rows], "sub int, it_spend double, revenue_per_emp double")
    got = {r["segment"]: r["opportunity_value"] for r in sg.gap_analysis(df).collect()}
    assert got == {"2": pytest.approx(26.0)}


def test_few_target_rows_are_refused(companies):
    with pytest.raises(ValueError):
        require_target(companies.limit(5), "market_value")


def test_empty_input_is_an_error(spark, companies, tmp_path):
    companies.limit(0).write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        read_companies(spark, str(tmp_path / "none"))


def test_single_pvalue_is_not_adjusted(spark):
    one = spark.createDataFrame([("a", 0.03)], "feature string, p double")
    for method in ("bonferroni", "bh", "by"):
        assert sig.adjust_pvalues(one, method).first()["p_adjusted"] == pytest.approx(0.03)


# --- vectors ---------------------------------------------------------------------------------------

def test_vif_of_a_duplicate_is_infinite(companies):
    df = companies.withColumn("twin", F.col("market_value") * 2 + 1)
    cols = ["market_value", "twin", "sites"]
    m = ve.moments(df, cols)
    assert np.isinf(ve.vif(m.corr)[:2]).all()
    kept = ve.vif_prune(df, cols)
    assert len(kept) == 2 and (ve.vif(ve.moments(df, kept).corr) <= 10).all()


def test_moments_match_numpy(companies):
    cols = ["market_value", "it_spend", "sites"]
    x = np.array([tuple(r) for r in companies.select(*cols).collect()], dtype=float)
    m = ve.moments(companies, cols)
    assert m.n == len(x)
    assert m.cov == pytest.approx(np.cov(x.T), rel=1e-9)


def test_pca_projection_is_centred_and_uncorrelated(companies):
    cols = ["market_value", "it_spend", "sites"]
    scaled = ve.standard_scaler(companies, cols).transform(companies)
    fit = ve.pca(scaled, cols)
    x = np.array([tuple(r) for r in fit.transform(scaled).select("pc1", "pc2", "pc3").collect()])
    assert x.mean(axis=0) == pytest.approx(np.zeros(3), abs=1e-9)
    cov = np.cov(x.T)
    assert cov - np.diag(np.diag(cov)) == pytest.approx(np.zeros((3, 3)), abs=1e-9)
    assert np.diag(cov) / np.trace(cov) == pytest.approx(fit.explained, rel=1e-9)
    assert fit.explained.sum() == pytest.approx(1.0)


def test_svd_matches_numpy(companies):
    cols = ["market_value", "it_spend", "sites"]
    x = np.array([tuple(r) for r in companies.select(*cols).collect()], dtype=float)
    fit = ve.truncated_svd(companies, cols, 2)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert np.abs(vt[:2] @ fit.components) == pytest.approx(np.eye(2), abs=1e-6)


def test_famd_numbers_only_equals_pca(companies):
    cols = ["market_value", "it_spend", "sites", "servers"]
    _, fit = ve.famd(companies, cols, [])
    plain = ve.pca(ve.standard_scaler(companies, cols).transform(companies), cols, 3).keep(0.85)
    assert fit.explained == pytest.approx(plain.explained, rel=1e-9)


# --- silhouette ------------------------------------------------------------------------------------------

def brute_silhouette(x, labels):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() < 2:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_silhouette_paths(blobs, monkeypatch):
    rows = blobs.select("features", "truth").collect()
    want = brute_silhouette(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])).mean()
    monkeypatch.setattr(va, "TILE_ROWS", 70)
    exact = va.silhouette(blobs, "truth", anchors=None)
    assert exact.exact and exact.score == pytest.approx(want, abs=1e-9)
    every = va.silhouette(blobs, "truth", anchors=10_000)
    assert every.score == pytest.approx(want, abs=1e-9)
    some = va.silhouette(blobs, "truth", anchors=100)
    assert abs(some.score - want) < 5 * some.stderr + 1e-9


def test_centroid_scores_match_brute_force(blobs):
    rows = blobs.select("features", "truth").collect()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    centres = np.array([x[y == c].mean(axis=0) for c in range(4)])
    spread = np.array([np.linalg.norm(x[y == c] - centres[c], axis=1).mean() for c in range(4)])
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(4) if j != i) for i in range(4)]
    assert va.davies_bouldin(blobs, "truth") == pytest.approx(np.mean(worst))


def test_adjusted_rand_bounds(blobs):
    assert va.adjusted_rand(blobs, "truth", "truth") == 1.0
    mixed = blobs.withColumn("other", F.pmod(F.xxhash64("company_id", F.lit(9)), F.lit(4)))
    assert abs(va.adjusted_rand(mixed, "truth", "other")) < 0.05


def test_validation_gate():
    assert va.validation_gate(0.51) and not va.validation_gate(0.5)
    with pytest.raises(ValueError):
        va.validation_gate(0.4, strict=True)


# --- clustering ----------------------------------------------------------------------------------------------

def test_kmeans_finds_the_blobs(blobs):
    fit = km.kmeans(blobs, 4)
    found = km.predict(blobs, fit)
    assert va.adjusted_rand(found, "truth", "cluster") == 1.0
    sizes = [r["n"] for r in sg.cluster_sizes(found).orderBy("cluster").collect()]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) == 400 and sizes == list(fit.n)
    shift, stable = km.stability_centres(blobs, fit, refits=3, n_init=3)
    assert stable and shift < 0.05


def test_kmeans_is_a_fixed_point_and_partitioning_does_not_matter(blobs):
    one, eight = km.kmeans(blobs.coalesce(1), 5, n_init=3), km.kmeans(blobs.repartition(8), 5, n_init=3)
    assert one.inertia == pytest.approx(eight.inertia, rel=1e-9)
    x = np.array([r[0] for r in blobs.select("features").collect()])
    label = ((x[:, None] - one.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert one.inertia == pytest.approx(((x - one.centres[label]) ** 2).sum(), rel=1e-9)


def test_partials_add_up_either_way(blobs, monkeypatch):
    few = km.kmeans(blobs, 3, n_init=2)
    monkeypatch.setattr(km, "FEW_PARTITIONS", 0)
    many = km.kmeans(blobs, 3, n_init=2)
    assert few.centres == pytest.approx(many.centres)


def test_inertia_falls_with_k(blobs):
    metrics, fits = pl.k_sweep(blobs.persist(), max_k=5, n_init=5)
    rows = metrics.orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 3, 4, 5, 6]
    assert all(a["inertia"] >= b["inertia"] for a, b in zip(rows, rows[1:]))
    assert max(rows, key=lambda r: r["silhouette"])["k"] == 4
    labelled = km.predict(blobs, fits[4])
    assert rows[2]["davies_bouldin"] == pytest.approx(va.davies_bouldin(labelled), rel=1e-3)


def test_mixture_bic_picks_the_blobs(blobs):
    model, bics = mx.gmm_bic(blobs, [2, 3, 4], n_init=3)
    assert model.k == 4 and min(bics, key=bics.get) == 4
    found = mx.predict_mixture(blobs, model)
    assert va.adjusted_rand(found, "truth", "cluster") == 1.0
    assert found.where("confidence < 0.9 OR confidence > 1.0000001").isEmpty()
    # Likelihood and BIC from the parts.
    x = np.array([r[0] for r in blobs.select("features").collect()])
    total = 0.0
    for row in x:
        total += math.log(sum(
            w * math.exp(-0.5 * (row - m) @ np.linalg.solve(c, row - m)) / (2 * math.pi * math.sqrt(np.linalg.det(c)))
            for w, m, c in zip(model.weights, model.means, model.covariances)))
    assert model.loglik == pytest.approx(total, rel=1e-8)
    assert model.bic() == pytest.approx(-2 * total + (3 + 8 + 12) * math.log(400), rel=1e-8)


def brute_dbscan(ids, x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    comp = {i: ids[i] for i in np.nonzero(core)[0]}
    changed = True
    while changed:
        changed = False
        for i in comp:
            low = min(comp[j] for j in np.nonzero(near[i] & core)[0])
            if low < comp[i]:
                comp[i], changed = low, True
    return {ids[i]: comp[i] if core[i] else min((comp[j] for j in np.nonzero(near[i] & core)[0]), default=-1) for i in range(len(x))}


@pytest.mark.parametrize("block_rows", [30, 2048])
def test_dbscan_matches_brute_force_with_hot_cells(blobs, block_rows):
    # A third of the rows share one point, and cells are cut into several blocks.
    hot = blobs.withColumn("features", F.when(F.col("company_id") % 3 == 0, F.array(F.lit(0.05), F.lit(0.05))).otherwise(F.col("features")))
    rows = hot.select("company_id", "features").collect()
    want = brute_dbscan([r[0] for r in rows], np.array([r[1] for r in rows]), 0.08, 5)
    got = {r["company_id"]: r["cluster"] for r in ds.dbscan(hot, 0.08, 5, block_rows=block_rows).collect()}
    assert got == want and -1 in got.values()


def test_medoids_recover_mixed_groups(blobs):
    df = blobs.withColumn("kind", F.when(F.col("truth") < 2, "a").otherwise("b")).withColumn("x", F.col("features")[0])
    data, weights = cs.coded_features(df.drop("features"), ["x"], ["kind"])
    k, medoids, scores = cs.best_medoids(data, weights, [2, 3, 4])
    assert k == 4
    found = cs.predict_medoids(data, medoids, weights)
    assert va.adjusted_rand(found, "truth", "cluster") == 1.0
    assert all(-1 <= s.score <= 1 for s in scores.values())


@pytest.fixture(scope="module")
def mixed_rows(spark):
    """Mixed rows: two numbers with a hot value and ties, a constant number, two categories; three labellings."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(500):
        x = [float(np.round(rng.normal(), 2)), 4.0 if i % 3 == 0 else float(rng.integers(0, 30)), 7.0, float(rng.integers(1, 4)), float(rng.integers(1, 8))]
        rows.append((i, x, int(rng.integers(0, 4)), i % 2, 0 if i else 5))
    return spark.createDataFrame(rows, "company_id long, features array<double>, a int, b int, c int").repartition(5).persist()


def test_mixed_silhouette_equals_the_pairwise_one(mixed_rows, monkeypatch):
    from firmlens.operators import separable

    weights = np.array([0.3, 1 / 30, 0.0])
    pairs = va.silhouettes(mixed_rows, ["a", "b", "c"], distance=va._gower(weights, 3))
    for most in (200_000, 60):
        monkeypatch.setattr(separable, "RANGE_VALUES", most)
        got = va.silhouettes(mixed_rows, ["a", "b", "c"], gower_weights=weights)
        assert [s.score for s in got] == pytest.approx([s.score for s in pairs], abs=1e-9) and [s.rows for s in got] == [500] * 3
    only = np.array([0.3, 1 / 30, 0.5, 1.0, 1.0])
    got = va.silhouettes(mixed_rows, ["a"], gower_weights=only)[0].score
    assert got == pytest.approx(va.silhouettes(mixed_rows, ["a"], distance=va._gower(only, 5))[0].score, abs=1e-9)
    codes = mixed_rows.withColumn("features", F.slice("features", 4, 2))
    got = va.silhouettes(codes, ["a"], gower_weights=np.zeros(0))[0].score
    assert got == pytest.approx(va.silhouettes(codes, ["a"], distance=va._gower(np.zeros(0), 0))[0].score, abs=1e-9)


def test_mixed_sums_form_no_pairs(mixed_rows):
    from firmlens.operators.separable import cluster_sums

    base = mixed_rows.select(F.col("company_id").alias("id"), F.col("features").alias("x"), F.array("b").alias("codes"))
    plan = cluster_sums(base, np.array([1.0, 1.0, 1.0]), [np.array([250.0, 250.0])])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_swap_changes_are_those_of_the_swapped_medoids():
    rng = np.random.default_rng(1)
    gaps, rows = rng.random((80, 9)), rng.integers(1, 5, 80).astype(float)
    for medoids in ([3], [0, 4], [1, 5, 8]):
        before = (gaps[:, medoids].min(axis=1) * rows).sum()
        change = cs._swap_changes(gaps, np.array(medoids), rows)
        for m in range(len(medoids)):
            for x in range(9):
                after = medoids[:m] + [x] + medoids[m + 1:]
                assert before + change[m, x] == pytest.approx((gaps[:, after].min(axis=1) * rows).sum())


def test_medoids_are_the_best_members(companies, monkeypatch):
    """Each medoid has the smallest summed distance in its cluster, also with hot copies."""
    hot = companies.withColumn("sites", F.when(F.col("company_id") % 3 == 0, 4).otherwise(F.col("sites")))
    data, weights = cs.coded_features(hot, ["market_value", "sites"], ["entity_type", "industry"])
    data = data.select("company_id", "features").persist()
    x = np.array([r[0] for r in data.select("features").collect()])
    distance = va._gower(weights, 2)
    for k, (medoids, cost) in cs.kmedoids_gower(data, weights, [2, 4]).items():
        gaps = distance(x, medoids)
        label = gaps.argmin(axis=1)
        assert cost == pytest.approx(gaps.min(axis=1).sum(), rel=1e-6)
        for c in range(k):
            members = x[label == c]
            sums = distance(members, members).sum(axis=0)
            assert distance(members, medoids[c:c + 1]).sum() == pytest.approx(sums.min(), rel=1e-9)


def test_consensus_of_agreeing_runs(blobs):
    runs = blobs.withColumns({
        "a": F.col("truth").cast("int"), "b": (3 - F.col("truth")).cast("int"),
        "c": F.when(F.col("company_id") % 50 == 0, 0).otherwise(F.col("truth")).cast("int")})
    done = cs.consensus_of(runs, ["a", "b", "c"], 4)
    assert va.adjusted_rand(done.labelled, "truth", "cluster") == 1.0 and done.mean_ari > 0.9
    assert done.n_signatures > 4


def brute_linkage(labels, weights, k):
    """Merge the pair with the least (average distance, lower, higher number) until ``k`` groups are left."""
    groups = {i: [i] for i in range(len(labels))}
    apart = (labels[:, None] != labels[None]).mean(axis=2)

    def gap(a, b):
        w = weights[groups[a]][:, None] * weights[groups[b]][None]
        return round(float((apart[np.ix_(groups[a], groups[b])] * w).sum() / w.sum()), 11)

    gaps = {(a, b): gap(a, b) for a, b in itertools.combinations(groups, 2)}
    while len(groups) > k:
        i, j = min(gaps, key=lambda p: (gaps[p], p))
        groups[i] += groups.pop(j)
        gaps = {p: d for p, d in gaps.items() if not {i, j} & set(p)}
        gaps |= {(min(i, x), max(i, x)): gap(min(i, x), max(i, x)) for x in groups if x != i}
    order = sorted(groups, key=lambda g: (-weights[groups[g]].sum(), g))
    return {tuple(labels[i].tolist()): c for c, g in enumerate(order) for i in groups[g]}


@pytest.mark.parametrize(("last", "k"), [(1000, 5), (20, 5), (2, 3), (1, 1)])
def test_average_linkage_in_rounds_matches_brute_force(spark, last, k, monkeypatch):
    rng = np.random.default_rng(5)
    labels = np.unique(rng.integers(0, 3, size=(120, 6)) * (rng.random((120, 6)) < 0.8), axis=0)
    weights = rng.integers(1, 9, size=len(labels))
    monkeypatch.setattr(cs, "LINK_ROWS", 30)
    frame = spark.createDataFrame([([int(v) for v in row], int(w)) for row, w in zip(labels, weights)], "signature array<int>, n long").repartition(3)
    got = {tuple(r.signature): r.cluster for r in cs.average_linkage(frame, 6, k, last).collect()}
    assert got == brute_linkage(labels, weights, k)


def test_best_assignment_is_the_best_permutation():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 4), (2, 5), (5, 3), (5, 5)):
        for _ in range(20):
            gain = rng.integers(0, 9, (n, m)).astype(float)
            got = cs.best_assignment(gain)
            used = [j for j in got if j >= 0]
            assert len(used) == len(set(used)) == min(n, m)
            wide = np.zeros((max(n, m), max(n, m)))
            wide[:n, :m] = gain
            best = max(sum(wide[i, p[i]] for i in range(len(p))) for p in itertools.permutations(range(max(n, m))))
            assert sum(gain[i, j] for i, j in enumerate(got) if j >= 0) == best


def test_majority_vote_aligns_labels(spark):
    truth = [i % 3 for i in range(60)]
    rows = [(i, t, (t + 1) % 3, 5 - t if i % 10 else 3, None if i == 7 else [2, 0, 1][t]) for i, t in enumerate(truth)]
    df = spark.createDataFrame(rows + [(60, None, None, None, None)], "company_id long, a int, b int, c int, d int")
    got = {r.company_id: r.cluster for r in cs.majority_vote(df, ["a", "b", "c", "d"]).collect()}
    assert got == {**dict(enumerate(truth)), 60: None}
    plain = {r.company_id: r.cluster for r in cs.majority_vote(df, ["a", "b"], align=False).collect()}
    assert all(plain[i] == min(t, (t + 1) % 3) for i, t in enumerate(truth))


def test_hierarchical_segments_cover_all_rows(blobs):
    out = pl.hierarchical_segments(blobs.persist(), ks=(3, 4), min_size=60, n_init=3)
    assert out.count() == 400 and out.where("cluster IS NULL OR cluster < 0").isEmpty()
    assert out.groupBy("cluster").agg(F.count_distinct("macro", "sub").alias("n")).where("n <> 1").isEmpty()


# --- models -----------------------------------------------------------------------------------------------------

FEATURES = ["it_spend", "sites", "servers"]


def test_split_is_stratified_and_repeatable(companies):
    df = companies.withColumn("cluster", (F.col("company_id") % 3).cast("int"))
    one = md.split(df.coalesce(1), stratify="cluster").where("is_test").select("company_id")
    two = md.split(df.repartition(8), stratify="cluster").where("is_test").select("company_id")
    assert {r[0] for r in one.collect()} == {r[0] for r in two.collect()}
    shares = md.split(df, stratify="cluster").groupBy("cluster").agg(F.avg(F.col("is_test").cast("double")).alias("s"))
    assert all(abs(r["s"] - 0.2) < 0.03 for r in shares.collect())


@pytest.mark.parametrize("kind", ["ridge", "none"])
def test_linear_matches_closed_form(companies, kind):
    x = np.array([tuple(r) for r in companies.select(*FEATURES, "market_value").collect()], dtype=float)
    z, y = (x[:, :3] - x[:, :3].mean(axis=0)) / x[:, :3].std(axis=0), x[:, 3]
    alpha = 7.0 if kind == "ridge" else 0.0
    want = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
    model = md.fit_linear(companies, FEATURES, "market_value", kind, alpha)
    assert model.model.coefficients.toArray() == pytest.approx(want, rel=1e-5)


def test_logistic_gradient_is_zero(companies):
    df = companies.withColumn("cluster", F.pmod(F.col("pcs"), F.lit(3)).cast("int") + F.floor(F.col("pcs") / 60).cast("int"))
    model = md.fit_logistic(df, ["it_spend", "pcs", "laptops"])
    rows = df.select("it_spend", "pcs", "laptops", "cluster").collect()
    x = np.array([tuple(r)[:3] for r in rows], dtype=float)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w, b = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    logits = z @ w.T + b
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    onehot = np.array([[r["cluster"] == c for c in model.labels] for r in rows], dtype=float)
    gradient = (p - onehot).T @ z / len(z) + w / len(z)
    assert np.abs(gradient).max() < 5e-3
    assert md.accuracy(model.predict(df)) > 0.4


def test_target_never_among_features(companies):
    df = companies.withColumn("revenue_copy", F.col("revenue") * 3)
    kept = md.exclude_leaky(df, ["revenue", "revenue_copy", "it_spend", "market_value", "sites"], "revenue")
    assert "revenue" not in kept and "revenue_copy" not in kept and "it_spend" not in kept and "sites" in kept


def test_new_rows_get_the_fitted_segment(companies):
    prepared = pl.preprocess(companies, 2026)
    assert len(prepared.names) == len(prepared.frame.select("features").first()[0])
    fit = km.kmeans(prepared.frame.persist(), 3, n_init=2)
    want = {r[0]: r[1] for r in km.predict(prepared.frame, fit).select("company_id", "cluster").collect()}
    part = companies.where("company_id < 20")
    got = {r[0]: r[1] for r in pl.assign_segment(part, prepared, fit, 2026).select("company_id", "cluster").collect()}
    assert got == {k: v for k, v in want.items() if k < 20}


def test_queries_use_text_and_the_whole_grid(spark, monkeypatch):
    seen = []
    fit, assign = km.kmeans, pl.assign_segment
    monkeypatch.setattr(km, "kmeans", lambda data, k, *a, **b: seen.append(len(data.select("features").first()[0])) or fit(data, k, *a, **b))
    monkeypatch.setattr(pl, "assign_segment", lambda df, prepared, *a: seen.append(len(prepared.names) if prepared.tfidf else 0) or assign(df, prepared, *a))
    REGISTRY["assign_segment"].run(spark, SMALL)
    assert seen[0] == seen[1] > 9
    monkeypatch.setattr(pl, "grid_ks", lambda n: [2, 6])
    assert sorted(r.k for r in REGISTRY["kmedoids_gower"].run(spark, SMALL).collect()) == [2, 6]


def test_pipelines_report(companies):
    table = ft.derived_metrics(companies, 2026)
    report = pl.run_standard(table, n_init=1).report
    assert report.columns == ["section", "subject", "metric", "value"]
    sections = {r[0] for r in report.select("section").distinct().collect()}
    assert {"grid", "choice", "sizes", "profile", "importance"} <= sections


# --- constants, nulls, texts ----------------------------------------------------------------


def test_constant_columns_over_partition_counts(spark):
    rows = [(i, 7.0, 0.1 + 0.2, float(i % 3), None if i % 2 else 5.0, "a" if i % 2 else "b") for i in range(150)]
    df = spark.createDataFrame(rows, "company_id long, c double, d double, v double, n double, g string")
    for parts in (1, 4, 16):
        split = df.repartition(parts)
        assert ps.varying_columns(split, ["c", "d", "v", "n"]) == ["v"]
        assert ps.drop_zero_variance(split, ["c", "d", "v"]).columns == ["company_id", "v", "n", "g"]
        scores = ps.group_zscore(split, ["c", "v"], "g").agg(F.max(F.abs("c_g_zscore")), F.max(F.abs("v_g_zscore"))).first()
        assert scores[0] == 0 and scores[1] > 0.5
        scaler = ve.standard_scaler(split, ["c", "v"])
        assert scaler.scale[0] == 1.0 and scaler.scale[1] > 0.5
    assert ps.varying_columns(df.limit(0), ["c"]) == [] and ps.varying_columns(df, []) == []


def test_vector_statistics_leave_incomplete_rows_out(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    rows = [(float(a), float(b), float(c)) for a, b, c in x]
    holes = [(None, 1.0, 2.0), (float("nan"), 50.0, 1.0), (3.0, None, None)]
    full, holed = (spark.createDataFrame(r, "a double, b double, c double") for r in (rows, rows + holes))
    for fit in (lambda d: ve.moments(d, ["a", "b", "c"]).cov, lambda d: ve.pca(d, ["a", "b", "c"]).components, lambda d: ve.truncated_svd(d, ["a", "b", "c"], 2).components):
        np.testing.assert_allclose(fit(full), fit(holed), atol=1e-9)


def test_silhouette_copies_a_row_a_bounded_number_of_times(blobs, monkeypatch):
    # 900 000 rows of four numbers and four clusters were copied 880 times, once for each of two sides of 440 tiles.
    for rows, values in ((900_000, 8), (5_400_000, 8), (900_000, 4 + 65)):
        assert sum(va._tiling(rows, values, 12)) <= 48
    want = va.silhouette(blobs, "truth").score
    monkeypatch.setattr(va, "TILE_BYTES", 8 * 6 * 10)
    monkeypatch.setattr(va, "BLOCK", (3, 7))
    assert va.silhouette(blobs, "truth").score == pytest.approx(want, abs=1e-12)


def test_silhouette_skips_rows_without_a_label(blobs):
    some = blobs.withColumn("truth", F.when(F.col("company_id") % 7 != 0, F.col("truth")))
    assert va.silhouette(some, "truth").score == pytest.approx(va.silhouette(some.dropna(), "truth").score)


def test_rand_index_needs_no_cells_on_the_driver(spark):
    rows = [(i, i // 2, i // 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "company_id long, a long, b long")
    pairs = sum(1 for i in range(2999) for j in (i + 1,) if i // 2 == j // 2 and i // 3 == j // 3)
    a, b, n = 1500, 1000 * 3, 3000 * 2999 / 2
    expected = a * b / n
    assert va.adjusted_rand(df, "a", "b") == pytest.approx((pairs - expected) / ((a + b) / 2 - expected))


def test_first_look_at_text_numbers(spark):
    from firmlens.plans.explore import explore

    rows = [("1 to 10", "12.5", "HQ"), ("n/a", "x", "Branch"), ("11-50", None, "HQ")]
    df = spark.createDataFrame(rows, "employees string, revenue string, entity_type string")
    got = {(r.section, r.subject, r.metric): r.value for r in explore(df).collect()}
    assert got["missing", "employees", "count"] == 1 and got["missing", "revenue", "count"] == 2
    assert got["describe", "employees", "mean"] == pytest.approx((5.5 + 30.5) / 2)


def test_wanted_columns_must_be_numeric(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    assert ps.select_available_numeric(df, wanted=["c", "b", "z"]) == ["c"]


def test_starts_are_drawn_from_all_rows(spark):
    # One far group of 5 rows among 6000: any start that looked at few rows only would miss it.
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=2)]) for i in range(6000)] + [(6000 + i, [300.0 + i, 300.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "company_id long, features array<double>")
    one, many = (km.kmeans(df.repartition(p).persist(), 2, n_init=1) for p in (1, 9))
    assert sorted(one.n) == [5, 6000]
    np.testing.assert_allclose(one.centres, many.centres, atol=1e-6)


def test_category_codes_go_on_from_range_to_range(spark):
    words = [f"w{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words + words[:300])] + [(2000, None)], "company_id long, word string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.company_id: r.code for r in ft.category_codes(df, "word", "code").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = {w: i for i, w in enumerate(sorted(set(words)))}
    assert got == {**{i: order[w] for i, w in enumerate(words + words[:300])}, 2000: -1}


def test_company_totals_keep_lines_narrow(spark):
    from harness import duck

    from firmlens.sources.company import PLAIN_COMPANY_SQL, company_table

    found = company_table(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # With count(DISTINCT) every line took all its sums through the shuffle by customer and supplier.
    assert not [line for line in plan.splitlines() if "Aggregate(" in line and "l_suppkey" in line.split("functions=")[0] and "sum(" in line]
    want = duck("/root/testdata/sf0.001").execute(f"SELECT * FROM ({PLAIN_COMPANY_SQL}) c ORDER BY company_id").fetchall()
    assert [tuple(r) for r in found.orderBy("company_id").collect()] == want
