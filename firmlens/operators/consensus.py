"""Mixed-distance medoids, and consensus over many clusterings.

Rows with the same labels in all runs are indistinguishable, so consensus
works on label signatures with their counts, never on pairs of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.operators.density import connected_components
from firmlens.operators.kmeans import add_partials, draw_candidates, few_partitions, fit_many, matrix, predict_all, settled
from firmlens.operators.mixture import mixtures_by_k, predict_mixture
from firmlens.operators.profile_stats import dbl, impute
from firmlens.operators.separable import cluster_sums
from firmlens.operators.validate import Silhouette, _gower, adjusted_rand, silhouettes
from firmlens.session import bounded_collect, cut_lineage, lit_map, local_rows, lookup_join


# --- Gower distance and medoids --------------------------------------------------------------

def numeric_ranges(df: DataFrame, numeric: list[str]) -> dict[str, float]:
    row = df.agg(*[(F.max(dbl(c)) - F.min(dbl(c))).alias(c) for c in numeric]).first()
    return {c: row[c] or 0.0 for c in numeric}


def gower_distance(numeric: list[str], categorical: list[str], ranges: dict[str, float], medoid: dict) -> Column:
    """Mean over columns of |difference| / range (numbers) and mismatch (categories) to one medoid."""
    parts = [
        F.abs(dbl(c) - F.lit(float(medoid[c]))) / F.lit(ranges[c]) if ranges[c] > 0 else F.lit(0.0) for c in numeric
    ]
    parts += [F.coalesce((F.col(c) != F.lit(medoid[c])).cast("double"), F.lit(1.0)) for c in categorical]
    return sum(parts[1:], start=parts[0]) / F.lit(float(len(parts)))


def gower_to_medoids(df: DataFrame, numeric: list[str], categorical: list[str], medoids: list[dict]) -> DataFrame:
    """Adds the distance to each medoid (array ``gower``) and the nearest one (``cluster``)."""
    ranges = numeric_ranges(df, numeric)
    gaps = F.array(*[gower_distance(numeric, categorical, ranges, m) for m in medoids])
    return df.withColumn("gower", gaps).withColumn(
        "cluster", (F.array_position("gower", F.array_min("gower")) - 1).cast("int"))


def coded_features(df: DataFrame, numeric: list[str], categorical: list[str], max_categories: int = 10_000):
    """(frame with array ``features`` of numbers then category codes, weights of the numeric part)."""
    filled = impute(df, numeric, categorical)
    ranges = numeric_ranges(filled, numeric)
    codes = []
    for c in categorical:
        names = sorted(r[0] for r in bounded_collect(filled.select(c).distinct(), max_categories, c))
        codes.append(F.array_position(F.array(*[F.lit(v) for v in names]), F.col(c)).cast("double"))
    weights = np.array([1.0 / ranges[c] if ranges[c] > 0 else 0.0 for c in numeric])
    return filled.withColumn("features", F.array(*[dbl(c) for c in numeric], *codes)), weights


# Passes over the rows that draw candidates for the first medoids, and candidates of a pass for every medoid wanted.
DRAW_PASSES, DRAWN_PER_MEDOID = 4, 2
# Exchanges of a medoid for a candidate, each looked for in one scan; and how often exchanges and updates take turns.
MAX_SWAPS, PHASES = 5, 3


def _drawn(data: DataFrame, distance, most: int, key: str, seed: int) -> np.ndarray:
    """Candidate rows, drawn from all rows in a few passes in proportion to their distance to those drawn before."""
    row = data.orderBy(F.xxhash64(key, F.lit(seed)), key).select("features").first()
    if row is None:
        raise ValueError("no rows to draw medoids from")
    found = np.array([row[0]])
    wanted = DRAWN_PER_MEDOID * most
    for turn in range(DRAW_PASSES):

        def race(batches, found=found):
            for pdf in batches:
                if not len(pdf):
                    continue
                gap = distance(np.stack(pdf["features"]), found).min(axis=1)
                u = ((pdf["h"].to_numpy("int64").view("uint64") >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
                # The least of exponential draws with the distances as rates.
                far = np.flatnonzero(gap > 0)
                time = -np.log(u[far]) / gap[far]
                first = far[np.argsort(time, kind="stable")[:wanted]]
                yield pd.DataFrame({"time": np.sort(time, kind="stable")[:wanted], "features": list(pdf["features"].iloc[first])})

        drawn = data.select("features", F.xxhash64(key, F.lit(seed + 1 + turn)).alias("h")).mapInPandas(race, "time double, features array<double>")
        rows = drawn.orderBy("time", "features").limit(wanted).collect()
        if not rows:
            break
        found = np.unique(np.concatenate([found, np.array([r["features"] for r in rows])]), axis=0)
    return found


def _first_medoids(pool: np.ndarray, rows: np.ndarray, distance, k: int) -> np.ndarray:
    """Greedy choice among the candidates, each standing for ``rows`` rows, bettered by exchanges among them."""
    between = distance(pool, pool)
    picked = [int((between * rows[:, None]).sum(axis=0).argmin())]
    while len(picked) < min(k, len(pool)):
        gain = (np.maximum(between[:, picked].min(axis=1)[:, None] - between, 0) * rows[:, None]).sum(axis=0)
        gain[picked] = -1
        picked.append(int(gain.argmax()))
    for _ in range(2 * k):
        change = _swap_changes(between, np.array(picked), rows)
        change[:, picked] = 0
        m, x = np.unravel_index(change.argmin(), change.shape)
        if change[m, x] >= -1e-9 * rows.sum():
            break
        picked[m] = int(x)
    return pool[picked]


def _swap_changes(gaps: np.ndarray, medoids: np.ndarray | None, rows: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """(medoids x candidates): by how much the summed distance changes if the one takes the other's place.

    ``gaps`` are the rows' distances to the candidates, ``own`` those to the medoids (columns of ``gaps`` if left out).
    """
    own = gaps[:, medoids] if own is None else own
    k = own.shape[1]
    label = own.argmin(axis=1)
    first = own[np.arange(len(own)), label]
    second = np.partition(own, 1, axis=1)[:, 1] if k > 1 else np.full(len(own), np.inf)
    # Any row may gain by the newcomer; the rows of the medoid that goes fall back on their second one.
    gain = np.minimum(gaps - first[:, None], 0) * rows[:, None]
    out = np.tile(gain.sum(axis=0), (k, 1))
    for m in range(k):
        mine = label == m
        out[m] += ((np.minimum(gaps[mine], second[mine][:, None]) - first[mine][:, None]) * rows[mine][:, None] - gain[mine]).sum(axis=0)
    return out


def kmedoids_gower(
    data: DataFrame, weights: np.ndarray, ks: list[int], key: str = "company_id", seed: int = 42, rounds: int = 20
) -> dict[int, tuple[np.ndarray, float]]:
    """Medoids and total distance per K: drawn starts, exact medoid updates, and exchanges with candidates in between.

    The medoid of a cluster is its row with the smallest summed distance to all
    members, an exact sum for every row that needs no pair of rows (``cluster_sums``).  Where no update helps any more, one
    scan weighs every exchange of a medoid for a drawn candidate over all rows, and the best one is made if it lowers
    the total.  All K share the scans; no row is left out.
    """
    return {k: fit for (k, _), fit in kmedoids_by_seed(data, weights, ks, [seed], key, rounds).items()}


def kmedoids_by_seed(
    data: DataFrame, weights: np.ndarray, ks: list[int], seeds: list[int], key: str = "company_id", rounds: int = 20
) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """``kmedoids_gower`` of every K from the candidates of every seed; all (K, seed) share the scans and the sums."""
    few = few_partitions(data)
    distance = _gower(weights, len(weights))
    pools = {seed: _drawn(data, distance, max(ks), key, seed) for seed in seeds}
    stands_for = {seed: rows for seed, (rows, _) in _scan(data, pools, distance, few).items()}
    every = [(k, seed) for seed in seeds for k in ks]
    medoids = {m: _first_medoids(pools[m[1]], stands_for[m[1]], distance, m[0]) for m in every}
    best = {m: (medoids[m], np.inf) for m in every}
    moved = set(every)
    for phase in range(PHASES):
        if phase:
            exchanged = _exchange(data, {m: medoids[m] for m in sorted(moved)}, pools, distance, few, stands_for[seeds[0]].sum())
            moved = {m for m in moved if not np.array_equal(exchanged[m], medoids[m])}
            medoids |= {m: exchanged[m] for m in moved}
        active = set(moved)
        for _ in range(rounds):
            if not active:
                break
            now = {m: medoids[m] for m in sorted(active)}
            scanned = _scan(data, now, distance, few)
            for m in now:
                cost = float(scanned[m][1].sum())
                if cost < best[m][1] - 1e-9 * max(cost, 1.0):
                    best[m] = (now[m], cost)
                else:
                    active.discard(m)
            if not active:
                break
            found = _best_members(data, {m: now[m] for m in sorted(active)}, {m: scanned[m][0] for m in active}, distance, weights, key)
            for m in list(active):
                medoids[m] = found[m]
                if np.array_equal(found[m], now[m]):
                    active.discard(m)
        medoids = {m: best[m][0] for m in every}
    return best


def _exchange(data: DataFrame, medoids: dict, pools: dict[int, np.ndarray], distance, few: bool, rows: float) -> dict:
    """The medoids after the best exchanges with candidates of their seed, one per (K, seed) and scan, as long as they lower the total."""
    medoids, active = dict(medoids), set(medoids)
    for _ in range(MAX_SWAPS):
        if not active:
            break
        for m, change in _swap_scan(data, {m: medoids[m] for m in sorted(active)}, pools, distance, few).items():
            i, x = np.unravel_index(change.argmin(), change.shape)
            if change[i, x] < -1e-9 * rows:
                medoids[m] = medoids[m].copy()
                medoids[m][i] = pools[m[1]][x]
            else:
                active.discard(m)
    return medoids


def _assigned(x, medoids, distance):
    gaps = distance(x, medoids)
    label = gaps.argmin(axis=1)
    return label, gaps[np.arange(len(x)), label]


def _summed(sums: list[np.ndarray | None]):
    """The partition's sums of each model, as rows for ``add_partials``."""
    found = [i for i, row in enumerate(sums) if row is not None]
    if found:
        yield pa.RecordBatch.from_pydict({"model": pa.array(found, pa.int32()), "stats": pa.array([sums[i] for i in found], pa.list_(pa.float64()))})


def _scan(data: DataFrame, medoids: dict, distance, few: bool) -> dict:
    """Rows and summed distance of every cluster of every model."""
    names = list(medoids)

    def partial(batches):
        sums = [None] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("features"))
            for i, name in enumerate(names):
                points = medoids[name]
                label, gaps = _assigned(x, points, distance)
                flat = np.concatenate([np.bincount(label, minlength=len(points)), np.bincount(label, weights=gaps, minlength=len(points))])
                sums[i] = flat if sums[i] is None else sums[i] + flat
        yield from _summed(sums)

    found = add_partials(data.select("features").mapInArrow(partial, "model int, stats array<double>"), few)
    return {name: (found[i][:len(medoids[name])], found[i][len(medoids[name]):]) for i, name in enumerate(names)}


def _swap_scan(data: DataFrame, medoids: dict, pools: dict[int, np.ndarray], distance, few: bool) -> dict:
    """Change of the total by every exchange of a medoid for a candidate of its seed, over all rows."""
    names = list(medoids)
    by_seed = {seed: [i for i, (_, s) in enumerate(names) if s == seed] for seed in pools}

    def partial(batches):
        sums = [None] * len(names)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_048):
                x = matrix(batch.column("features").slice(lo, 2_048))
                one = np.ones(len(x))
                for seed, mine in by_seed.items():
                    gaps = distance(x, pools[seed]) if mine else None
                    for i in mine:
                        flat = _swap_changes(gaps, None, one, distance(x, medoids[names[i]])).ravel()
                        sums[i] = flat if sums[i] is None else sums[i] + flat
        yield from _summed(sums)

    found = add_partials(data.select("features").mapInArrow(partial, "model int, stats array<double>"), few)
    return {name: found[i].reshape(len(medoids[name]), -1) for i, name in enumerate(names)}


def _best_members(data: DataFrame, medoids: dict, sizes: dict, distance, weights: np.ndarray, key: str) -> dict:
    """Exact medoid of every cluster of every model: the member with the least summed distance, ties by key."""
    ks = list(medoids)

    @F.pandas_udf("array<int>")
    def codes(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy())
        return pd.Series(list(np.stack([_assigned(rows, medoids[k], distance)[0] for k in ks], axis=1).astype("int32")))

    base = cut_lineage(data.select(F.col(key).alias("id"), F.col("features").alias("x")).withColumn("codes", codes("x")))
    sums = cluster_sums(base, weights, [sizes[k] for k in ks], own=True)
    each = sums.select("id", F.posexplode(F.arrays_zip("codes", "sums")).alias("which", "of"))
    least = each.groupBy("which", F.col("of.codes").alias("c")).agg(F.min(F.struct(F.round("of.sums", 9).alias("sum"), "id")).alias("least"))
    # One row per cluster of every model.
    picked = cut_lineage(least.select("which", "c", F.col("least.id").alias("id")))
    rows = base.select("id", "x").join(F.broadcast(picked), "id").select("which", "c", "x").collect()
    found = {k: medoids[k].copy() for k in ks}
    for r in rows:
        found[ks[r["which"]]][r["c"]] = r["x"]
    return found


def predict_medoids(df: DataFrame, medoids: np.ndarray, weights: np.ndarray, out: str = "cluster") -> DataFrame:
    distance = _gower(weights, len(weights))

    @F.pandas_udf("int")
    def assign(x: pd.Series) -> pd.Series:
        return pd.Series(distance(np.stack(x.to_numpy()), medoids).argmin(axis=1).astype("int32"))

    return df.withColumn(out, assign("features"))


def best_medoids(data: DataFrame, weights: np.ndarray, ks: list[int], key: str = "company_id", **options):
    """K with the best Gower silhouette: (k, medoids, {k: silhouette})."""
    fits = kmedoids_gower(data, weights, ks, key, **options)
    labelled = data
    for k in ks:
        labelled = predict_medoids(labelled, fits[k][0], weights, f"k{k}")
    scores = silhouettes(labelled, [f"k{k}" for k in ks], key=key, gower_weights=weights)
    found = dict(zip(ks, scores))
    best = max(ks, key=lambda k: (found[k].score, -k))
    return best, fits[best][0], found


def stability_ari(df: DataFrame, runs: list[str], reference: str, threshold: float = 0.85) -> tuple[float, bool]:
    """Mean adjusted Rand index of several label columns against a reference."""
    mean = float(np.mean([adjusted_rand(df, c, reference) for c in runs]))
    return mean, mean >= threshold


# --- consensus ---------------------------------------------------------------------------------

def signatures(df: DataFrame, runs: list[str]) -> DataFrame:
    """Distinct label combinations with their row counts."""
    return df.groupBy(F.array(*[F.col(c).cast("int") for c in runs]).alias("signature")).agg(F.count("*").alias("n"))


def coassociation(signature_frame: DataFrame, runs: int) -> DataFrame:
    """Share of runs in which two signatures agree, for pairs that agree at least once.

    An equi-join on (run, label); its size is bounded by the signatures, not the rows.
    """
    exploded = signature_frame.select("signature", F.posexplode("signature").alias("run", "label"))
    other = exploded.select(F.col("signature").alias("other"), "run", "label")
    return exploded.join(other, ["run", "label"]).groupBy("signature", "other").agg(
        (F.count("*") / F.lit(float(runs))).alias("share"))


# Rows of one block of groups, and blocks that may be sent to every task.
LINK_ROWS, SENT_BLOCKS = 1_024, 64
# Groups from which on the rest of the merging fits one matrix on the driver.
LAST_GROUPS = 1_000
# Labels of all runs together.
MAX_LABELS = 10_000


def _distances(sums: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray, runs: int) -> np.ndarray:
    """Average share of runs that tell a row of one group from a row of another, from the groups' label counts.

    Counts are whole numbers, so equal distances come out equal; the rounding takes off the division's last bits.
    """
    return np.round(1.0 - (sums @ other.T) / (runs * n[:, None] * m[None]), 12)


def _nearest_groups(blocks: DataFrame, n_blocks: int, width: int, runs: int) -> DataFrame:
    """(g, best): for each group the pair (distance, lower id, higher id) that comes first; every pair of blocks meets once."""

    def read(batch, i, side):
        ids, n = (np.frombuffer(batch.column(f"{c}_{side}")[i].as_buffer(), np.int64) for c in ("ids", "n"))
        return ids, n.astype(float), np.frombuffer(batch.column(f"sums_{side}")[i].as_buffer()).reshape(-1, width)

    def run(batches):
        held: dict[int, tuple] = {}

        def keep(ids, least, other):
            first = int(ids[0])
            if first in held:
                _, d, o = held[first]
                better = (least < d) | ((least == d) & (other < o))
                least, other = np.where(better, least, d), np.where(better, other, o)
            held[first] = (ids, least, other)

        for batch in batches:
            for i in range(batch.num_rows):
                ids, n, sums = read(batch, i, "x")
                more, m, others = read(batch, i, "y")
                gap = _distances(sums, n, others, m, runs)
                gap[ids[:, None] == more[None]] = np.inf
                for mine, theirs, d in ((ids, more, gap), (more, ids, gap.T)):
                    least = d.min(axis=1)
                    keep(mine, least, np.where(d == least[:, None], theirs[None], np.iinfo(np.int64).max).min(axis=1))
        for ids, least, other in held.values():
            ok = np.isfinite(least)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[ok]), pa.array(least[ok]), pa.array(np.minimum(ids, other)[ok]), pa.array(np.maximum(ids, other)[ok])], ["g", "d", "lo", "hi"])

    left = blocks.select(*[F.col(c).alias(f"{c}_x") for c in ("block", "ids", "n", "sums")]).withColumn("block", F.explode(F.sequence("block_x", F.lit(n_blocks - 1))))
    met = lookup_join(left, blocks.select("block", *[F.col(c).alias(f"{c}_y") for c in ("ids", "n", "sums")]), ["block"], "inner", SENT_BLOCKS)
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    met = met.repartition(min(2 * cores, n_blocks * (n_blocks + 1) // 2)) if n_blocks > 1 else met
    found = met.mapInArrow(run, "g long, d double, lo long, hi long")
    return found.groupBy("g").agg(F.min(F.struct("d", "lo", "hi")).alias("best"))


def _packed(groups: DataFrame, n_blocks: int) -> DataFrame:
    """Blocks of groups as bytes."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g")
        values = [pdf["g"].to_numpy(np.int64).tobytes(), pdf["n"].to_numpy(np.int64).tobytes(), np.stack(pdf["sums"]).tobytes()]
        return pd.DataFrame([[int(pdf["block"].iloc[0]), *values]], columns=["block", "ids", "n", "sums"])

    return groups.withColumn("block", F.pmod(F.xxhash64("g"), F.lit(n_blocks)).cast("int")).groupBy("block").applyInPandas(pack, "block int, ids binary, n binary, sums binary")


def _last_merges(ids: np.ndarray, n: np.ndarray, sums: np.ndarray, runs: int) -> list[tuple[float, int, int]]:
    """All merges of few groups, one after the other: the least (distance, lower id, higher id) first; a group keeps its lower id."""
    ids, n, sums = ids.copy(), n.astype(float).copy(), sums.astype(float).copy()
    order = ids.argsort()
    ids, n, sums = ids[order], n[order], sums[order]
    gap = _distances(sums, n, sums, n, runs)
    np.fill_diagonal(gap, np.inf)
    out = []
    for _ in range(len(ids) - 1):
        least = gap.min(axis=1)
        i = int(least.argmin())
        j = int(gap[i].argmin())
        out.append((float(least[i]), int(ids[i]), int(ids[j])))
        sums[i] += sums[j]
        n[i] += n[j]
        gap[j], gap[:, j] = np.inf, np.inf
        alive = np.isfinite(gap).any(axis=1)
        alive[i] = False
        gap[i], gap[:, i] = np.inf, np.inf
        if alive.any():
            row = _distances(sums[i][None], n[[i]], sums[alive], n[alive], runs)[0]
            gap[i, alive] = row
            gap[alive, i] = row
    return out


def _counted(signature_frame: DataFrame) -> tuple[DataFrame, int]:
    """(frame of g, signature, n and ``sums``, the rows of each label of each run; how many labels there are): ids follow signature order."""
    whole = signature_frame.withColumn("signature", F.transform("signature", lambda v: F.coalesce(v, F.lit(-(1 << 31)))))
    labels = bounded_collect(whole.select(F.posexplode("signature").alias("run", "label")).distinct(), MAX_LABELS, "labels of all runs")
    known: dict[int, list[int]] = {}
    for r in sorted(labels):
        known.setdefault(r["run"], []).append(r["label"])
    first = np.cumsum([0, *(len(known[r]) for r in sorted(known))])

    @F.pandas_udf("array<double>")
    def counts(signature: pd.Series, n: pd.Series) -> pd.Series:
        rows = np.stack(signature.to_numpy())
        out = np.zeros((len(rows), int(first[-1])))
        for r in range(rows.shape[1]):
            out[np.arange(len(rows)), first[r] + np.searchsorted(known[r], rows[:, r])] = n
        return pd.Series(list(out))

    ordered = signature_frame.orderBy("signature").withColumn("g", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered)
    return cut_lineage(ordered.withColumn("sums", counts(F.transform("signature", lambda v: F.coalesce(v, F.lit(-(1 << 31)))), "n"))), int(first[-1])


def average_linkage(signature_frame: DataFrame, runs: int, k: int, last_groups: int = LAST_GROUPS, max_rounds: int = 500) -> DataFrame:
    """(signature, cluster): average linkage of weighted signatures down to ``k`` groups, numbered by falling rows.

    The average distance of two groups follows from their counts of labels in each run, so no matrix of
    signatures is needed.  Merging never brings a group nearer to others than its parts were, so all pairs that are
    each other's nearest merge at once, in rounds that look for every group's nearest block by block.  The few groups that
    are left merge on the driver.  Of all merges the shortest count: those beyond ``k`` groups are undone.
    Ties go to lower ids, in signature order.
    """
    spark = signature_frame.sparkSession
    start, width = _counted(signature_frame)
    groups, alive, steps = start.select("g", "n", "sums"), start.count(), []
    if not alive:
        return signature_frame.select("signature", F.lit(0).alias("cluster"))
    undone = max(0, min(k, alive) - 1)
    while alive > last_groups:
        if len(steps) == max_rounds:
            raise RuntimeError("linkage did not settle")
        n_blocks = -(-alive // LINK_ROWS)
        near = _nearest_groups(cut_lineage(_packed(groups, n_blocks)), n_blocks, width, runs)
        # A pair that comes first for both of its groups.
        pairs = cut_lineage(near.groupBy("best").agg(F.count("*").alias("both")).where("both = 2").select("best.*", F.lit(len(steps)).alias("step")))
        steps.append(pairs)
        alive -= pairs.count()
        gone = lookup_join(groups, pairs.select(F.col("hi").alias("g"), F.col("lo").alias("into")), ["g"], "inner").select(F.col("into").alias("g"), F.col("n").alias("n_in"), F.col("sums").alias("sums_in"))
        kept = groups.join(pairs.select(F.col("hi").alias("g")), "g", "left_anti").join(gone, "g", "left")
        both = F.when(F.col("n_in").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "sums_in", lambda x, y: x + y))
        groups = cut_lineage(kept.select("g", (F.col("n") + F.coalesce("n_in", F.lit(0))).alias("n"), both.alias("sums")))
    rows = groups.orderBy("g").collect()  # last_groups at most
    last = _last_merges(np.array([r["g"] for r in rows]), np.array([r["n"] for r in rows]), np.array([r["sums"] for r in rows]), runs)
    merges = local_rows(spark, [(d, lo, hi, len(steps) + i) for i, (d, lo, hi) in enumerate(last)], "d double, lo long, hi long, step int")
    for pairs in steps:
        merges = merges.unionByName(pairs)
    if undone:
        top = merges.orderBy(F.desc("d"), F.desc("step"), F.desc("lo"), F.desc("hi")).limit(undone)
        merges = merges.join(F.broadcast(local_rows(spark, [(r["lo"], r["hi"]) for r in top.collect()], "lo long, hi long")), ["lo", "hi"], "left_anti")
    comps = connected_components(start.select(F.col("g").alias("id")), cut_lineage(merges).select(F.col("lo").alias("src"), F.col("hi").alias("dst")))
    found = cut_lineage(start.select("g", "signature", "n").join(comps.withColumnRenamed("id", "g"), "g"))
    order = found.groupBy("comp").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), "comp").collect()  # k groups
    names = local_rows(spark, [(r["comp"], i) for i, r in enumerate(order)], "comp long, cluster int")
    return found.join(F.broadcast(names), "comp").select("signature", "cluster")


@dataclass(frozen=True)
class Consensus:
    labelled: DataFrame
    mean_ari: float
    n_signatures: int


def _named(df: DataFrame, runs: list[str], names: DataFrame) -> DataFrame:
    """Rows with the ``cluster`` of their signature."""
    keyed = df.drop("cluster").withColumn("__signature", F.array(*[F.col(c).cast("int") for c in runs]))
    return lookup_join(keyed, names.withColumnRenamed("signature", "__signature"), ["__signature"]).drop("__signature")


def consensus_of(df: DataFrame, runs: list[str], k: int) -> Consensus:
    """Average-linkage consensus of several label columns, over any number of distinct signatures."""
    frame = cut_lineage(signatures(df, runs))
    labelled = _named(df, runs, cut_lineage(average_linkage(frame, len(runs), k)))
    mean, _ = stability_ari(labelled, runs, "cluster")
    return Consensus(labelled, mean, frame.count())


def best_assignment(gain: np.ndarray) -> list[int]:
    """Column of each row so that the summed gain is largest and no column is used twice (rows beyond the columns get -1).

    Shortest augmenting paths over dual prices; the matrix has one row and column per label.
    """
    n, m = gain.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : n + 1, 1 : m + 1] = gain.max(initial=0.0) - gain
    row_price, col_price = np.zeros(size + 1), np.zeros(size + 1)
    row_of = np.zeros(size + 1, int)
    for i in range(1, size + 1):
        row_of[0], j = i, 0
        least, back, used = np.full(size + 1, np.inf), np.zeros(size + 1, int), np.zeros(size + 1, bool)
        while row_of[j]:
            used[j] = True
            slack = cost[row_of[j]] - row_price[row_of[j]] - col_price
            better = ~used & (slack < least)
            better[0] = False
            least[better], back[better] = slack[better], j
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            nxt = int(free.argmin())
            step = free[nxt]
            row_price[row_of[used]] += step
            col_price[used] -= step
            least[~used] -= step
            j = nxt
        while j:
            row_of[j] = row_of[back[j]]
            j = int(back[j])
    out = [-1] * n
    for j in range(1, m + 1):
        if row_of[j] <= n:
            out[row_of[j] - 1] = j - 1
    return out


def aligned_labels(frame: DataFrame, runs: int) -> list[dict[int, int]]:
    """For every run, what its labels are called in the first run: the renaming that agrees on most rows; labels left over go on behind."""
    cells = frame.select(F.col("signature")[0].alias("first"), F.posexplode("signature").alias("run", "label"), "n").where("first IS NOT NULL AND label IS NOT NULL")
    counts = bounded_collect(cells.groupBy("run", "first", "label").agg(F.sum("n").alias("n")), MAX_LABELS * 100, "cells of the contingency tables")
    first = sorted({r["first"] for r in counts})
    out = []
    for run in range(runs):
        mine = sorted({r["label"] for r in counts if r["run"] == run})
        table = np.zeros((len(mine), len(first)))
        for r in counts:
            if r["run"] == run:
                table[mine.index(r["label"]), first.index(r["first"])] += r["n"]
        picked = best_assignment(table)
        spare = iter(range(max(first, default=0) + 1, max(first, default=0) + 1 + len(mine)))
        out.append({v: first[p] if p >= 0 else next(spare) for v, p in zip(mine, picked, strict=True)})
    return out


def majority_vote(df: DataFrame, runs: list[str], align: bool = True) -> DataFrame:
    """Adds ``cluster``: the label that most runs give a row, the smallest on a tie; without ``align`` labels are taken as they are.

    Labels of different runs are first brought to the names of the first run.  Rows vote as signatures; a row without any label has none.
    """
    frame = signatures(df, runs)
    if align:
        renamed = aligned_labels(frame, len(runs))
        votes = F.array(*[F.element_at(lit_map(names, "int", "int"), F.col("signature")[i]) if names else F.lit(None).cast("int") for i, names in enumerate(renamed)])
    else:
        votes = F.col("signature")
    given = F.filter(votes, lambda v: v.isNotNull())
    ballots = F.transform(F.array_distinct(given), lambda v: F.struct((-F.size(F.filter(given, lambda w: w == v))).alias("against"), v.alias("label")))
    return _named(df, runs, cut_lineage(frame.select("signature", F.array_min(ballots)["label"].alias("cluster"))))


def consensus(data: DataFrame, k: int = 8, runs: int = 20, seed: int = 42, key: str = "company_id") -> Consensus:
    """Half the runs K-Means, a quarter mixtures, combined by co-association."""

    n_kmeans, n_gmm = runs // 2, runs // 4
    drawn = draw_candidates(data, {0: k}, n_kmeans, seed, key)
    fits = fit_many(data, [(0, settled(drawn[0, i], k, seed + i)) for i in range(n_kmeans)])
    labelled = predict_all(data, dict(enumerate(fits)), "run_k")
    names = [f"run_k{i}" for i in range(n_kmeans)]
    for i in range(n_gmm):
        for model in mixtures_by_k(data, [k], n_init=1, seed=seed + 500 + i, key=key).values():
            labelled = predict_mixture(labelled, model, f"run_g{i}").drop("confidence")
            names.append(f"run_g{i}")
    labelled = labelled.persist()
    return consensus_of(labelled, names, k)
