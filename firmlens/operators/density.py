"""DBSCAN: density clustering with a space-splitting neighbour search.

Identical points are merged into one weighted point first.  Points live in the
leaves of a space-splitting tree over all dimensions and visit the other leaves
within eps of them, so only points near a cut are copied.  A crowded leaf is cut into blocks, and each pair
of blocks is one small task that returns only a count per point, or one edge
per point towards a representative.  So neither pairs of neighbours nor whole
leaves are ever materialised.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.operators.splits import Forest, forest
from firmlens.session import cut_lineage, grown_join, lookup_join

BLOCK_ROWS = 2_048


def meetings(points: DataFrame, trees: Forest, reach, block_rows: int = BLOCK_ROWS, visitors=None) -> DataFrame:
    """Rows (batch, rb, vb, cell, resident, ...): every resident block meets every visitor block of its leaf.

    ``points`` have a ``cell`` and a group ``grp``; each visits all leaves within ``reach`` (a column), its own included, unless ``visitors`` says false.
    Crowded leaves get one group per pair of blocks; sparse ones share groups,
    so the number of groups follows the number of rows and not of leaves.
    """
    homed = points.withColumn("cell", F.col("cell").cast("int"))
    guests_ = homed if visitors is None else homed.where(visitors)
    visiting = guests_.withColumn("cell", F.explode(trees.cells(F.col("grp"), F.col("features"), reach)))
    # Visitors only matter in cells that have residents.
    homes = homed.groupBy("cell").agg(F.count("*").alias("n_res"))
    guests = visiting.groupBy("cell").agg(F.count("*").alias("n_vis"))
    sizes = cut_lineage(homes.join(guests, "cell").select(
        "cell", "n_res", "n_vis", F.ceil(F.col("n_res") / block_rows).cast("int").alias("nr"),
        F.ceil(F.col("n_vis") / block_rows).cast("int").alias("nv")))
    total = sizes.agg(F.sum(F.col("n_res") + F.col("n_vis"))).first()[0] or 0
    batches = max(1, total // (4 * block_rows))
    crowded = F.col("nr") * F.col("nv") > 1
    sizes = sizes.select("cell", "nr", "nv", F.when(crowded, F.concat(F.lit("="), F.col("cell").cast("string"))).otherwise(
        F.pmod(F.xxhash64("cell"), F.lit(batches)).cast("string")).alias("batch"))
    spread = F.xxhash64("id")
    residents = (
        lookup_join(homed, sizes, ["cell"], "inner")
        .withColumn("rb", F.pmod(spread, F.col("nr")).cast("int"))
        .withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("nv") - 1))).withColumn("resident", F.lit(True)))
    callers = (
        lookup_join(visiting, sizes, ["cell"], "inner")
        .withColumn("vb", F.pmod(spread, F.col("nv")).cast("int"))
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).withColumn("resident", F.lit(False)))
    # A fixed number of partitions: groups are small in bytes but heavy in work, so they must not be coalesced.
    cores = points.sparkSession.sparkContext.defaultParallelism
    return (
        residents.unionByName(callers).drop("nr", "nv")
        .repartition(min(max(cores, total // (8 * block_rows)), 50_000), "batch", "rb", "vb"))


def cells_of(pdf: pd.DataFrame):
    """Per cell of the group: positions of its residents and of its visitors."""
    code = pd.factorize(pdf["cell"])[0]
    order = code.argsort(kind="stable")
    cuts = np.nonzero(np.diff(code[order]))[0] + 1
    resident = pdf["resident"].to_numpy(dtype=bool)
    for rows in np.split(order, cuts):
        mine = resident[rows]
        if mine.any() and not mine.all():
            yield rows[mine], rows[~mine]


# From this many dimensions on a product of matrices is much faster than a sum column by column.
PRODUCT_DIMS = 8


def _near(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of two blocks lie within eps; gaps are summed column by column, without cancellation.

    In many dimensions a product of matrices decides all pairs but those so close to eps that its roundings
    could matter; these are summed column by column as well, so the answer is the same.
    """
    near = np.zeros((len(x), len(y)), dtype=bool)
    limit, by_product = eps * eps, x.shape[1] >= PRODUCT_DIMS
    if by_product:
        with np.errstate(over="ignore", invalid="ignore"):
            xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
            slack = 16 * (x.shape[1] + 4) * np.finfo(float).eps * (xx.max(initial=0.0) + yy.max(initial=0.0) + limit)
    for lo in range(0, len(x), 256):
        part = x[lo:lo + 256]
        if by_product:
            with np.errstate(over="ignore", invalid="ignore"):
                gaps = part @ y.T
                gaps *= -2
                gaps += xx[lo:lo + 256][:, None]
                gaps += yy[None]
                sure = gaps <= limit - slack
                # What is not a number (from overflow) is in doubt, too.
                i, j = np.nonzero(~(gaps > limit + slack) & ~sure)
                near[lo:lo + 256] = sure
                for at in range(0, len(i), 1 << 20):
                    a, b = i[at:at + (1 << 20)], j[at:at + (1 << 20)]
                    gap = np.zeros(len(a))
                    for c in range(x.shape[1]):
                        gap += (part[a, c] - y[b, c]) ** 2
                    near[lo + a, b] = gap <= limit
            continue
        gaps = np.zeros((len(part), len(y)))
        for j in range(x.shape[1]):
            gaps += (part[:, j][:, None] - y[:, j][None]) ** 2
        near[lo:lo + 256] = gaps <= limit
    return near


def _representatives(left_ids, right_ids, near):
    """Smallest id reachable from each point within the two blocks."""
    a, b = left_ids.copy(), right_ids.copy()
    big = np.iinfo("int64").max
    while True:
        na = np.minimum(a, np.where(near, b[None], big).min(axis=1, initial=big))
        nb = np.minimum(b, np.where(near, na[:, None], big).min(axis=0, initial=big))
        if (na == a).all() and (nb == b).all():
            return a, b
        a, b = na, nb


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node id reachable from every node: rows (id, comp).

    Every round each node hooks to its smallest neighbour, two pointer jumps
    shorten the chains, and the edges are contracted to what is left between
    different nodes, so the graph at least halves.  Rounds are written out; a
    lost executor does not restart the loop.
    """
    labels = nodes.select("id", F.col("id").alias("comp"))
    left = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    for _ in range(max_rounds):
        left = cut_lineage(left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        if left.isEmpty():
            return labels
        hook = left.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to"))
        for _ in range(2):
            onward = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
            hook = cut_lineage(lookup_join(hook, onward, ["to"]).select("a", F.coalesce("next", "to").alias("to")))
        moved = lookup_join(left, hook, ["a"]).select(F.col("to").alias("c"), F.col("b").alias("a"))
        moved = lookup_join(moved, hook, ["a"]).select(F.col("c").alias("a"), F.col("to").alias("b"))
        left = moved.where("a <> b")
        renamed = hook.select(F.col("a").alias("comp"), F.col("to").alias("next"))
        labels = cut_lineage(lookup_join(labels, renamed, ["comp"]).select("id", F.coalesce("next", "comp").alias("comp")))
    raise RuntimeError("components did not settle")


def dbscan(
    df: DataFrame, eps: float = 0.5, min_samples: int = 5, features: str = "features", key: str = "company_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``core`` (0/1) and ``cluster``: the smallest core key of the component, -1 for noise.

    A point is core if at least ``min_samples`` rows (itself included) lie
    within ``eps``.  A border point takes the smallest neighbouring cluster.
    """
    merged = df.groupBy(F.col(features).alias("features")).agg(
        F.min(F.col(key).cast("long")).alias("id"), F.count("*").alias("weight"))
    merged = cut_lineage(merged.withColumn("grp", F.lit(0)))
    trees = forest(merged, "grp", leaf_rows=block_rows)
    merged = cut_lineage(trees.home(merged, "grp").drop("margin"))
    blocks = meetings(merged, trees, F.lit(float(eps)), block_rows)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["features"])
        ids, weight = (pdf[c].to_numpy(dtype="int64") for c in ("id", "weight"))
        found = [(ids[r], _near(x[r], x[v], eps).astype("int64") @ weight[v]) for r, v in cells_of(pdf)]
        if not found:
            return pd.DataFrame({"id": ids[:0], "near": ids[:0]})
        return pd.DataFrame({"id": np.concatenate([i for i, _ in found]), "near": np.concatenate([n for _, n in found])})

    # Written, as the join looks at the size first and the blocks would be compared twice.
    counts = cut_lineage(blocks.groupBy("batch", "rb", "vb").applyInPandas(count, "id long, near long").groupBy("id").agg(
        F.sum("near").alias("near")))
    cored = cut_lineage(lookup_join(merged, counts, ["id"]).withColumn("core", F.col("near") >= min_samples))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["features"])
        ids, core = pdf["id"].to_numpy(dtype="int64"), pdf["core"].to_numpy(dtype=bool)
        src, dst, border = [ids[:0]], [ids[:0]], [core[:0]]
        for r, v in cells_of(pdf):
            v = v[core[v]]
            if not len(v):
                continue
            near = _near(x[r], x[v], eps)
            inner = core[r]
            a, b = _representatives(ids[r[inner]], ids[v], near[inner])
            edge = np.nonzero(near[~inner])
            src += [ids[r[inner]], ids[v], ids[r[~inner]][edge[0]]]
            dst += [a, b, b[edge[1]]]
            border += [np.zeros(len(a) + len(b), dtype=bool), np.ones(len(edge[0]), dtype=bool)]
        out = pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "border": np.concatenate(border)})
        return out[out["src"] != out["dst"]].drop_duplicates()

    links = cut_lineage(
        meetings(cored.drop("near"), trees, F.lit(float(eps)), block_rows).groupBy("batch", "rb", "vb")
        .applyInPandas(link, "src long, dst long, border boolean").distinct())
    comps = connected_components(cored.where("core").select("id"), links.where("NOT border").select("src", "dst"))
    border = (
        grown_join(links.where("border"), comps, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("comp").alias("comp"))
        .withColumnRenamed("src", "id"))
    labels = cut_lineage(comps.unionByName(border))
    points = cut_lineage(grown_join(cored, labels, "id", "left").select(
        F.col("features").alias(features), F.col("core").cast("int").alias("core"),
        F.coalesce("comp", F.lit(-1)).alias("cluster")))
    return lookup_join(df.drop("core", "cluster"), points, [features]).select(
        *[c for c in df.columns if c not in ("core", "cluster")], "core", "cluster")
