"""Summed mixed distances to whole clusters, without a pair of rows.

A mixed distance is a sum over columns, and so is the summed distance of a row to a
cluster.  Of a number x it is ``x * (below - above) - (sum below - sum above)`` over the
cluster's values, of a category the members that have another one.  The values of all number columns are
dealt to range partitions in value order; a partition needs the counts and sums of those
before it and goes on with its own.  Equal values add nothing, so a hot value may be split over
partitions in any way.  The shuffle is linear in rows times columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.session import cut_lineage, lookup_join

# Values of one range partition, and bytes of their sums.
RANGE_VALUES, RANGE_BYTES = 200_000, 32 << 20


def _running(codes: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the values of each cluster before every row (exclusive)."""
    one = np.zeros((len(codes) + 1, width))
    one[np.arange(len(codes)) + 1, codes] = 1.0
    total = np.zeros_like(one)
    total[np.arange(len(codes)) + 1, codes] = values
    return one.cumsum(axis=0)[:-1], total.cumsum(axis=0)[:-1]


def _own_sums(codes: np.ndarray, values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Summed distance of each value to its own cluster; ``before`` has counts and sums of the partitions before and of all, per cluster.

    Only the values of a cluster are run through for it, so the work does not grow with the number of clusters.
    """
    found = np.empty(len(values))
    order = codes.argsort(kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if not len(rows):
            continue
        v, (n0, s0, all_n, all_s) = values[rows], before[:, codes[rows[0]]]
        s = np.concatenate([[0.0], np.cumsum(v)[:-1]])
        found[rows] = v * (2 * (np.arange(len(v)) + n0) - all_n) + all_s - 2 * (s + s0)
    return found


def _ranges(values: int, width: int) -> int:
    """Range partitions of so many values, each with ``width`` sums in its task's memory."""
    return max(1, -(-values // RANGE_VALUES), -(-values * width * 8 // RANGE_BYTES))


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(f, v, codes) of the values of a range."""
    codes = table["codes"].combine_chunks()
    return table["f"].to_numpy(), table["v"].to_numpy().astype(float), codes.flatten().to_numpy(zero_copy_only=False).reshape(len(codes), -1)


def _numbers(long: DataFrame, widths: list[int], own: bool, partitions: int, kind: str) -> DataFrame:
    """(id, sums) per value: its summed distance to the clusters of each labelling, or to its own cluster."""
    starts = np.concatenate([[0], np.cumsum(widths)]).astype(int)
    salt = F.xxhash64("id")
    dealt = cut_lineage(long.repartitionByRange(partitions, "f", "v", salt).withColumn("part", F.spark_partition_id()))

    def totals(table: pa.Table) -> pa.Table:
        f, v, codes = _read(table)
        out = []
        for one in np.unique(f):
            rows = f == one
            for start, code, width in zip(starts, codes[rows].T, widths):
                n = np.bincount(code, minlength=width)
                found = np.flatnonzero(n)
                out.append((np.full(len(found), one), start + found, n[found].astype(float), np.bincount(code, weights=v[rows], minlength=width)[found]))
        f, c, n, s = (np.concatenate(column) for column in zip(*out, strict=True))
        return pa.table({"part": pa.array(np.full(len(f), table["part"][0].as_py()), pa.int32()), "f": pa.array(f, pa.int32()), "c": pa.array(c, pa.int32()), "n": n, "s": s})

    counted = cut_lineage(dealt.groupBy("part").applyInArrow(totals, "part int, f int, c int, n double, s double"))
    # One row per partition, column and cluster.
    whole = counted.groupBy("f", "c").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    parts = dealt.select("part", "f").distinct()
    grid = lookup_join(parts, whole, ["f"], "inner").join(counted, ["part", "f", "c"], "left").na.fill(0.0, ["n", "s"])
    before = Window.partitionBy("f", "c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(grid.select("part", "f", "c", "all_n", "all_s", *[F.coalesce(F.sum(x).over(before), F.lit(0.0)).alias(x) for x in ("n", "s")]))

    def sums(table: pa.Table, off: pa.Table) -> pa.Table:
        f, v, codes = _read(table)
        there = {name: off[name].to_numpy() for name in ("f", "c", "n", "s", "all_n", "all_s")}
        out = np.empty((len(v), len(widths) if own else starts[-1]))
        for one in np.unique(f):
            rows = np.flatnonzero(f == one)
            rows = rows[v[rows].argsort(kind="stable")]
            base = np.zeros((4, starts[-1]))
            mine = there["f"] == one
            base[:, there["c"][mine]] = [there[name][mine] for name in ("n", "s", "all_n", "all_s")]
            values = v[rows]
            for i, width in enumerate(widths):
                span = slice(starts[i], starts[i + 1])
                if own:
                    out[rows, i] = _own_sums(codes[rows, i], values, base[:, span])
                    continue
                n, s = _running(codes[rows, i], values, width)
                n, s = n + base[0, span], s + base[1, span]
                out[rows, span] = values[:, None] * (2 * n - base[2, span]) + base[3, span] - 2 * s
        np.maximum(out, 0.0, out=out)
        offsets = pa.array(np.arange(len(out) + 1, dtype="int32") * out.shape[1])
        return pa.table({"id": table["id"], "sums": pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))})

    return dealt.groupBy("part").cogroup(offsets.groupBy("part")).applyInArrow(sums, f"id {kind}, sums array<double>")


def _categories(long: DataFrame, widths: list[int], own: bool, sizes: list[np.ndarray]) -> DataFrame:
    """(id, sums) per category of a row: the members of each cluster that have another one."""
    starts = np.concatenate([[0], np.cumsum(widths)]).astype(int)
    shifted = F.transform("codes", lambda c, i: c + F.element_at(F.array(*[F.lit(int(s)) for s in starts[:-1]]), i + 1))
    counted = long.select("f", "v", F.explode(shifted).alias("c")).groupBy("f", "v", "c").agg(F.count("*").cast("double").alias("n"))
    with_it = counted.groupBy("f", "v").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("of"))
    joined = lookup_join(long, with_it, ["f", "v"])
    total = F.array(*[F.lit(float(n)) for size in sizes for n in size])
    wanted = shifted if own else F.sequence(F.lit(0), F.lit(int(starts[-1]) - 1))
    others = F.transform(wanted, lambda c: F.element_at(total, c + 1) - F.coalesce(F.element_at("of", c), F.lit(0.0)))
    return joined.select("id", others.alias("sums"))


def cluster_sums(base: DataFrame, weights: np.ndarray, sizes: list[np.ndarray], own: bool = False) -> DataFrame:
    """(id, codes, sums): each row's summed mixed distance to all clusters of all labellings side by side, or to its own cluster of each.

    ``base`` has ``id``, ``x`` (numbers, then coded categories) and ``codes`` (a cluster per labelling, from 0);
    ``weights`` scale the numbers, ``sizes`` are the rows of each cluster.
    """
    p, widths = len(weights), [len(s) for s in sizes]
    kind = base.schema["id"].dataType.simpleString()
    row = base.select(F.size("x").alias("d")).first()
    if row is None:
        return base.select("id", "codes", F.array().cast("array<double>").alias("sums"))
    d = row["d"]
    kept = [j for j in range(p) if weights[j] > 0]
    parts = []
    if kept:
        # Values are scaled and start near zero, so sums of many rows lose nothing that matters.
        least = base.agg(*[F.min(F.col("x")[j]).alias(str(j)) for j in kept]).first()
        scaled = F.array(*[(F.col("x")[j] - F.lit(float(least[str(j)]))) * float(weights[j]) for j in kept])
        long = base.select("id", "codes", F.posexplode(scaled).alias("f", "v"))
        partitions = _ranges(base.count() * len(kept), len(widths) if own else sum(widths))
        parts.append(_numbers(long, widths, own, partitions, kind))
    if d > p:
        long = base.select("id", "codes", F.posexplode(F.slice("x", p + 1, d - p)).alias("f", "v"))
        parts.append(_categories(long, widths, own, sizes))
    if not parts:
        none = F.array(*[F.lit(0.0) for _ in range(len(widths) if own else sum(widths))])
        return base.select("id", "codes", none.alias("sums"))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    width = len(widths) if own else int(sum(widths))
    added = every.groupBy("id").agg(F.array(*[F.sum(F.col("sums")[i]) / F.lit(float(d)) for i in range(width)]).alias("sums"))
    return base.select("id", "codes").join(added, "id")
