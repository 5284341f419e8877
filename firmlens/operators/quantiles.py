"""Exact quantiles (linear interpolation) that survive any group size.

``percentile`` keeps every distinct value of a group in one aggregation
buffer, which is right for small groups only.  Larger groups are narrowed
first: a mergeable sketch brackets each wanted rank, rows below the bracket
are only counted, and the exact order statistics are read from the few
distinct values inside it.  No row is dropped or sampled, whatever the skew.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlens.session import bounded_collect, local_rows

# Groups up to this size go through the built-in exact percentile.
HISTOGRAM_ROWS = 200_000
# Groups x features whose fitted quantiles may be held on the driver.
MAX_GROUPS = 50_000
_GRID = 500
_ACCURACY = 10_000


def quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    by: str | None = None,
    histogram_rows: int = HISTOGRAM_ROWS,
) -> dict:
    """Exact quantiles of ``cols``: ``{group: {col: [q, ...]}}``.

    Without ``by`` the single group is ``None``.  Nulls are skipped; a column
    with no value gives ``None`` entries.
    """
    keys = [by] if by else []
    base = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    if by:
        base = base.where(F.col(by).isNotNull())
    counts = base.groupBy(*keys).agg(*[F.count(c).alias(c) for c in cols])
    sizes = bounded_collect(counts, max(MAX_GROUPS // len(cols), 1), "quantile groups")
    if max((row[c] for row in sizes for c in cols), default=0) <= histogram_rows:
        levels = F.array(*[F.lit(float(p)) for p in probs])
        exact = base.groupBy(*keys).agg(*[F.percentile(c, levels).alias(c) for c in cols])
        return {
            (row[by] if by else None): {c: row[c] or [None] * len(probs) for c in cols}
            for row in exact.collect()
        }
    return _narrowed(base, cols, probs, by, sizes, histogram_rows)


def medians(df: DataFrame, cols: list[str], by: str | None = None) -> dict:
    """Exact medians, ``{group: {col: median}}`` (``{col: median}`` without ``by``)."""
    found = quantiles(df, cols, [0.5], by)
    flat = {g: {c: v[0] for c, v in per.items()} for g, per in found.items()}
    return flat if by else flat.get(None, dict.fromkeys(cols))


def _narrowed(base, cols, probs, by, sizes, limit) -> dict:
    keys = [by] if by else []
    spark = base.sparkSession
    long = base.unpivot(keys, cols, "feature", "value").where(F.col("value").isNotNull())
    key_type = base.schema[by].dataType.simpleString() if by else None
    schema = ", ".join(
        ([f"{by} {key_type}"] if by else [])
        + ["feature string", "prob double", "lo double", "hi double"]
    )
    total = {
        ((row[by] if by else None), c): row[c] for row in sizes for c in cols if row[c] > 0
    }
    state = {(g, f, p): (-math.inf, math.inf) for (g, f) in total for p in probs}
    grid = F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)])

    def with_brackets(rows):
        frame = local_rows(
            spark,
            [((g,) if by else ()) + (f, p, lo, hi) for (g, f, p), (lo, hi) in state.items()],
            schema,
        )
        return rows.join(F.broadcast(frame), [*keys, "feature"])

    below = F.col("value") < F.col("lo")
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    for _ in range(12):
        found = (
            with_brackets(long)
            .groupBy(*keys, "feature", "prob")
            .agg(
                F.count_if(below).alias("below"),
                F.count_if(inside).alias("inside"),
                F.approx_count_distinct(F.when(inside, F.col("value"))).alias("distinct"),
                F.percentile_approx(F.when(inside, F.col("value")), grid, _ACCURACY).alias("grid"),
            )
            .collect()
        )
        wide = False
        for row in found:
            key = ((row[by] if by else None), row["feature"], row["prob"])
            lo, hi = state[key]
            if row["distinct"] <= limit or lo == hi:
                continue
            wide = True
            # Grid entry i sits at 0-based rank ceil(i * m / _GRID) - 1, give or take the sketch error.
            rank = row["prob"] * (total[key[:2]] - 1) - row["below"]
            m = row["inside"]
            slack = m / _ACCURACY + 1
            left = math.floor(_GRID * (math.floor(rank) - slack) / m)
            right = math.ceil(_GRID * (math.ceil(rank) + 1 + slack) / m)
            state[key] = (
                row["grid"][left] if left > 0 else lo,
                row["grid"][right] if right < _GRID else hi,
            )
        if not wide:
            break

    # Exact ranks inside the brackets: one row per distinct value, rows below counted once.
    histogram = (
        with_brackets(long)
        .where(F.col("value") <= F.col("hi"))
        .groupBy(*keys, "feature", "prob", F.when(~below, F.col("value")).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    window = W.partitionBy(*keys, "feature", "prob").orderBy(F.col("value").asc_nulls_first())
    ranked = histogram.withColumn("last", F.sum("n").over(window) - 1).withColumn(
        "first", F.col("last") - F.col("n") + 1
    )
    sizes_frame = local_rows(
        spark,
        [((g,) if by else ()) + (f, n) for (g, f), n in total.items()],
        ", ".join(([f"{by} {key_type}"] if by else []) + ["feature string", "total long"]),
    )
    pos = F.col("prob") * (F.col("total") - 1)
    picked = (
        ranked.join(F.broadcast(sizes_frame), [*keys, "feature"])
        .withColumn("pos", pos)
        .groupBy(*keys, "feature", "prob", "pos")
        .agg(
            F.max(F.when(F.col("first") <= F.floor("pos"), F.col("value"))).alias("low"),
            F.max(F.when(F.col("first") <= F.ceil("pos"), F.col("value"))).alias("high"),
        )
        .collect()
    )
    out: dict = {}
    for (g, f) in total:
        out.setdefault(g, {c: [None] * len(probs) for c in cols})
    for row in picked:
        part = row["pos"] - math.floor(row["pos"])
        value = row["low"] * (1 - part) + row["high"] * part
        out[row[by] if by else None][row["feature"]][probs.index(row["prob"])] = value
    return out
