"""Shapes of distributions per cluster: kernel densities, box whiskers and points beyond them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.operators.profile_stats import auto_log10, dbl, quantile_frame
from firmlens.session import bounded_collect, lit_map

# Cells that the values of a cluster are dealt to before smoothing, and points at which a density is given.
CELLS, POINTS = 400, 100
MAX_GROUPS = 10_000


def _long(df: DataFrame, features: list[str], by: str) -> DataFrame:
    """(by, feature, x) of all known values, wide columns on a log scale."""
    return auto_log10(df, features).select(by, *[dbl(c).alias(c) for c in features]).unpivot(
        by, features, "feature", "x").where(F.col("x").isNotNull() & ~F.isnan("x") & F.col(by).isNotNull())


def _of(values: dict, kind: str) -> Column:
    """The value of the row's (cluster, feature)."""
    return lit_map(values, "string", kind)[F.col("__group")]


def violin_densities(
    df: DataFrame, features: list[str], by: str = "cluster", cells: int = CELLS, points: int = POINTS
) -> DataFrame:
    """Gaussian kernel density of every cluster and feature at ``points`` places from its least to its greatest value.

    The width follows Scott's rule, n^(-1/5) sample deviations.  Each value is split over the two nearest of ``cells``
    evenly spaced cells in proportion to its nearness (linear binning), so rows are only counted: a cluster of any size
    becomes at most ``cells`` weights, and these are smoothed.  A cluster without spread gives one place of unknown
    density; one without known values gives none.
    """
    long = _long(df, features, by)
    kind = df.schema[by].dataType.simpleString()
    stats = bounded_collect(
        long.groupBy(by, "feature").agg(
            F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.stddev_samp("x").alias("sd")),
        MAX_GROUPS, "clusters x features")
    empty = "i int, x double, density double"
    if not stats:
        return df.sparkSession.createDataFrame([], f"{by} {kind}, feature string, {empty}")
    named = {f"{r[by]}/{r['feature']}": r for r in stats}
    of = {c: _of({g: r[c] for g, r in named.items()}, "double") for c in ("low", "high")}
    width = _of({g: (r["sd"] or 0.0) * r["n"] ** -0.2 for g, r in named.items()}, "double")
    count = _of({g: r["n"] for g, r in named.items()}, "double")
    group = F.concat_ws("/", F.col(by).cast("string"), "feature").alias("__group")
    place = F.when(of["high"] > of["low"], (F.col("x") - of["low"]) / (of["high"] - of["low"]) * (cells - 1)).otherwise(F.lit(0.0))
    left = F.floor("place").cast("int")
    part = F.col("place") - F.floor("place")
    dealt = long.select(by, "feature", "x", group).withColumn("place", place).select(
        by, "feature", "__group", F.explode(F.array(
            F.struct(left.alias("cell"), (1 - part).alias("weight")),
            F.struct((left + 1).alias("cell"), part.alias("weight")))).alias("p")).where(F.col("p.weight") > 0)
    binned = dealt.groupBy(by, "feature", "__group", F.col("p.cell").alias("cell")).agg(F.sum("p.weight").alias("weight"))
    # At most ``cells`` entries a group; in order of place, so sums do not depend on the partitioning.
    held = binned.groupBy(by, "feature", "__group").agg(F.sort_array(F.collect_list(F.struct("cell", "weight"))).alias("held"))
    held = held.withColumns({"low": of["low"], "step": (of["high"] - of["low"]) / (cells - 1), "span": of["high"] - of["low"],
                             "width": width, "n": count})
    spread = (F.col("span") > 0) & (F.col("width") > 0)
    steps = F.when(spread, F.sequence(F.lit(0), F.lit(points - 1))).otherwise(F.array(F.lit(0)))
    at = held.withColumn("i", F.explode(steps)).withColumn("x", F.col("low") + F.col("span") * F.col("i") / (points - 1))

    def kernel(total: Column, cell: Column) -> Column:
        z = (F.col("x") - F.col("low") - cell["cell"] * F.col("step")) / F.col("width")
        return total + cell["weight"] * F.exp(-0.5 * z * z)

    smooth = F.aggregate("held", F.lit(0.0), kernel) / (F.col("n") * F.col("width") * F.sqrt(2 * F.pi()))
    return at.select(by, "feature", "i", "x", F.when(spread, smooth).alias("density"))


def box_whiskers(df: DataFrame, features: list[str], by: str = "cluster", reach: float = 1.5) -> DataFrame:
    """Quartiles, mean, the outermost values within ``reach`` inter-quartile ranges of the box, and how many lie beyond."""
    scaled = auto_log10(df, features)
    long = _long(df, features, by)
    box = quantile_frame(scaled.where(F.col(by).isNotNull()), features, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by)
    rows = [r for r in bounded_collect(box, MAX_GROUPS, "clusters x features") if r["q50"] is not None]
    kind = df.schema[by].dataType.simpleString()
    if not rows:
        return df.sparkSession.createDataFrame(
            [], f"{by} {kind}, feature string, n long, mean double, q25 double, q50 double, q75 double, "
            "whisker_low double, whisker_high double, beyond long")
    low, mid, high = (_of({f"{r[by]}/{r['feature']}": r[q] for r in rows}, "double") for q in ("q25", "q50", "q75"))
    staged = long.withColumn("__group", F.concat_ws("/", F.col(by).cast("string"), "feature")).withColumns(
        {"q25": low, "q50": mid, "q75": high})
    inside = F.col("x").between(F.col("q25") - reach * (F.col("q75") - F.col("q25")), F.col("q75") + reach * (F.col("q75") - F.col("q25")))
    # A whisker never ends inside the box, even if no value lies between the quartile and its fence.
    return staged.groupBy(by, "feature").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.first("q25").alias("q25"), F.first("q50").alias("q50"), F.first("q75").alias("q75"),
        F.min(F.when(inside, F.col("x"))).alias("l"), F.max(F.when(inside, F.col("x"))).alias("h"), F.count_if(~inside).alias("beyond"),
    ).select(by, "feature", "n", "mean", "q25", "q50", "q75", F.least("l", "q25").alias("whisker_low"),
             F.greatest("h", "q75").alias("whisker_high"), "beyond")
