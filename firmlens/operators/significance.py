"""Significance tests of categories and features against the cluster label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlens.functions.bands import p_value_stars
from firmlens.functions.special import chi2_sf, f_sf
from firmlens.operators.profile_stats import auto_log10, dbl
from firmlens.session import bounded_collect, local_rows


def contingency(df: DataFrame, cat: str, cluster: str = "cluster") -> DataFrame:
    """Counts over the full grid of categories and clusters, zero cells included.

    Marginal totals travel with every cell.  The grid has one row per category
    and cluster, whatever the number of companies.
    """
    cells = (
        df.where(F.col(cat).isNotNull() & F.col(cluster).isNotNull())
        .groupBy(F.col(cat).alias("category"), F.col(cluster).alias("cluster"))
        .agg(F.count("*").alias("observed"))
    )
    clusters = bounded_collect(cells.groupBy("cluster").agg(F.sum("observed").alias("n")), 10_000, "clusters")
    columns = sorted((row["cluster"], row["n"]) for row in clusters)
    kind = cells.schema["cluster"].dataType.simpleString()
    grid = F.from_json(F.lit("[]"), f"array<struct<cluster:{kind},column_total:bigint>>") if not columns else F.array(
        *[F.struct(F.lit(c).cast(kind).alias("cluster"), F.lit(n).cast("bigint").alias("column_total")) for c, n in columns])
    rows = cells.groupBy("category").agg(F.sum("observed").alias("row_total"))
    full = rows.withColumn("g", F.explode(grid)).select("category", "row_total", "g.*")
    total = sum(n for _, n in columns)
    return (
        full.join(cells, ["category", "cluster"], "left")
        .withColumn("observed", F.coalesce("observed", F.lit(0)))
        .withColumn("expected", F.col("row_total") * F.col("column_total") / F.lit(float(total or 1)))
    )


def crosstab(df: DataFrame, cat: str, clusters: list[int]) -> DataFrame:
    """Wide contingency table with one column per cluster."""
    wide = df.where(F.col(cat).isNotNull()).groupBy(F.col(cat).alias("category")).pivot("cluster", clusters).count()
    return wide.select("category", *[F.coalesce(f"`{c}`", F.lit(0)).alias(f"cluster_{c}") for c in clusters])


def chi_square(df: DataFrame, cats: list[str]) -> DataFrame:
    """Chi-square of each category column against the cluster, with assumption checks.

    With one degree of freedom the continuity correction is applied.  Columns
    that do not give at least a 2 x 2 table are left out.  All columns are
    counted in one pass; everything else is made from the cells.
    """
    if not cats:
        return local_rows(df.sparkSession, [], "feature string, chi2 double, dof int, p double, min_expected double, "
                          "cells_below_5 int, assumption_violated int")
    tall = df.where(F.col("cluster").isNotNull()).select(
        "cluster", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in cats])).alias("x"))
    cells = tall.where(F.col("x.category").isNotNull()).groupBy("x.feature", "x.category", "cluster").agg(
        F.count("*").alias("observed")).persist()
    rows = cells.groupBy("feature", "category").agg(F.sum("observed").alias("row_total"))
    columns = cells.groupBy("feature", "cluster").agg(F.sum("observed").alias("column_total"))
    totals = cells.groupBy("feature").agg(F.sum("observed").alias("total"))
    grid = rows.join(columns, "feature").join(totals, "feature").join(cells, ["feature", "category", "cluster"], "left")
    observed = F.coalesce("observed", F.lit(0))
    gridded = grid.withColumn("expected", F.col("row_total") * F.col("column_total") / F.col("total").cast("double"))
    gap = F.abs(observed - F.col("expected"))
    corrected = gap - F.least(F.lit(0.5), gap)
    found = gridded.groupBy("feature").agg(
        F.sum(gap**2 / F.col("expected")).alias("plain"),
        F.sum(corrected**2 / F.col("expected")).alias("yates"),
        F.count_distinct("category").alias("r"),
        F.count_distinct("cluster").alias("c"),
        F.min("expected").alias("min_expected"),
        F.count_if(F.col("expected") < 5).alias("cells_below_5"),
    ).collect()  # one row per column tested
    cells.unpersist()
    results = []
    for row in sorted(found, key=lambda r: cats.index(r["feature"])):
        if row["r"] < 2 or row["c"] < 2:
            continue
        dof = (row["r"] - 1) * (row["c"] - 1)
        chi2 = row["yates"] if dof == 1 else row["plain"]
        results.append((row["feature"], float(chi2), int(dof), chi2_sf(chi2, dof), float(row["min_expected"]),
                        int(row["cells_below_5"]), int(row["min_expected"] < 5)))
    return local_rows(df.sparkSession, results,
                      "feature string, chi2 double, dof int, p double, min_expected double, cells_below_5 int, "
                      "assumption_violated int")


def adjust_pvalues(tests: DataFrame, method: str = "bonferroni", p: str = "p") -> DataFrame:
    """Adds ``p_adjusted``; a single test is left as it is.

    ``bonferroni``, ``bh`` (Benjamini-Hochberg) or ``by`` (Benjamini-Yekutieli).
    The windows run over one row per test.
    """
    every = W.partitionBy(F.lit(0))
    m = F.count(F.lit(1)).over(every)
    if method == "bonferroni":
        return tests.withColumn("p_adjusted", F.least(F.col(p) * m, F.lit(1.0)))
    rank = F.row_number().over(every.orderBy(F.col(p), "feature"))
    factor = F.lit(1.0)
    if method == "by":
        factor = F.aggregate(F.sequence(F.lit(1), F.col("__m").cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / i)
    elif method != "bh":
        raise ValueError(f"unknown correction {method}")
    staged = tests.withColumn("__m", m).withColumn("__rank", rank)
    raised = F.when(F.col("__m") == 1, F.col(p)).otherwise(F.col(p) * F.col("__m") * factor / F.col("__rank"))
    largest_first = every.orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, 0)
    return staged.withColumn("__raised", raised).withColumn(
        "p_adjusted", F.least(F.min("__raised").over(largest_first), F.lit(1.0))
    ).drop("__m", "__rank", "__raised")


def chi_square_all(df: DataFrame, cats: list[str], alpha: float = 0.05, correction: str = "bonferroni") -> DataFrame:
    """Chi-square tests with adjusted p-values and a significance flag."""
    tests = adjust_pvalues(chi_square(df, cats), correction)
    return tests.withColumn("significant", (F.col("p_adjusted") < alpha).cast("int"))


def anova(df: DataFrame, features: list[str]) -> DataFrame:
    """One-way F test per feature across clusters, on a log scale where the feature spans two decades."""
    scaled = auto_log10(df, features)
    aggs = []
    for c in features:
        aggs += [F.count(dbl(c)).alias(f"{c}|n"), F.avg(dbl(c)).alias(f"{c}|mean"),
                 (F.var_pop(dbl(c)) * F.count(dbl(c))).alias(f"{c}|ss")]
    groups = bounded_collect(scaled.groupBy("cluster").agg(*aggs), 10_000, "clusters")
    rows = []
    for c in features:
        parts = [(g[f"{c}|n"], g[f"{c}|mean"], g[f"{c}|ss"] or 0.0) for g in groups if g[f"{c}|n"] > 0]
        n = sum(p[0] for p in parts)
        if len(parts) < 2 or n <= len(parts):
            continue
        grand = sum(k * m for k, m, _ in parts) / n
        between = sum(k * (m - grand) ** 2 for k, m, _ in parts)
        within = sum(ss for _, _, ss in parts)
        d1, d2 = len(parts) - 1, n - len(parts)
        stat = (between / d1) / (within / d2) if within > 0 else float("inf")
        rows.append((c, stat, d1, d2, f_sf(stat, d1, d2)))
    out = local_rows(df.sparkSession, rows, "feature string, f double, df_between int, df_within long, p double")
    return out.withColumn("stars", p_value_stars(F.col("p")))
