"""One-pass descriptive statistics over the company table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.operators.quantiles import medians, quantiles
from firmlens.session import bounded_collect, local_rows, lookup_join

# Columns are a few dozen, so per-column fitted values fit on the driver.
MAX_COLUMNS = 10_000


def dbl(c: str) -> Column:
    return F.col(c).cast("double")


def per_feature(df: DataFrame, cols: list[str], stats: dict, by: str | None = None) -> DataFrame:
    """One aggregate pass; one row per (group, feature) with the named ``stats``.

    ``stats`` maps an output name to a function from a column to an aggregate.
    """
    keys = [by] if by else []
    aggs = [fn(dbl(c)).alias(f"{c}|{name}") for c in cols for name, fn in stats.items()]
    wide = (df.where(F.col(by).isNotNull()) if by else df).groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}|{n}`").alias(n) for n in stats])
            for c in cols
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def quantile_frame(df: DataFrame, cols: list[str], names: dict[str, float], by: str | None = None) -> DataFrame:
    """Exact quantiles as rows (group, feature, one column per name)."""
    found = quantiles(df, cols, list(names.values()), by)
    key = f"{by} {df.schema[by].dataType.simpleString()}, " if by else ""
    rows = [
        ((g,) if by else ()) + (c, *values) for g, per in found.items() for c, values in per.items()
    ]
    return local_rows(
        df.sparkSession, rows, key + "feature string, " + ", ".join(f"{n} double" for n in names)
    )


def describe(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max; per group with ``by``."""
    keys = [by] if by else []
    moments = per_feature(
        df,
        cols,
        {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max},
        by,
    )
    quartiles = quantile_frame(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by)
    return moments.join(F.broadcast(quartiles), [*keys, "feature"], "left")


def missing_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null count and percentage per column."""
    n = F.count("*")
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count_if(F.col(c).isNull()).alias("missing"),
                (F.count_if(F.col(c).isNull()) * 100.0 / n).alias("missing_pct"),
            )
            for c in cols
        ]
    )
    return df.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def sparse_columns(df: DataFrame, cols: list[str], warn: float = 20.0, drop: float = 50.0) -> DataFrame:
    """Decision per column: drop above ``drop`` % missing, impute above ``warn`` %, else keep."""
    pct = F.col("missing_pct")
    return missing_profile(df, cols).withColumn(
        "decision", F.when(pct > drop, "drop").when(pct > warn, "impute").otherwise("keep")
    )


def drop_sparse_columns(df: DataFrame, cols: list[str], warn: float = 20.0, drop: float = 50.0) -> DataFrame:
    report = bounded_collect(sparse_columns(df, cols, warn, drop), MAX_COLUMNS, "columns")
    return df.drop(*[r["feature"] for r in report if r["decision"] == "drop"])


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.dropna(subset=subset)


def varying_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Numeric columns with two different values, each once (nulls do not count).

    Smallest and largest value are compared: a computed deviation of a constant
    is not always exactly 0.
    """
    cols = list(dict.fromkeys(cols))
    row = df.agg(*[(F.min(dbl(c)) < F.max(dbl(c))).alias(c) for c in cols]).first() if cols else {}
    return [c for c in cols if row[c]]


def drop_zero_variance(df: DataFrame, cols: list[str]) -> DataFrame:
    keep = set(varying_columns(df, cols))
    return df.drop(*[c for c in cols if c not in keep])


def cardinality(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact number of distinct values per column (nulls not counted)."""
    values = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    counted = values.where(F.col("value").isNotNull()).distinct().groupBy("feature").agg(
        F.count("*").alias("n_distinct")
    )
    every = local_rows(df.sparkSession, [(c,) for c in cols], "feature string")
    return every.join(counted, "feature", "left").select(
        "feature", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")
    )


def drop_single_category(df: DataFrame, cols: list[str]) -> DataFrame:
    rows = bounded_collect(cardinality(df, cols), MAX_COLUMNS, "columns")
    return df.drop(*[r["feature"] for r in rows if r["n_distinct"] <= 1])


def select_available_numeric(
    df: DataFrame, wanted: list[str] | None = None, exclude: list[str] | None = None
) -> list[str]:
    """Wanted numeric columns that exist, or every numeric column that is not excluded."""
    numeric = ("byte", "short", "int", "bigint", "float", "double", "decimal", "smallint", "tinyint")
    present = [c for c, t in df.dtypes if t.startswith(numeric)]
    if wanted is not None:
        return [c for c in wanted if c in present]
    return [c for c in present if c not in set(exclude or [])]


def dedupe(df: DataFrame) -> DataFrame:
    """Drop exact copies of whole rows; copies are merged before the shuffle."""
    return df.distinct()


def dedupe_report(df: DataFrame) -> DataFrame:
    """Rows before, after, and removed by ``dedupe``."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count("*").alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_before"),
            F.count("*").alias("rows_after"),
        )
        .withColumn("removed", F.col("rows_before") - F.col("rows_after"))
    )


def value_counts(df: DataFrame, col: str, by: str | None = None, normalize: bool = False) -> DataFrame:
    """Frequency of each non-null value; with ``normalize`` also its share within the group."""
    keys = [by] if by else []
    counts = (
        df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("value")).agg(F.count("*").alias("n"))
    )
    if not normalize:
        return counts
    if by:
        totals = df.where(F.col(col).isNotNull()).groupBy(by).agg(F.count("*").alias("total"))
        joined = lookup_join(counts, totals, [by])
    else:
        joined = counts.withColumn("total", F.lit(df.where(F.col(col).isNotNull()).count()))
    return joined.withColumn("share", F.col("n") / F.col("total")).drop("total")


def modes(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Most frequent value per column (ties: the smallest), per group with ``by``.

    Values are counted first, so a hot group is already merged when it is shuffled.
    """
    keys = [by] if by else []
    values = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        keys, cols, "feature", "value"
    )
    return (
        values.where(F.col("value").isNotNull())
        .groupBy(*keys, "feature", "value")
        .agg(F.count("*").alias("n"))
        .groupBy(*keys, "feature")
        .agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col("value"))).alias("top"))
        .select(*keys, "feature", F.col("top.value").alias("mode"))
    )


def impute(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str] = (),
    all_null: tuple = (0.0, "Unknown"),
) -> DataFrame:
    """Fill numbers with the exact median and categories with the smallest mode."""
    fills: dict = {}
    if numeric:
        middle = medians(df, numeric)
        fills = {
            c: F.coalesce(dbl(c), F.lit(float(all_null[0] if middle[c] is None else middle[c]))) for c in numeric
        }
    if categorical:
        top = {r["feature"]: r["mode"] for r in modes(df, list(categorical)).collect()}
        fills |= {c: F.coalesce(F.col(c), F.lit(top.get(c, all_null[1]))) for c in categorical}
    return df.withColumns(fills)


# --- outliers -----------------------------------------------------------------

def iqr_fences(df: DataFrame, cols: list[str], k: float = 1.5) -> dict[str, dict]:
    """Fences per column; columns without a positive spread are left out."""
    out = {}
    for c, (q1, q3) in quantiles(df, cols, [0.25, 0.75])[None].items():
        if q1 is not None and q3 - q1 > 0:
            iqr = q3 - q1
            out[c] = {"q1": q1, "q3": q3, "iqr": iqr, "lower": q1 - k * iqr, "upper": q3 + k * iqr}
    return out


def outside(c: str, fence: dict) -> Column:
    return F.coalesce((dbl(c) < fence["lower"]) | (dbl(c) > fence["upper"]), F.lit(False))


def outlier_report(df: DataFrame, fences: dict[str, dict]) -> DataFrame:
    """Rows outside the fences per column, one pass for all columns."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count_if(outside(c, f)).alias("n_out"),
                (F.count_if(outside(c, f)) * 100.0 / F.count("*")).alias("pct_out"),
                *[F.lit(f[name]).alias(name) for name in ("lower", "upper", "q1", "q3", "iqr")],
            )
            for c, f in fences.items()
        ]
    )
    return df.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def handle_outliers_iqr(
    df: DataFrame, cols: list[str], k: float = 1.5, method: str = "cap"
) -> tuple[DataFrame, DataFrame]:
    """Clip values to the fences, or remove rows with any value outside; plus the report."""
    fences = iqr_fences(df, cols, k)
    report = outlier_report(df, fences)
    if method == "cap":
        clipped = {
            c: F.when(F.col(c).isNotNull(), F.greatest(F.least(dbl(c), F.lit(f["upper"])), F.lit(f["lower"])))
            for c, f in fences.items()
        }
        return df.withColumns(clipped), report
    if method != "remove":
        raise ValueError(f"unknown method {method}")
    bad = F.lit(False)
    for c, f in fences.items():
        bad = bad | outside(c, f)
    return df.where(~bad), report


def iqr_outlier_report(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """Features that have rows outside the fences, with count and percentage."""
    report = outlier_report(df, iqr_fences(df, cols, k))
    return report.where(F.col("n_out") > 0).select("feature", "n_out", "pct_out")


# --- relations ----------------------------------------------------------------

def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson matrix in long form, pairwise complete; constant columns give null."""
    usable = varying_columns(df, cols)
    pairs = [(a, b) for i, a in enumerate(usable) for b in usable[i + 1:]]
    row = df.agg(*[F.corr(dbl(a), dbl(b)).alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else {}
    value = {}
    for a, b in pairs:
        value[a, b] = value[b, a] = row[f"{a}|{b}"]
    value |= {(c, c): 1.0 for c in usable}
    rows = [(a, b, value.get((a, b))) for a in cols for b in cols]
    return local_rows(df.sparkSession, rows, "feature_a string, feature_b string, corr double")


def group_zscore(df: DataFrame, metrics: list[str], by: str) -> DataFrame:
    """Adds ``<metric>_<by>_zscore``: (x - mean) / sample std within the group, 0 if no spread.

    Group moments are aggregated first and joined back, so a group with a third
    of all rows is never gathered in one task.
    """
    moments = df.groupBy(by).agg(
        *[F.avg(dbl(m)).alias(f"__mean_{m}") for m in metrics],
        *[F.when(F.min(dbl(m)) < F.max(dbl(m)), F.stddev_samp(dbl(m))).alias(f"__std_{m}") for m in metrics],
    )
    joined = lookup_join(df, moments.where(F.col(by).isNotNull()), [by])
    scores = {
        f"{m}_{by}_zscore": F.when(
            F.col(f"__std_{m}") > 0, (dbl(m) - F.col(f"__mean_{m}")) / F.col(f"__std_{m}")
        ).otherwise(F.when(F.col(by).isNotNull(), 0.0))
        for m in metrics
    }
    return joined.withColumns(scores).select(*df.columns, *scores)


def subset_zscore(df: DataFrame, cols: list[str], suffix: str = "_subset_zscore") -> DataFrame:
    """(x - mean) / (sample std + 1e-10) over the rows of ``df``."""
    row = df.agg(
        *[F.avg(dbl(c)).alias(f"{c}|m") for c in cols], *[F.stddev_samp(dbl(c)).alias(f"{c}|s") for c in cols]
    ).first()
    return df.withColumns(
        {
            f"{c}{suffix}": (dbl(c) - F.lit(row[f"{c}|m"]).cast("double"))
            / (F.lit(row[f"{c}|s"]).cast("double") + 1e-10)
            for c in cols
        }
    )


def metric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Valid count, mean, median, min and max of derived metrics that have values."""
    base = per_feature(df, cols, {"n": F.count, "mean": F.avg, "min": F.min, "max": F.max})
    middle = quantile_frame(df, cols, {"median": 0.5})
    return base.join(F.broadcast(middle), "feature").where(F.col("n") > 0)


def log_decision(df: DataFrame, cols: list[str], ratio: float = 100.0) -> dict[str, bool]:
    """Columns whose positive values span more than ``ratio``."""
    row = df.agg(
        *[F.max(F.when(dbl(c) > 0, dbl(c))).alias(f"{c}|hi") for c in cols],
        *[F.min(F.when(dbl(c) > 0, dbl(c))).alias(f"{c}|lo") for c in cols],
    ).first()
    return {
        c: row[f"{c}|hi"] is not None and row[f"{c}|hi"] / (row[f"{c}|lo"] + 1e-10) > ratio for c in cols
    }


def auto_log10(df: DataFrame, cols: list[str]) -> DataFrame:
    """log10(x + 1) where the column spans more than two decades, else unchanged."""
    wide = log_decision(df, cols)
    return df.withColumns({c: F.log10(dbl(c) + 1) if wide[c] else dbl(c) for c in cols})
