"""What the segments look like: sizes, profiles, personas, gaps, anomalies.

Everything is grouped by the label column ``cluster``.  Groups are aggregated
with map-side partial aggregation, so one dominant cluster is no problem; the
resulting frames have one row per cluster (and feature) and are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlens.functions import bands
from firmlens.operators.profile_stats import (
    auto_log10, dbl, describe, log_decision, modes, per_feature, quantile_frame, value_counts,
)
from firmlens.operators.quantiles import medians, quantiles
from firmlens.session import bounded_collect, local_rows, lookup_join

# Labels are few by construction; more than this is refused rather than collected.
MAX_CLUSTERS = 10_000


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Rows and percentage per cluster."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # The window runs over one row per cluster.
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(0))))


def _sizes(df: DataFrame, label: str = "cluster") -> list:
    rows = bounded_collect(cluster_sizes(df, label), MAX_CLUSTERS, "clusters")
    return sorted(rows, key=lambda row: (-row["n"], row[label]))


def mega_clusters(df: DataFrame, threshold: float = 40.0) -> DataFrame:
    """Clusters with at least ``threshold`` % of all rows."""
    return cluster_sizes(df).where(F.col("pct") >= threshold)


def mega_cluster_ids(df: DataFrame, threshold: float = 40.0) -> list[int]:
    """Ids of dominant clusters, largest first."""
    return [row["cluster"] for row in _sizes(df) if row["pct"] >= threshold]


def split_small_clusters(df: DataFrame, threshold: float = 0.5) -> tuple[list[int], list[int]]:
    """Ids of main and of anomalously small clusters."""
    rows = _sizes(df)
    least = int(sum(row["n"] for row in rows) * threshold / 100)
    return (
        [row["cluster"] for row in rows if row["n"] >= least],
        [row["cluster"] for row in rows if row["n"] < least],
    )


def rows_in_clusters(df: DataFrame, ids: list[int], inside: bool = True) -> DataFrame:
    """Rows of the listed clusters, or all the others."""
    member = F.coalesce(F.col("cluster").isin(*ids), F.lit(False)) if ids else F.lit(False)
    return df.where(member if inside else ~member)


def anomaly_rows(df: DataFrame, ids: list[int]) -> DataFrame:
    return rows_in_clusters(df, ids).withColumn("original_cluster", F.col("cluster"))


def small_cluster_warning(df: DataFrame) -> DataFrame:
    """Clusters with fewer than 10 rows or 1 % of the table."""
    sized = cluster_sizes(df).withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0))))
    least = F.greatest(F.lit(10.0), F.col("total") * 0.01)
    return sized.where(F.col("n") < least).select("cluster", "n", "pct")


def balance_report(df: DataFrame, threshold: float = 40.0) -> DataFrame:
    """Number of clusters, largest share and size range."""
    return cluster_sizes(df).agg(
        F.count("*").alias("k"),
        F.max("pct").alias("largest_pct"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        (F.max("pct") < threshold).cast("int").alias("balanced"),
    )


def cluster_status(df: DataFrame) -> DataFrame:
    return cluster_sizes(df).withColumn("status", bands.cluster_status(F.col("pct")))


# --- profiles -------------------------------------------------------------------

def compare_clusters(df: DataFrame, features: list[str], feature: str | None = None) -> DataFrame:
    """One feature in detail, or mean and std of all features, per cluster."""
    if feature in features:
        stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "n": F.count}
        return per_feature(df, [feature], stats, "cluster").drop("feature")
    return per_feature(df, features, {"mean": F.avg, "std": F.stddev_samp}, "cluster")


def cluster_vs_rest(df: DataFrame, features: list[str], threshold: float = 0.1) -> DataFrame:
    """Features whose cluster mean differs from the mean of all other rows by more than the threshold.

    The other rows' mean follows from grand totals, so there is one pass and no self-join.
    """
    sums = per_feature(df, features, {"n": F.count, "total": F.sum}, "cluster")
    window = W.partitionBy("feature")  # one row per cluster
    rest = (F.sum("total").over(window) - F.col("total")) / F.nullif(
        F.sum("n").over(window) - F.col("n"), F.lit(0)
    )
    means = sums.withColumns(
        {"cluster_mean": F.col("total") / F.nullif(F.col("n"), F.lit(0)), "other_mean": rest}
    )
    gap = F.col("cluster_mean") - F.col("other_mean")
    return means.where(
        (F.abs("other_mean") > 1e-10) & (F.abs(gap) > threshold * F.abs("other_mean"))
    ).select("cluster", "feature", "cluster_mean", "other_mean", (gap / F.abs("other_mean") * 100).alias("difference_pct"))


def analyze_clusters(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Tidy rows (cluster, feature, stat, value, text): sizes, statistics, shares, top values."""
    sizes = cluster_sizes(df).select(
        "cluster", F.lit("size").alias("feature"), F.explode(F.create_map(
            F.lit("n"), F.col("n").cast("double"), F.lit("pct"), F.col("pct"))).alias("stat", "value"))
    stats = describe(df, numeric, "cluster")
    names = [c for c in stats.columns if c not in ("cluster", "feature")]
    tidy = stats.withColumn("n", F.col("n").cast("double")).unpivot(["cluster", "feature"], names, "stat", "value")
    out = sizes.unionByName(tidy).withColumn("text", F.lit(None).cast("string"))
    for c in categorical:
        out = out.unionByName(value_counts(df, c, "cluster", normalize=True).select(
            "cluster", F.lit(c).alias("feature"), F.lit("share").alias("stat"),
            F.col("share").alias("value"), F.col("value").alias("text")))
    if categorical:
        out = out.unionByName(modes(df, categorical, "cluster").select(
            "cluster", "feature", F.lit("mode").alias("stat"), F.lit(None).cast("double").alias("value"),
            F.col("mode").alias("text")))
    return out


def cluster_profiles(df: DataFrame, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    """Size with mean and median (numbers) or mode (categories) per cluster."""
    means = per_feature(df, numeric, {"mean": F.avg}, "cluster").join(
        F.broadcast(quantile_frame(df, numeric, {"median": 0.5}, "cluster")), ["cluster", "feature"], "left"
    ).withColumn("mode", F.lit(None).cast("string"))
    if categorical:
        means = means.unionByName(modes(df, list(categorical), "cluster"), allowMissingColumns=True)
    return means.join(F.broadcast(cluster_sizes(df).select("cluster", F.col("n").alias("size"))), "cluster")


def normalised_profile(df: DataFrame, features: list[str], stat: str = "mean", scale: str = "minmax") -> DataFrame:
    """Cluster means or medians scaled across clusters: ``minmax``, ``minmax_eps`` or ``max``."""
    if stat == "mean":
        values = per_feature(df, features, {"value": F.avg}, "cluster")
    else:
        values = quantile_frame(df, features, {"value": 0.5}, "cluster")
    window = W.partitionBy("feature")  # one row per cluster
    low, high = F.min("value").over(window), F.max("value").over(window)
    scaled = {
        "minmax": (F.col("value") - low) / F.nullif(high - low, F.lit(0.0)),
        "minmax_eps": (F.col("value") - low) / (high - low + 1e-10),
        "max": F.col("value") / F.nullif(high, F.lit(0.0)),
    }[scale]
    return values.withColumn("scaled", scaled)


def distribution_stats(df: DataFrame, feature: str) -> DataFrame:
    """Per cluster: n, quartiles, mean, min, max, on a log scale if the feature spans two decades."""
    log = log_decision(df, [feature])[feature]
    out = describe(auto_log10(df, [feature]), [feature], "cluster")
    return out.withColumn("log_scale", F.lit(int(log))).where(F.col("n") > 0)


def projection_cluster_stats(df: DataFrame, x: str = "pc1", y: str = "pc2") -> DataFrame:
    """Per cluster in a plane: size, share, centroid, mean distance to it, ranges."""
    centre = bounded_collect(
        df.groupBy("cluster").agg(
            F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"),
            F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max")),
        MAX_CLUSTERS, "clusters")
    frame = local_rows(df.sparkSession, [tuple(row) for row in centre],
                       f"cluster {df.schema['cluster'].dataType.simpleString()}, n long, cx double, cy double, "
                       "x_min double, x_max double, y_min double, y_max double")
    total = sum(row["n"] for row in centre)
    dist = F.sqrt((F.col(x) - F.col("cx")) ** 2 + (F.col(y) - F.col("cy")) ** 2)
    spread = df.join(F.broadcast(frame), "cluster").groupBy("cluster").agg(F.avg(dist).alias("mean_dist"))
    return spread.join(F.broadcast(frame), "cluster").withColumn("pct", F.col("n") * 100.0 / total)


def subcluster_summary(df: DataFrame, mega: int, features=("revenue", "it_spend", "employees")) -> DataFrame:
    """Size, share and medians of the sub-clusters of one cluster (label column ``sub``)."""
    middle = medians(df, list(features), "sub")
    rows = [(g, *[per[f] for f in features]) for g, per in middle.items()]
    frame = local_rows(df.sparkSession, rows, "sub int, " + ", ".join(f"median_{f} double" for f in features))
    return (
        cluster_sizes(df, "sub").join(F.broadcast(frame), "sub", "left")
        .withColumn("name", bands.tier_name(F.lit(mega), F.col("sub")))
    )


# --- personas ---------------------------------------------------------------------

def persona_summary(df: DataFrame) -> DataFrame:
    """Headcount and medians per persona, rounded to cents."""
    cols = [c for c in ("employees", "revenue", "it_spend", "it_spend_ratio") if c in df.columns]
    middle = medians(df, cols, "persona")
    rows = [(g, *[per[c] for c in cols]) for g, per in middle.items()]
    frame = local_rows(df.sparkSession, rows, "persona string, " + ", ".join(f"{c}_median double" for c in cols))
    out = (
        df.where(F.col("persona").isNotNull()).groupBy("persona")
        .agg(F.round(F.avg(dbl("employees")), 2).alias("employees_mean"), F.count("employees").alias("employees_count"))
        .join(F.broadcast(frame), "persona")
    )
    return out.withColumns({f"{c}_median": F.round(f"{c}_median", 2) for c in cols})


def build_personas(df: DataFrame, features: list[str]) -> DataFrame:
    """One row per cluster: name, size, market comparison, risk and opportunity.

    Needs ``employees, it_spend_ratio, company_age, revenue_per_emp,
    technology_density, it_spend_ratio_industry_zscore``.
    """
    market = ["revenue_per_emp", "it_spend_ratio", "technology_density"]
    needed = list(dict.fromkeys([*features, "employees", "it_spend_ratio", "company_age", *market]))
    by_cluster = medians(df, needed, "cluster")
    overall = quantiles(df, market, [0.25, 0.5])[None]
    frame = local_rows(
        df.sparkSession,
        [(g, *[per[c] for c in needed]) for g, per in by_cluster.items()],
        f"cluster {df.schema['cluster'].dataType.simpleString()}, " + ", ".join(f"{c}_median double" for c in needed),
    )
    moments = df.groupBy("cluster").agg(
        *[F.avg(dbl(c)).alias(f"{c}_mean") for c in features],
        *[F.stddev_samp(dbl(c)).alias(f"{c}_std") for c in features],
        F.avg("it_spend_ratio_industry_zscore").alias("mean_z"),
    )
    labels = bands.persona_labels(F.col("employees_median"), F.col("it_spend_ratio_median"), F.col("company_age_median"))
    z = F.col("mean_z")
    risks = F.array_compact(F.array(
        F.when(z < -0.5, "Under-investing in IT vs peers"),
        F.when(F.col("revenue_per_emp_median") < F.lit(overall["revenue_per_emp"][0]), "Low productivity per employee"),
    ))
    versus = {
        f"{m}_vs_market": (F.col(f"{m}_median") - overall[m][1]) / F.lit(overall[m][1]) * 100
        for m in market if overall[m][1]
    }
    return (
        cluster_sizes(df).join(F.broadcast(frame), "cluster", "left").join(F.broadcast(moments), "cluster", "left")
        .withColumns({
            "short_name": labels,
            "persona": bands.persona_name(F.col("cluster"), labels),
            "risk": F.nullif(F.concat_ws("; ", risks), F.lit("")),
            "opportunity": F.when(z < -0.5, "Potential for digital transformation services").when(
                z > 0.5, "Early adopter segment - premium pricing potential"),
            **versus,
        })
    )


def attach_personas(df: DataFrame, personas: DataFrame) -> DataFrame:
    """Adds the persona of each row's cluster; clusters without one are strategic outliers."""
    return lookup_join(df, personas.select("cluster", "persona"), ["cluster"]).withColumn(
        "persona", F.coalesce("persona", F.lit("Strategic Outlier"))
    )


# --- gaps and anomalies --------------------------------------------------------------

# fixed values: metric, gap name, deviation in % that counts
GAPS = (("it_spend", "IT Investment Gap", 25.0), ("revenue_per_emp", "Efficiency Gap", 30.0))


def gap_analysis(df: DataFrame, sub: str = "sub", mega: int | str | None = None) -> DataFrame:
    """Groups whose median is far from the median of all rows, with the market size of IT gaps."""
    metrics = [m for m, _, _ in GAPS]
    overall = medians(df, metrics)
    per_group = medians(df, metrics, sub)
    kind = df.schema[sub].dataType.simpleString()
    sizes = df.groupBy(sub).agg(F.count("*").alias("n"))
    rows = [
        (g, gap, m, per[m], overall[m], limit)
        for g, per in per_group.items() for m, gap, limit in GAPS
    ]
    frame = local_rows(df.sparkSession, rows,
                       f"{sub} {kind}, gap string, metric string, group_median double, overall_median double, limit double")
    deviation = (F.col("group_median") - F.col("overall_median")) / F.nullif(F.col("overall_median"), F.lit(0.0)) * 100
    name = F.col(sub).cast("string") if mega is None else bands.tier_name(F.lit(mega), F.col(sub))
    return (
        frame.join(sizes, sub).withColumn("deviation_pct", deviation)
        .where((F.col("overall_median") > 0) & (F.abs("deviation_pct") > F.col("limit")))
        .select(
            name.alias("segment"), "gap", "metric", "n", "group_median", "overall_median", "deviation_pct",
            F.when((F.col("metric") == "it_spend") & (F.col("deviation_pct") < 0),
                   F.abs(F.col("group_median") - F.col("overall_median")) * F.col("n")).alias("opportunity_value"),
        )
    )


def reference_percentiles(df: DataFrame) -> dict[str, float | None]:
    """P99 of revenue per employee and P10 of age over the whole table."""
    found = quantiles(df, ["revenue_per_emp", "company_age"], [0.1, 0.99])[None]
    return {"p99_revenue_per_emp": found["revenue_per_emp"][1], "p10_age": found["company_age"][0]}


def classify_anomalies(anomalies: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ``category`` and ``flags``; thresholds come from the ``reference`` table."""
    limits = reference_percentiles(reference)
    category = bands.anomaly_category(limits["p99_revenue_per_emp"], limits["p10_age"])
    return anomalies.withColumn("category", category).withColumn("flags", bands.anomaly_flags(F.col("category")))


def anomaly_categories(classified: DataFrame, top: int = 5) -> DataFrame:
    """Rows per category with its first ``top`` members (a top-k report)."""
    counts = classified.groupBy("category").agg(F.count("*").alias("n"))
    ranked = classified.withColumn(
        "rank", F.row_number().over(W.partitionBy("category").orderBy("company_id"))
    ).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(counts), "category").select("category", "n", "rank", "company_id", "original_cluster", "flags")


def rule_insights(df: DataFrame, features: list[str]) -> DataFrame:
    """Tidy insight rows: sizes, first three means, largest differences, outliers."""
    from firmlens.operators.profile_stats import iqr_outlier_report

    sizes = cluster_sizes(df).select(
        F.lit("segment_size").alias("insight"), F.col("cluster").cast("string").alias("subject"),
        F.lit("pct").alias("metric"), F.col("pct").alias("value"))
    means = per_feature(df, features[:3], {"value": F.avg}, "cluster").select(
        F.lit("segment_mean").alias("insight"), F.col("cluster").cast("string").alias("subject"),
        F.col("feature").alias("metric"), "value")
    order = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    first = W.partitionBy("cluster").orderBy(order)  # one row per feature
    differs = cluster_vs_rest(df, features).withColumn("rank", F.row_number().over(first)).where("rank <= 3").select(
        F.lit("segment_difference").alias("insight"), F.col("cluster").cast("string").alias("subject"),
        F.col("feature").alias("metric"), F.col("difference_pct").alias("value"))
    outliers = iqr_outlier_report(df, features).withColumn("order", order).orderBy("order").limit(5).select(
        F.lit("outliers").alias("insight"), F.col("feature").alias("subject"), F.lit("pct").alias("metric"),
        F.col("pct_out").alias("value"))
    return sizes.unionByName(means).unionByName(differs).unionByName(outliers)
