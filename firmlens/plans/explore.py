"""First look at a table: which roles were found, what is missing, how values are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions.clean import parse_range
from firmlens.functions.resolve import Roles, resolve_roles
from firmlens.operators.profile_stats import describe, missing_profile, value_counts

# fixed values: the roles shown in the first look
NUMERIC_ROLES = ("revenue", "employees", "single_site_employees", "market_value", "it_spend", "it_budget")
CATEGORY_ROLES = ("entity_type", "ownership_type")


def explore(df: DataFrame, roles: Roles | None = None, top: int = 5) -> DataFrame:
    """Tidy rows (section, subject, metric, value)."""
    roles = roles or resolve_roles(df.columns)
    numeric = list(dict.fromkeys(roles.numeric[x] for x in NUMERIC_ROLES if x in roles.numeric))
    categorical = [roles.category[x] for x in CATEGORY_ROLES if x in roles.category]
    # Numbers may come as text, ranges among them; what cannot be read counts as missing.
    kinds = dict(df.dtypes)
    df = df.withColumns({c: parse_range(F.col(c)) for c in numeric if kinds[c] == "string"})
    missing = missing_profile(df, numeric).select("feature", F.explode(F.create_map(
        F.lit("count"), F.col("missing").cast("double"), F.lit("pct"), F.col("missing_pct"))).alias("metric", "value"))
    stats = describe(df, numeric).withColumn("n", F.col("n").cast("double"))
    spread = stats.unpivot("feature", [c for c in stats.columns if c != "feature"], "metric", "value")

    def tidy(part: DataFrame, section: str) -> DataFrame:
        return part.select(F.lit(section).alias("section"), F.col("feature").alias("subject"), "metric", "value")

    out = tidy(missing, "missing").unionByName(tidy(spread, "describe"))
    for c in categorical:
        head = value_counts(df, c).orderBy(F.desc("n"), "value").limit(top)
        out = out.unionByName(head.select(
            F.lit("values").alias("section"), F.lit(c).alias("subject"), F.col("value").alias("metric"),
            F.col("n").cast("double").alias("value")))
    return out
