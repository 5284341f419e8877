"""Derived feature sets that need fitted values: ages, indicators, engineered features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlens.functions import bands, ratios
from firmlens.functions.clean import zeros_to_null
from firmlens.operators.profile_stats import dbl, group_zscore, impute, subset_zscore
from firmlens.operators.quantiles import medians, quantiles
from firmlens.session import cut_lineage, lookup_join

# fixed values
GROWTH_WEIGHTS = {"revenue_per_employee": 0.4, "market_value_to_revenue_ratio": 0.3, "it_investment_intensity": 0.3}
ZERO_MEANS_MISSING = ["revenue", "employees", "it_spend", "market_value", "servers", "storage", "sites"]
ZSCORE_METRICS = ["it_spend_ratio", "revenue_per_emp", "technology_density"]


def derived_metrics(df: DataFrame, as_of_year: int) -> DataFrame:
    """The seven measures of the processed table, whichever have inputs."""
    has = set(df.columns)
    geo = [c for c in df.columns if any(w in c for w in ("country", "region", "geographic", "location"))]
    wanted = {
        "revenue_per_employee": ({"revenue", "employees"}, ratios.revenue_per_employee),
        "market_value_per_employee": ({"market_value", "employees"}, ratios.market_value_per_employee),
        "it_spend_ratio": ({"it_spend", "revenue"}, ratios.it_spend_ratio),
        "employees_per_site": ({"employees", "sites"}, ratios.employees_per_site),
        "technology_density_index": ({"servers", "storage", "employees"}, ratios.technology_density_index),
        "company_age": ({"year_founded"}, lambda: ratios.company_age(as_of_year)),
    }
    made = {name: make() for name, (needs, make) in wanted.items() if needs <= has}
    return df.withColumns(made | {"geographic_dispersion": ratios.geographic_dispersion(geo)})


DERIVED_METRICS = [
    "revenue_per_employee", "market_value_per_employee", "it_spend_ratio", "employees_per_site",
    "technology_density_index", "company_age", "geographic_dispersion",
]


def repaired_age(
    df: DataFrame, as_of_year: int, year: str = "year_founded", fitted: tuple[float, float] | None = None
) -> DataFrame:
    """Adds ``company_age`` with impossible years replaced by the median year.

    The median includes the impossible years.  Ages below 0 become 0, ages
    above 200 the median age.  ``fitted`` are (median year, median age) of an
    earlier table.
    """
    middle, middle_age = fitted or age_medians(df, as_of_year, year)
    age = _first_repair(as_of_year, year, middle)
    return df.withColumn("company_age", F.when(age > 200, F.lit(middle_age)).otherwise(age))


def _first_repair(as_of_year: int, year: str, middle: float | None):
    bad = (F.col(year) > as_of_year) | (F.col(year) < 1800)
    age = F.lit(float(as_of_year)) - F.when(bad, F.lit(middle)).otherwise(dbl(year))
    return F.when(age < 0, 0.0).otherwise(age)


def age_medians(df: DataFrame, as_of_year: int, year: str = "year_founded") -> tuple[float, float]:
    """Median founding year, and the median age after the first repair."""
    middle = medians(df, [year])[year]
    aged = df.select(_first_repair(as_of_year, year, middle).alias("age"))
    return middle, medians(aged, ["age"])["age"]


def it_intensity(df: DataFrame, missing: str = "median") -> DataFrame:
    """Adds ``it_investment_intensity``; missing parts become the median or zero."""
    fills = medians(df, ["it_budget", "it_spend"]) if missing == "median" else {}
    return df.withColumn(
        "it_investment_intensity", ratios.it_investment_intensity(fills.get("it_budget"), fills.get("it_spend"))
    )


def growth_potential(df: DataFrame, weights: dict[str, float] = GROWTH_WEIGHTS) -> DataFrame:
    """Adds the weighted sum of min-max scaled productivity, valuation and IT intensity."""
    parts = {
        "__rpe": F.coalesce(ratios.safe_ratio("revenue", "employees"), F.when(dbl("employees") > 0, None).otherwise(0.0)),
        "__mvr": F.coalesce(ratios.safe_ratio("market_value", "revenue"), F.when(dbl("revenue") > 0, None).otherwise(0.0)),
        "__iti": F.col("it_investment_intensity"),
    }
    staged = df.withColumns(parts)
    row = staged.agg(
        *[F.min(p).alias(f"{p}|lo") for p in parts], *[F.max(p).alias(f"{p}|hi") for p in parts]
    ).first()
    index = F.lit(0.0)
    for part, weight in zip(parts, weights.values()):
        lo, hi = row[f"{part}|lo"], row[f"{part}|hi"]
        if lo is not None:
            index = index + (F.col(part) - lo) / (hi - lo + 1e-10) * weight
    return staged.withColumn("growth_potential_index", index).drop(*parts)


def revenue_quintiles(df: DataFrame) -> tuple | None:
    """Cut points of positive revenue, or None if there is none."""
    cuts = quantiles(df.where(F.col("revenue") > 0), ["revenue"], [0.2, 0.4, 0.6, 0.8]).get(None, {})
    found = cuts.get("revenue", [None])
    return None if found[0] is None else tuple(found)


def calculate_indicators(df: DataFrame) -> DataFrame:
    """Adds whichever indicators have their inputs."""
    # One column of each pair is enough; the other one then counts as unknown.
    absent = []
    for pair in (("it_budget", "it_spend"), ("pcs", "laptops")):
        known = [c for c in pair if c in df.columns]
        absent += [c for c in pair if known and c not in known]
    df = df.withColumns({c: F.lit(None).cast("double") for c in absent})
    has = set(df.columns)
    out = df
    if {"revenue", "market_value"} <= has:
        out = out.withColumn("market_value_to_revenue_ratio", ratios.market_value_to_revenue_ratio())
    if {"revenue", "it_budget", "it_spend"} <= has:
        out = it_intensity(out, "median")
    simple = {
        "single_site_concentration": ({"single_site_employees", "employees"}, ratios.single_site_concentration),
        "workforce_tech_ratio": ({"pcs", "laptops", "employees"}, ratios.workforce_tech_ratio),
        "tech_sophistication_index": (
            {"employees"}, lambda: ratios.tech_sophistication_index([k for k in ratios.DEVICE_WEIGHTS if k in has])
        ),
        "mobile_ratio": ({"laptops", "desktops"}, ratios.mobile_ratio),
        "maturity_stage": ({"company_age"}, lambda: bands.maturity_stage(F.col("company_age"))),
        "employee_scale": ({"employees"}, lambda: bands.employee_scale(F.col("employees"))),
    }
    out = out.withColumns({name: make() for name, (needs, make) in simple.items() if needs <= has})
    if {"revenue", "employees", "market_value"} <= has and "it_investment_intensity" in out.columns:
        out = growth_potential(out)
    if "revenue" in has:
        out = out.withColumn("revenue_scale", bands.revenue_scale(F.col("revenue"), revenue_quintiles(df)))
    return out.drop(*absent)


def engineered_ratios(df: DataFrame) -> DataFrame:
    """Zeros to null, then the eleven ratios (not yet imputed)."""
    cleaned = zeros_to_null(df, ZERO_MEANS_MISSING)
    return cleaned.withColumns({name: make() for name, make in ratios.ENGINEERED_RATIOS.items()})


def category_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """Codes 0, 1, ... in alphabetical order of the distinct values; null gives -1.

    Only the distinct values are ordered and joined back: each range of them is
    numbered by itself and goes on behind the ranges before it.
    """
    values = df.where(F.col(col).isNotNull()).select(col).distinct()
    ordered = cut_lineage(values.orderBy(col).withColumn("__i", F.monotonically_increasing_id()))
    ranges = ordered.groupBy(F.shiftright("__i", 33).alias("__range")).agg(F.count("*").alias("n"))
    # One row per range partition.
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ordered.withColumn("__range", F.shiftright("__i", 33)).join(F.broadcast(starts), "__range").select(col, (F.col("__start") + place).cast("int").alias(out))
    return lookup_join(df, ranked, [col]).withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def engineer_features(df: DataFrame) -> DataFrame:
    """Zeros to null, ratios, median imputation, logs, brackets, codes, industry scores."""
    has = set(df.columns)
    out = impute_ratios(engineered_ratios(df))
    made = {f"{c}_log": ratios.log1p_of(c) for c in ratios.LOG_COLUMNS}
    made |= {"is_multi_site": ratios.is_multi_site(), "size_bracket": bands.size_bracket(F.col("employees"))}
    if "company_age" in has:
        made["age_bracket"] = bands.age_bracket(F.col("company_age"))
    if "country" in has:
        made["is_developed_market"] = bands.is_developed_market(F.col("country"))
    out = out.withColumns(made)
    if "country" in has:
        out = category_codes(out, "country", "region_encoded")
    if "industry" in has:
        out = group_zscore(out, ZSCORE_METRICS, "industry")
    return out


def impute_ratios(df: DataFrame) -> DataFrame:
    return impute(df, list(ratios.ENGINEERED_RATIOS))


REFINED_FEATURES = [
    *ratios.REFINED_RATIOS, "geo_dispersion_zscore", "revenue_subset_zscore", "it_spend_subset_zscore",
    "employees_subset_zscore", "market_value_subset_zscore",
]


def refined_features(df: DataFrame) -> DataFrame:
    """Features that tell apart the companies of one large cluster."""
    out = df.withColumns({name: make() for name, make in ratios.REFINED_RATIOS.items()})
    if "geographic_dispersion" in df.columns:
        out = subset_zscore(out, ["geographic_dispersion"], "_z").withColumnRenamed(
            "geographic_dispersion_z", "geo_dispersion_zscore"
        )
    return subset_zscore(out, ["revenue", "it_spend", "employees", "market_value"])
