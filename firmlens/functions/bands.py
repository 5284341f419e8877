"""Ordered bands and names: stages, scales, brackets, interpretations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
MATURITY_YEARS = (5, 10, 20)
MATURITY_STAGES = ("Startup", "Growth", "Mature", "Established")
SCALE_NAMES = ("Micro", "Small", "Mid-Market", "Upper Mid-Market", "Enterprise")
EMPLOYEE_CUTS = (10, 50, 250, 1000)
REVENUE_CUTS = (1_000_000, 10_000_000, 100_000_000, 1_000_000_000)
AGE_CUTS = (5, 15, 30, 100)
AGE_BRACKETS = ("Startup", "Growth", "Mature", "Established", "Legacy")
SIZE_CUTS = (10, 50, 250, 1000, 10000)
SIZE_BRACKETS = ("Micro", "Small", "Medium", "Large", "Enterprise", "Mega-Corp")
DEVELOPED_MARKETS = ("USA", "UK", "Germany", "France", "Japan", "Singapore",
                     "United States", "United Kingdom", "Canada", "Australia")
# Interpretation bands: (lower bound, name), tested with ">" from the top.
BANDS = {
    "silhouette": ([(0.7, "strong"), (0.5, "reasonable"), (0.25, "weak")], "none"),
    "silhouette_tier": ([(0.5, "good"), (0.3, "moderate")], "weak"),
    "r2": ([(0.7, "strong"), (0.5, "moderate")], "limited"),
    "variance": ([(0.9, "excellent"), (0.7, "good"), (0.5, "moderate")], "limited"),
    "ari": ([(0.8, "highly stable"), (0.6, "moderately stable")], "unstable"),
}
P_VALUE_STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))
# ---------------------------------------------------------------------------


def _left_closed(value: Column, cuts, names) -> Column:
    out = F.when(value < cuts[0], names[0])
    for cut, name in zip(cuts[1:], names[1:]):
        out = out.when(value < cut, name)
    return out.otherwise(names[-1])


def _right_closed(value: Column, cuts, names) -> Column:
    out = F.when(value.isNull() | (value < 0), None).when(value <= cuts[0], names[0])
    for cut, name in zip(cuts[1:], names[1:]):
        out = out.when(value <= cut, name)
    return out.otherwise(names[-1])


def maturity_stage(age: Column, years=MATURITY_YEARS) -> Column:
    return F.when(age.isNull() | (age < 0), "Unknown").otherwise(_left_closed(age, years, MATURITY_STAGES))


def _scale(value: Column, cuts) -> Column:
    return F.when(value.isNull() | (value <= 0), "Unknown").otherwise(_left_closed(value, cuts, SCALE_NAMES))


def employee_scale(employees: Column) -> Column:
    return _scale(employees, EMPLOYEE_CUTS)


def revenue_scale(revenue: Column, cuts=None) -> Column:
    """Quintile cut points when given, else the fixed ones."""
    return _scale(revenue, cuts or REVENUE_CUTS)


def age_bracket(age: Column) -> Column:
    return _right_closed(age, AGE_CUTS, AGE_BRACKETS)


def size_bracket(employees: Column) -> Column:
    return _right_closed(employees, SIZE_CUTS, SIZE_BRACKETS)


def bracket_rank(bracket: Column, names=SIZE_BRACKETS) -> Column:
    """Ordinal of a bracket name, from 0."""
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), bracket).cast("int"), F.lit(0)) - 1


def is_developed_market(country: Column) -> Column:
    return F.coalesce(country.isin(*DEVELOPED_MARKETS).cast("int"), F.lit(0))


def interpretation(kind: str, value: Column) -> Column:
    bounds, last = BANDS[kind]
    out = F.when(value.isNull(), None)
    for bound, name in bounds:
        out = out.when(value > bound, name)
    return out.otherwise(last)


def p_value_stars(p: Column) -> Column:
    out = F.when(p.isNull(), None)
    for bound, name in P_VALUE_STARS:
        out = out.when(p < bound, name)
    return out.otherwise("ns")


def cluster_status(pct: Column) -> Column:
    return F.when(pct >= 40, "mega").when(pct < 0.5, "minor").otherwise("ok")


def persona_labels(employees: Column, it_ratio: Column, age: Column) -> Column:
    """Size, technology and stage words for a cluster's medians."""
    size = (
        F.when(employees < 50, "Micro").when(employees < 250, "Small").when(employees < 1000, "Medium")
        .otherwise("Enterprise")
    )
    tech = F.when(it_ratio > 0.05, "Tech-Forward").when(it_ratio > 0.02, "Digitally Moderate").otherwise(
        "Tech-Conservative"
    )
    stage = F.when(age < 5, "Startup").when(age < 15, "Growth Stage").otherwise("Established")
    return F.concat_ws(" ", size, tech, stage)


def persona_name(cluster: Column, labels: Column) -> Column:
    return F.concat(F.lit("Tier1_Cluster_"), cluster.cast("string"), F.lit(": "), labels)


def tier_name(mega: Column, sub: Column) -> Column:
    return F.concat(F.lit("Tier2_Subcluster_"), mega.cast("string"), F.lit("."), sub.cast("string"))


def anomaly_category(p99_efficiency: float | None, p10_age: float | None) -> Column:
    """Category of a company in a very small cluster; thresholds come from the whole table."""
    # Unknown values satisfy no condition.
    revenue, it_spend, age, efficiency = (
        F.col(c).cast("double") for c in ("revenue", "it_spend", "company_age", "revenue_per_emp")
    )
    it_ratio = F.when(revenue > 0, it_spend / F.nullif(revenue, F.lit(0.0))).otherwise(0.0)
    top = F.coalesce(efficiency > F.lit(p99_efficiency), F.lit(False))
    young = (age < F.lit(p10_age)) if (p10_age or 0) > 0 else F.lit(False)
    return (
        F.when(top & young, "True Unicorn")
        .when(top, "High Performer")
        .when((age > 30) & (revenue < 100_000), "Zombie Firm")
        .when((it_ratio > 0.10) | (it_spend > 1_000_000), "Tech-Heavy Outlier")
        .when(efficiency > 500_000, "Lean Operator")
        .otherwise("Strategic Outlier")
    )


def anomaly_flags(category: Column) -> Column:
    """Short reasons behind the category."""
    revenue, it_spend, employees = (F.col(c).cast("double") for c in ("revenue", "it_spend", "employees"))

    def flag(condition: Column, name: str) -> Column:
        return F.when(condition, F.lit(name))

    top = category.isin("True Unicorn", "High Performer")
    return F.array_compact(
        F.array(
            flag(top, "p99_efficiency"),
            flag(category == "True Unicorn", "young"),
            flag(category == "High Performer", "not_young"),
            flag(category == "Zombie Firm", "low_revenue_for_age"),
            flag((category == "Zombie Firm") & (employees > 10), "inefficient_headcount"),
            flag(category == "Tech-Heavy Outlier", "high_it_ratio"),
            flag((category == "Tech-Heavy Outlier") & (it_spend > 1_000_000), "high_it_spend"),
            flag(category == "Lean Operator", "lean"),
            flag((category == "Strategic Outlier") & (revenue > 0), "has_revenue"),
            flag((category == "Strategic Outlier") & (employees > 0), "has_employees"),
        )
    )
