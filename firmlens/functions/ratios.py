"""Efficiency, technology and maturity measures as column expressions.

All of them are built-in expressions, so they stay inside code generation and
need no shuffle.  Denominators of zero give null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

col = F.col


def _d(c: Column | str) -> Column:
    return (col(c) if isinstance(c, str) else c).cast("double")


def _zero(c: Column | str) -> Column:
    return F.coalesce(_d(c), F.lit(0.0))


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """Null unless the denominator is positive."""
    return F.when(_d(den) > 0, _d(num) / _d(den))


def ratio(num: Column | str, den: Column | str) -> Column:
    """Null where the denominator is zero or missing."""
    return _d(num) / F.nullif(_d(den), F.lit(0.0))


# --- the seven measures of the processed table ------------------------------

def revenue_per_employee() -> Column:
    return ratio("revenue", "employees")


def market_value_per_employee() -> Column:
    return ratio("market_value", "employees")


def it_spend_ratio() -> Column:
    return ratio("it_spend", "revenue")


def employees_per_site() -> Column:
    return ratio("employees", "sites")


def technology_density_index() -> Column:
    """Servers and storage per employee; null when there is neither."""
    devices = _zero("servers") + _zero("storage")
    known = (_zero("servers") != 0) | (_zero("storage") != 0)
    return F.when(known, ratio(devices, "employees"))


def company_age(as_of_year: int, year: str = "year_founded") -> Column:
    """Years since founding; null outside 0 to 500."""
    age = F.lit(as_of_year) - col(year)
    return F.when(age.between(0, 500), age.cast("double"))


def geographic_dispersion(geo_cols: list[str]) -> Column:
    """Number of known geography values; 1 if the table has no such column."""
    if not geo_cols:
        return F.lit(1)
    return sum((col(c).isNotNull().cast("int") for c in geo_cols), start=F.lit(0))


# --- indicators -------------------------------------------------------------

def market_value_to_revenue_ratio() -> Column:
    return safe_ratio("market_value", "revenue")


def it_investment_intensity(budget_fill: float | None = 0.0, spend_fill: float | None = 0.0) -> Column:
    """(budget + spend) / revenue, missing parts replaced by the given fills."""
    total = F.coalesce(_d("it_budget"), F.lit(budget_fill or 0.0)) + F.coalesce(
        _d("it_spend"), F.lit(spend_fill or 0.0)
    )
    return safe_ratio(total, "revenue")


def single_site_concentration() -> Column:
    return safe_ratio("single_site_employees", "employees")


def workforce_tech_ratio() -> Column:
    return safe_ratio(_zero("pcs") + _zero("laptops"), "employees")


# fixed values: weight of each device kind
DEVICE_WEIGHTS = {"servers": 3.0, "storage": 2.0, "routers": 1.0, "pcs": 0.5, "laptops": 0.5}


def tech_sophistication_index(present: list[str] | None = None) -> Column:
    kinds = [k for k in DEVICE_WEIGHTS if present is None or k in present]
    score = sum((_zero(k) * DEVICE_WEIGHTS[k] for k in kinds), start=F.lit(0.0))
    return safe_ratio(score, "employees")


def mobile_ratio() -> Column:
    return safe_ratio(_zero("laptops"), _zero("laptops") + _zero("desktops"))


# --- engineered features (inputs with zeros already turned to null) -----------

ENGINEERED_RATIOS = {
    "revenue_per_emp": lambda: ratio("revenue", "employees"),
    "it_spend_ratio": lambda: ratio("it_spend", "revenue"),
    "tech_intensity_log": lambda: F.log1p(_zero(ratio("it_spend", "employees"))),
    "market_value_per_employee": lambda: ratio("market_value", "employees"),
    "revenue_per_site": lambda: ratio("revenue", "sites"),
    "it_spend_per_employee": lambda: ratio("it_spend", "employees"),
    "technology_density": lambda: ratio(_zero("servers") + _zero("storage"), "employees"),
    "server_storage_ratio": lambda: ratio("servers", "storage"),
    "employees_per_site": lambda: ratio("employees", "sites"),
    "market_to_revenue_ratio": lambda: ratio("market_value", "revenue"),
    "capital_intensity": lambda: ratio("market_value", "employees"),
}

REFINED_RATIOS = {
    "tech_density_refined": lambda: ratio("it_spend", "servers"),
    "operating_leverage": lambda: ratio("revenue", "employees"),
    "it_spend_per_site": lambda: ratio("it_spend", "sites"),
    "servers_per_site": lambda: ratio("servers", "sites"),
    "storage_to_server_ratio": lambda: ratio("storage", "servers"),
    "mv_per_it_spend": lambda: ratio("market_value", "it_spend"),
    "revenue_per_year_age": lambda: ratio("revenue", "company_age"),
}

LOG_COLUMNS = ("revenue", "market_value", "it_spend", "employees")


def log1p_of(c: str) -> Column:
    return F.log1p(_zero(c))


def is_multi_site() -> Column:
    return F.coalesce((col("sites") > 1).cast("int"), F.lit(0))


def signed_log10(c: str) -> Column:
    """Opt-in transform log10(1 + |x|)."""
    return F.log10(1 + F.abs(_d(c)))
