"""Matching loosely named source columns to the names used here.

Only column names are looked at, so this is driver work on a short list; the
result is a plain ``select`` with aliases.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Name fragments per role.  A column matches a role if its lower-cased name
# contains any of the fragments.
NUMERIC_PATTERNS = {
    "revenue": ["revenue", "revenue_usd", "revenue (usd)", "annual_revenue", "total_revenue", "sales"],
    "market_value": ["market value", "market value (usd)", "marketvalue", "market_val", "market_val_usd",
                     "market_cap"],
    "employees": ["employee total", "employees total", "employee_total", "employees", "total_employees",
                  "employee_count", "num_employees", "employees_total"],
    "single_site_employees": ["employee single sites", "employees single site", "employee_single_sites",
                              "single_site_employees", "employees_single_site", "single_site_employee_count"],
    "it_budget": ["it budget", "it_budget", "it_budget_usd", "technology_budget", "tech_budget"],
    "it_spend": ["it spend", "it_spend", "it spending", "it_spending", "it_spending_usd",
                 "technology_spending", "it spending & budget", "it_spending_budget"],
    "pcs": ["no. of pc", "no of pc", "no. of pcs", "pc count", "num_pcs", "total_pcs"],
    "desktops": ["no. of desktops", "no of desktops", "desktop count", "num_desktops"],
    "laptops": ["no. of laptops", "no of laptops", "laptop count", "num_laptops"],
    "servers": ["no. of servers", "no of servers", "server count", "num_servers"],
    "storage": ["no. of storage devices", "no of storage devices", "storage_devices", "num_storage"],
    "routers": ["no. of routers", "no of routers", "router count", "num_routers"],
    "year_founded": ["year found", "year_found", "founded", "year founded", "year_founded",
                     "establishment_year", "incorporation_year"],
}
TEXT_PATTERNS = {
    "sic_desc": ["sic description", "sic_description", "sic desc", "8-digit sic description",
                 "8_digit_sic_description", "sic_8_digit", "sic code description"],
    "naics_desc": ["naics description", "naics_description", "naics desc", "naics code description"],
    "nace_desc": ["nace rev 2 description", "nace_rev_2_description", "nace description",
                  "nace_desc", "nace rev2 description"],
}
CATEGORY_PATTERNS = {
    "entity_type": ["entity type", "entity_type", "entity", "company_type", "legal_entity_type"],
    "ownership_type": ["ownership type", "ownership_type", "ownership", "owner_type"],
    "manufacturing_status": ["manufacturing status", "manufacturing_status", "is_manufacturer", "manufacturer"],
    "trade_status": ["import/export status", "import_export_status", "trade_status"],
    "franchise_status": ["franchise status", "franchise_status", "is_franchise"],
}
# All fragments must occur; the second list is tried when the first finds nothing.
KEYWORDS = {
    "revenue": (["revenue", "usd"], ["revenue"]),
    "market_value": (["market", "value", "usd"], ["market", "value"]),
    "it_spend": (["it", "spend"], None),
    "employees": (["employees", "total"], ["employees"]),
    "sites": (["sites", "company"], None),
    "servers": (["servers", "no"], None),
    "storage": (["storage", "devices"], None),
    "year_founded": (["year", "found"], None),
}
GEO_WORDS = ["country", "region", "geographic", "location"]
NAME_WORDS = ["company name", "company", "name"]
# ---------------------------------------------------------------------------


def resolve_column(columns: list[str], patterns: list[str]) -> str | None:
    """First column, in table order, whose name contains any pattern."""
    wanted = [p.lower() for p in patterns]
    return next((c for c in columns if any(p in c.lower() for p in wanted)), None)


def resolve_by_keywords(columns: list[str], all_of: list[str], fallback: list[str] | None = None) -> str | None:
    """First column whose name holds every keyword, else every fallback keyword."""
    for words in filter(None, (all_of, fallback)):
        for c in columns:
            if all(w in c.lower() for w in words):
                return c
    return None


def resolve_geo_and_id(columns: list[str]) -> tuple[list[str], str | None]:
    """Up to three geography columns, and the company identifier column."""
    geo = [c for c in columns if any(w in c.lower() for w in GEO_WORDS)][:3]
    return geo, resolve_column(columns, NAME_WORDS) or resolve_column(columns, ["id"])


def standard_names(columns: list[str]) -> dict[str, str]:
    """Source column -> standard name, in output order (identifier first)."""
    geo, identifier = resolve_geo_and_id(columns)
    picked: dict[str, str] = {}
    if identifier:
        picked[identifier] = "company_name"
    for name, (all_of, fallback) in KEYWORDS.items():
        source = resolve_by_keywords(columns, all_of, fallback)
        if source and source not in picked:
            picked[source] = name
    for c in geo:
        picked.setdefault(c, c.lower().replace(" ", "_").replace("/", "_"))
    return picked


def standardise(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep the recognised columns only, under their standard names."""
    names = standard_names([c for c in df.columns if c not in keep])
    return df.select(*keep, *[F.col(f"`{source}`").alias(name) for source, name in names.items()])


@dataclass(frozen=True)
class Roles:
    """Logical name -> physical column, per kind of column."""

    numeric: dict[str, str] = field(default_factory=dict)
    text: dict[str, str] = field(default_factory=dict)
    category: dict[str, str] = field(default_factory=dict)


def resolve_roles(columns: list[str]) -> Roles:
    """Find the numeric, text and categorical roles; at least one numeric is needed."""

    def hits(table):
        found = {role: resolve_column(columns, patterns) for role, patterns in table.items()}
        return {role: c for role, c in found.items() if c}

    roles = Roles(hits(NUMERIC_PATTERNS), hits(TEXT_PATTERNS), hits(CATEGORY_PATTERNS))
    if not roles.numeric:
        raise ValueError("no numeric role found among the columns")
    return roles
