"""Cleaning expressions: coercion, nulls, ranges, validity filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_double(c: Column) -> Column:
    """A double, or null where the text is no plain number (never an error)."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text columns become doubles (null if unparsable); NaN and infinity become null."""
    kinds = dict(df.dtypes)
    make = {
        c: to_double(F.col(c)) if kinds[c] == "string" else finite(F.col(c))
        for c in cols
        if c in kinds
    }
    return df.withColumns(make)


def scrub_non_finite(df: DataFrame, cols: list[str], to: float | None = None) -> DataFrame:
    """NaN and infinity become null; with ``to``, all missing values become ``to``."""
    fill = (lambda c: c) if to is None else (lambda c: F.coalesce(c, F.lit(float(to))))
    return df.withColumns({c: fill(finite(F.col(c))) for c in cols})


def zeros_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in cols if c in df.columns})


def parse_range(c: Column) -> Column:
    """A number from texts such as ``1 to 10``, ``11-50``, ``51~200``, ``<10``, ``>1000``, ``250``."""
    text = F.trim(c.cast("string"))

    def midpoint(separator: str) -> Column:
        parts = F.split(F.lower(text), separator)
        return (to_double(F.get(parts, 0)) + to_double(F.get(parts, 1))) / 2

    bound = to_double(F.substr(text, F.lit(2)))
    digits = F.regexp_replace(text, r"[.\-]", "")
    return (
        F.when(F.lower(text).contains(" to "), midpoint(" to "))
        .when(text.contains("-") & ~text.startswith("-"), midpoint("-"))
        .when(text.contains("~"), midpoint("~"))
        .when(text.startswith("<"), bound * 0.5)
        .when(text.startswith(">"), bound * 1.5)
        .when(digits.rlike(r"^\d+$"), to_double(text))
    )


def filter_valid(df: DataFrame, cols: tuple[str, ...] = ("employees", "market_value", "revenue")) -> DataFrame:
    """Rows whose listed columns (those present) are all known and non-zero."""
    return df.where(is_valid(df.columns, cols))


def is_valid(columns: list[str], cols: tuple[str, ...] = ("employees", "market_value", "revenue")) -> Column:
    """Whether the listed columns (those present) are all known and non-zero."""
    present = [F.col(c).isNotNull() & (F.col(c) != 0) for c in cols if c in columns]
    return reduce(lambda a, b: a & b, present, F.lit(True))


def filter_active(df: DataFrame, status: str = "status") -> DataFrame:
    """Opt-in: rows whose status reads Active."""
    return df.where(F.lower(F.trim(F.col(status))) == "active")


def require_target(df: DataFrame, target: str, min_rows: int = 10) -> DataFrame:
    """Rows with a known target; refuses fewer than ``min_rows``."""
    known = df.where(F.col(target).isNotNull())
    if known.limit(min_rows).count() < min_rows:
        raise ValueError(f"fewer than {min_rows} rows with a known {target}")
    return known


def combine_text(cols: list[str]) -> Column:
    """Texts joined with single blanks, missing ones as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])
