"""Registry of runnable queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.sources.company import PLAIN_COMPANY_SQL, cached_company

AS_OF_YEAR = 2026


@dataclass(frozen=True)
class Query:
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def register(fn):
        REGISTRY[name] = Query(ids, fn, sql)
        return fn

    return register


def on_company(body: str, *ctes: str) -> str:
    """SQL over the company table, with optional further common table expressions."""
    return "WITH " + ",\n".join([f"company AS ({PLAIN_COMPANY_SQL})", *ctes]) + "\n" + body


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached_company(spark, sf_dir)


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double, so the last bits of two engines do not matter."""
    value = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.round(value, digits)


def rounded(df: DataFrame, digits: int = 6, skip: tuple = ()) -> DataFrame:
    """All double columns rounded."""
    return df.select(
        *[
            r(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
            for c, t in df.dtypes
        ]
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with the fixed labelling used to check metric operators."""
    return company(spark, sf_dir).withColumn("cluster", (F.col("company_id") % 4).cast("int"))


LABELLED = "labelled AS (SELECT *, CAST(company_id % 4 AS INT) AS cluster FROM company)"


def mega_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with one dominant and one tiny cluster."""
    k = F.col("company_id")
    return company(spark, sf_dir).withColumn(
        "cluster", F.when(k % 10 < 6, 0).when(k < 10, 9).otherwise(1 + k % 3).cast("int")
    )


MEGA = (
    "mega AS (SELECT *, CAST(CASE WHEN company_id % 10 < 6 THEN 0 WHEN company_id < 10 THEN 9 "
    "ELSE 1 + company_id % 3 END AS INT) AS cluster FROM company)"
)


def each(cols: list[str], template: str) -> str:
    """UNION ALL of a SQL template over columns (``{c}`` is the column)."""
    return " UNION ALL ".join(template.format(c=c) for c in cols)
