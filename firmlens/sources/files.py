"""Reading company files and writing processed tables and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_companies(
    spark: SparkSession, path: str, format: str | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """Read a CSV or Parquet table; an empty one is an error.

    Give CSV files a ``schema``; without one all columns are text and are
    coerced later, which avoids a second scan for inference.
    """
    kind = format or ("csv" if path.rstrip("/").lower().endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        df = reader.option("header", True).option("escape", '"').csv(path)
    elif kind == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"unsupported format {kind}")
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def write_processed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist the cleaned and derived table as Parquet."""
    df.write.mode(mode).parquet(path)


def write_segments(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Export labelled rows: Parquet partitioned by cluster, or CSV with a header.

    No repartition by cluster comes before the write, so a cluster holding most
    rows is still written by many tasks.
    """
    if format == "csv":
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode(mode).partitionBy("cluster").parquet(path)
