"""Session helpers: lineage cuts and skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side is broadcast only when it is proven to have at most this many rows.
BROADCAST_ROWS = 100_000
# Copies of a lookup side that is too large to broadcast; a hot key is spread over them.
SALTS = 16


_local_folders: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``.

    A private folder is made only for local sessions that name none, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        app = spark.sparkContext.applicationId
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="firmlens-")
        folder = _local_folders[app]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder the cluster names and read it back.

    The table survives lost executors, and the plan starts afresh: the
    constraints a checkpointed plan carries along grow with every round of a loop.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``rows`` with a per-key ``lookup`` frame (unique on ``on``).

    The size of ``lookup`` is checked first.  A small one is broadcast, so
    ``rows`` is not shuffled.  A larger one is copied over ``SALTS`` salts and
    the rows of every key are spread over them, so no key lands in one task.
    Its copies are never broadcast, however small the files it is read from.
    """
    if lookup.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return rows.join(F.broadcast(lookup), on, how)
    salted_rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    salted_lookup = lookup.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    )
    return salted_rows.join(salted_lookup.hint("merge"), [*on, "__salt"], how).drop("__salt")


def grown_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the rows.

    Read back from packed files such tables look small enough to broadcast, and then pass whole through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame over a bounded list of fitted values (k clusters x d features)."""
    return spark.createDataFrame(rows, schema)


def bounded_collect(df: DataFrame, limit: int, what: str) -> list:
    """Collect a frame that must be small; refuse instead of truncating."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


# Rows per partition below which an iterative fit gains nothing from more tasks.
ROWS_PER_FIT_TASK = 20_000
# With more partitions than this a table is certainly not small.
MANY_PARTITIONS = 1_000


def spread_out(df: DataFrame) -> DataFrame:
    """Give a small table about one partition per core; large tables are left alone.

    Iterative fits start a task per partition and round, so both a single
    partition and hundreds of nearly empty ones are slow.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    present = df.rdd.getNumPartitions()
    if present < min(cores, 8):
        return df.repartition(cores)
    if cores < present <= MANY_PARTITIONS:
        wanted = max(cores, -(-df.count() // ROWS_PER_FIT_TASK))
        return df.coalesce(wanted) if wanted < present else df
    return df


def lit_map(values: dict, key_type: str, value_type: str) -> Column:
    """A literal map column from a small dict."""
    pairs = []
    for key, value in values.items():
        pairs += [F.lit(key).cast(key_type), F.lit(value).cast(value_type)]
    return F.create_map(*pairs).cast(f"map<{key_type},{value_type}>")
