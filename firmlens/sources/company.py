"""The ``company`` table: one row per customer, derived from the star schema.

The text runs unchanged on Spark SQL and on an ANSI engine, which is what lets
every query over it be compared value by value.  Money is summed as DECIMAL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firmlens.session import ROWS_PER_FIT_TASK

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")

COMPANY_SQL = """
WITH f AS (
 SELECT o_custkey AS k,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))*(1-CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS rev,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))*(1+CAST(l_tax AS DECIMAL(4,2)))) AS DOUBLE) AS gross,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))*CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS tax,
  CAST(sum(l_quantity) AS BIGINT) AS qty, count(DISTINCT l_suppkey) AS sites,
  sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS servers,
  sum(CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END) AS storage, count(*) AS nlines
 FROM {orders} JOIN {lineitem} ON l_orderkey=o_orderkey GROUP BY o_custkey)
SELECT CAST(c_custkey AS BIGINT) AS company_id, c_name AS company_name,
 CASE WHEN c_custkey%53=0 THEN NULL ELSE n_name END AS country, r_name AS region,
 c_mktsegment AS industry,
 CASE WHEN c_custkey%101=0 THEN CAST(0 AS DOUBLE) WHEN c_custkey%103=0 THEN NULL ELSE rev END AS revenue,
 gross*(1+c_custkey%7) AS market_value,
 tax*(c_custkey%5)/10 AS it_spend,
 CASE WHEN c_custkey%11=0 THEN NULL ELSE tax*(c_custkey%4)/8 END AS it_budget,
 CASE WHEN c_custkey%97=0 THEN 0 WHEN c_custkey%89=0 THEN NULL ELSE qty END AS employees,
 CAST(floor(qty*(c_custkey%10)/10) AS BIGINT) AS single_site_employees,
 CAST(sites AS BIGINT) AS sites, CAST(servers AS BIGINT) AS servers, CAST(storage AS BIGINT) AS storage,
 CAST(nlines*3 AS BIGINT) AS pcs, CAST((c_custkey%13)*4 AS BIGINT) AS laptops,
 CAST((c_custkey%6)*5 AS BIGINT) AS desktops, CAST(c_custkey%9 AS BIGINT) AS routers,
 CAST(1790+(c_custkey*37)%250 AS INT) AS year_founded,
 CASE c_custkey%9 WHEN 0 THEN '1 to 10' WHEN 1 THEN '11-50' WHEN 2 THEN '51~200' WHEN 3 THEN '<10'
  WHEN 4 THEN '>1000' WHEN 5 THEN '250' WHEN 6 THEN '-5' WHEN 7 THEN 'n/a' ELSE NULL END AS employee_band,
 CASE WHEN n_regionkey%2=0 THEN 'HQ' WHEN c_custkey%3=0 THEN 'Branch' ELSE 'Subsidiary' END AS entity_type,
 CASE c_custkey%4 WHEN 0 THEN 'Public' WHEN 1 THEN 'Private' WHEN 2 THEN 'Private' ELSE NULL END AS ownership_type,
 CASE WHEN c_custkey%50=0 THEN 'Inactive' ELSE 'Active' END AS status,
 concat(lower(c_mktsegment),' ',p_name) AS sic_desc, lower(p_type) AS naics_desc,
 CASE WHEN c_custkey%10=0 THEN NULL ELSE p_brand END AS nace_desc
FROM {customer} JOIN {nation} ON c_nationkey=n_nationkey JOIN {region} ON n_regionkey=r_regionkey
JOIN f ON f.k=c_custkey LEFT JOIN {part} ON p_partkey=c_custkey
"""

# The same text with plain table names, for the comparison engine.
PLAIN_COMPANY_SQL = COMPANY_SQL.format(**{t: t for t in TABLES})

# The totals in the form that Spark runs.  Beside count(DISTINCT) every line would carry all its sums through two more
# shuffles; here lines are added up per customer at once, and only pairs of keys travel for the distinct count.
TOTALS_SQL = """
WITH l AS (
 SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS discount,
  CAST(l_tax AS DECIMAL(4,2)) AS rate, l_quantity AS quantity, l_returnflag='R' AS returned, l_linestatus='O' AS open
 FROM {lineitem}),
m AS (
 SELECT o_custkey AS k, CAST(sum(price*(1-discount)) AS DOUBLE) AS rev, CAST(sum(price*(1+rate)) AS DOUBLE) AS gross,
  CAST(sum(price*rate) AS DOUBLE) AS tax, CAST(sum(quantity) AS BIGINT) AS qty,
  sum(CASE WHEN returned THEN 1 ELSE 0 END) AS servers, sum(CASE WHEN open THEN 1 ELSE 0 END) AS storage,
  count(*) AS nlines
 FROM {orders} JOIN l ON l_orderkey=o_orderkey GROUP BY o_custkey),
d AS (SELECT DISTINCT o_custkey AS k, l_suppkey FROM {orders} JOIN {lineitem} ON l_orderkey=o_orderkey),
s AS (SELECT k, count(l_suppkey) AS sites FROM d GROUP BY k),
f AS (SELECT m.*, sites FROM m JOIN s ON m.k=s.k)
"""
SPARK_COMPANY_SQL = TOTALS_SQL + COMPANY_SQL[COMPANY_SQL.index("SELECT CAST(c_custkey"):].replace("SELECT", "SELECT /*+ MERGE(f) */", 1)
# Tables that grow are joined by key on both sides: packed files look small enough to broadcast and then pass through the driver.
GROWING = ("part", "orders")

_cached: dict[tuple[str, str], DataFrame] = {}


def company_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company table of ``sf_dir``, read from parquet."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    frames |= {t: frames[t].hint("merge") for t in GROWING}
    return spark.sql(SPARK_COMPANY_SQL, **frames)


def cached_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``company_table`` persisted once per session and folder.

    Each analysis reads the base table several times (fit, then transform);
    spilled or lost blocks are recomputed from the parquet files.  The number of
    partitions follows from the customers, so nothing is derived only to be counted.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cached:
        customers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
        parts = max(spark.sparkContext.defaultParallelism, -(-customers // ROWS_PER_FIT_TASK))
        _cached[key] = company_table(spark, sf_dir).repartition(parts, "company_id").persist()
    return _cached[key]
