"""Queries: sources and sinks, column resolution, cleaning, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.catalog.base import (
    AS_OF_YEAR, LABELLED, MEGA, company, each, labelled, mega_labelled, on_company, query, r, rounded,
)
from firmlens.functions import clean, resolve
from firmlens.operators import profile_stats as ps
from firmlens.operators.segments import anomaly_rows, rows_in_clusters, split_small_clusters
from firmlens.plans.explore import explore
from firmlens.session import scratch_path
from firmlens.sources.files import read_companies, write_processed, write_segments

NUM = ["revenue", "market_value", "it_spend", "it_budget", "employees", "servers"]
RAW_NAMES = {
    "company_name": "Company Name", "country": "Country", "region": "Region", "revenue": "REVENUE (usd)",
    "market_value": "Market Value (USD)", "it_spend": "IT spend", "single_site_employees": "Employees Single Site",
    "employees": "Employees Total", "sites": "Company Sites", "servers": "No. of Servers",
    "storage": "No. of Storage Devices", "year_founded": "Year Found", "industry": "Industry",
    "sic_desc": "SIC Description", "entity_type": "Entity Type", "ownership_type": "Ownership Type",
}


def raw(spark, sf_dir):
    """The company table under source-like headers."""
    return company(spark, sf_dir).select(
        "company_id", *[F.col(c).alias(name) for c, name in RAW_NAMES.items()]
    )


# --- sources and sinks --------------------------------------------------------

@query("read_companies_csv", "S1", on_company(
    "SELECT company_id, company_name, country, employees, employee_band, round(revenue, 6) AS revenue FROM company"))
def _(spark, sf_dir):
    cols = ["company_id", "company_name", "country", "employees", "employee_band", "revenue"]
    path = scratch_path(spark, "companies") + ".csv"
    frame = company(spark, sf_dir).select(*cols)
    frame.write.option("header", True).csv(path)
    return rounded(read_companies(spark, path, schema=frame.schema))


@query("write_processed_parquet", "S2", on_company(
    "SELECT company_id, CAST(employees AS BIGINT) AS employees, round(revenue/nullif(employees,0), 6) "
    "AS revenue_per_employee FROM company"))
def _(spark, sf_dir):
    from firmlens.functions.ratios import revenue_per_employee

    path = scratch_path(spark, "processed")
    write_processed(
        company(spark, sf_dir).select(
            "company_id", F.col("employees").cast("bigint").alias("employees"),
            r(revenue_per_employee()).alias("revenue_per_employee"),
        ),
        path,
    )
    return read_companies(spark, path)


@query("write_segments", "S3", on_company(
    "SELECT cluster, count(*) AS n, CAST(sum(sites) AS BIGINT) AS sites FROM labelled GROUP BY cluster", LABELLED))
def _(spark, sf_dir):
    path = scratch_path(spark, "segments")
    write_segments(labelled(spark, sf_dir).select("company_id", "sites", "cluster"), path)
    return read_companies(spark, path).groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum("sites").alias("sites"))


@query("explore_table", "S5", on_company(
    each(["revenue", "employees", "single_site_employees", "market_value", "it_spend", "it_budget"],
         "SELECT 'missing' AS section, '{c}' AS subject, 'count' AS metric, "
         "CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) AS value FROM company")
    + " UNION ALL " + each(["revenue", "employees", "single_site_employees", "market_value", "it_spend", "it_budget"],
         "SELECT 'describe', '{c}', 'q50', round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) FROM company")
    + " UNION ALL " + each(["entity_type", "ownership_type"],
         "SELECT 'values', '{c}', {c}, CAST(count(*) AS DOUBLE) FROM company WHERE {c} IS NOT NULL GROUP BY {c}")))
def _(spark, sf_dir):
    table = explore(company(spark, sf_dir))
    return table.where(
        (F.col("section") == "missing") & (F.col("metric") == "count")
        | (F.col("section") == "describe") & (F.col("metric") == "q50")
        | (F.col("section") == "values")
    ).withColumn("value", r("value"))


# --- column resolution ----------------------------------------------------------

@query("resolve_column_first_match", "P1", on_company(
    "SELECT company_id, single_site_employees AS employees_by_pattern, round(market_value, 4) AS market_value "
    "FROM company"))
def _(spark, sf_dir):
    df = raw(spark, sf_dir)
    employees = resolve.resolve_column(df.columns, resolve.NUMERIC_PATTERNS["employees"])
    value = resolve.resolve_column(df.columns, resolve.NUMERIC_PATTERNS["market_value"])
    return df.select(
        "company_id", F.col(f"`{employees}`").alias("employees_by_pattern"),
        r(F.col(f"`{value}`"), 4).alias("market_value"))


@query("resolve_by_keywords", "P2", on_company(
    "SELECT company_id, CAST(employees AS BIGINT) AS employees_by_keywords, round(revenue, 6) AS revenue FROM company"))
def _(spark, sf_dir):
    df = raw(spark, sf_dir)
    employees = resolve.resolve_by_keywords(df.columns, *resolve.KEYWORDS["employees"])
    revenue = resolve.resolve_by_keywords(df.columns, *resolve.KEYWORDS["revenue"])
    return df.select(
        "company_id", F.col(f"`{employees}`").cast("bigint").alias("employees_by_keywords"),
        r(F.col(f"`{revenue}`")).alias("revenue"))


@query("resolve_geo_and_id", "P3", on_company(
    "SELECT company_name AS id, country AS geo_1, region AS geo_2 FROM company"))
def _(spark, sf_dir):
    df = raw(spark, sf_dir).drop("company_id")
    geo, identifier = resolve.resolve_geo_and_id(df.columns)
    return df.select(
        F.col(f"`{identifier}`").alias("id"), *[F.col(f"`{g}`").alias(f"geo_{i}") for i, g in enumerate(geo, 1)])


@query("standardise_columns", "P4", on_company(
    "SELECT company_id, company_name, country, region, round(revenue,6) AS revenue, round(market_value,4) "
    "AS market_value, round(it_spend,6) AS it_spend, CAST(employees AS BIGINT) AS employees, sites, servers, "
    "storage, year_founded FROM company"))
def _(spark, sf_dir):
    df = resolve.standardise(raw(spark, sf_dir), keep=("company_id",))
    return df.withColumns({"revenue": r("revenue"), "market_value": r("market_value", 4), "it_spend": r("it_spend"),
                           "employees": F.col("employees").cast("bigint")})


@query("resolve_roles", "P5", on_company(
    "SELECT company_id, CAST(single_site_employees AS BIGINT) AS employees, servers, sic_desc, entity_type FROM company"))
def _(spark, sf_dir):
    df = raw(spark, sf_dir)
    roles = resolve.resolve_roles(df.columns)
    return df.select(
        "company_id", F.col(f"`{roles.numeric['employees']}`").alias("employees"),
        F.col(f"`{roles.numeric['servers']}`").alias("servers"),
        F.col(f"`{roles.text['sic_desc']}`").alias("sic_desc"),
        F.col(f"`{roles.category['entity_type']}`").alias("entity_type"))


# --- cleaning -------------------------------------------------------------------

@query("coerce_numeric_text", "P6", on_company(
    "SELECT company_id, TRY_CAST(employee_band AS DOUBLE) AS band_number FROM company"))
def _(spark, sf_dir):
    return clean.coerce_numeric(company(spark, sf_dir), ["employee_band"]).select(
        "company_id", F.col("employee_band").alias("band_number"))


@query("nan_becomes_null", "P6,P15", on_company(
    "SELECT company_id, CASE WHEN company_id % 71 = 0 THEN NULL ELSE round(it_spend, 6) END AS it_spend FROM company"))
def _(spark, sf_dir):
    broken = company(spark, sf_dir).withColumn(
        "it_spend", F.when(F.col("company_id") % 71 == 0, F.lit(float("nan"))).otherwise(F.col("it_spend")))
    return clean.coerce_numeric(broken, ["it_spend"]).select("company_id", r("it_spend").alias("it_spend"))


DUP = "dup AS (SELECT * FROM company UNION ALL SELECT * FROM company WHERE status = 'Inactive')"


def duplicated(spark, sf_dir):
    base = company(spark, sf_dir)
    return base.unionByName(base.where(F.col("status") == "Inactive"))


@query("dedupe_rows", "P7", on_company(
    "SELECT company_id, company_name, country, CAST(employees AS BIGINT) AS employees "
    "FROM (SELECT DISTINCT * FROM dup) d", DUP))
def _(spark, sf_dir):
    return ps.dedupe(duplicated(spark, sf_dir)).select(
        "company_id", "company_name", "country", F.col("employees").cast("bigint").alias("employees"))


@query("dedupe_report", "P7", on_company(
    "SELECT (SELECT count(*) FROM dup) AS rows_before, (SELECT count(*) FROM company) AS rows_after, "
    "(SELECT count(*) FROM dup) - (SELECT count(*) FROM company) AS removed", DUP))
def _(spark, sf_dir):
    return ps.dedupe_report(duplicated(spark, sf_dir))


@query("filter_valid", "P8", on_company(
    "SELECT company_id, CAST(employees AS BIGINT) AS employees, round(revenue,6) AS revenue FROM company "
    "WHERE employees <> 0 AND market_value <> 0 AND revenue <> 0"))
def _(spark, sf_dir):
    return clean.filter_valid(company(spark, sf_dir)).select(
        "company_id", F.col("employees").cast("bigint").alias("employees"), r("revenue").alias("revenue"))


@query("available_numeric", "P9", on_company(
    "SELECT company_id, round(revenue,6) AS revenue, sites FROM company"))
def _(spark, sf_dir):
    df = company(spark, sf_dir)
    wanted = ps.select_available_numeric(df, wanted=["revenue", "sites", "no_such_column"])
    assert set(wanted) <= set(ps.select_available_numeric(df, exclude=["company_id"]))
    return df.select("company_id", *wanted).withColumn("revenue", r("revenue"))


SPARSE = ("sparse AS (SELECT *, CASE WHEN company_id % 5 < 3 THEN NULL ELSE sites END AS mostly_null, "
          "CASE WHEN company_id % 10 < 3 THEN NULL ELSE sites END AS partly_null FROM company)")


def sparse(spark, sf_dir):
    k = F.col("company_id")
    return company(spark, sf_dir).withColumns({
        "mostly_null": F.when(k % 5 < 3, None).otherwise(F.col("sites")),
        "partly_null": F.when(k % 10 < 3, None).otherwise(F.col("sites"))})


@query("sparse_columns", "P10", on_company(
    each(["mostly_null", "partly_null", "sites", "nace_desc"],
         "SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing, "
         "round(100.0*count(*) FILTER (WHERE {c} IS NULL)/count(*), 6) AS missing_pct, "
         "CASE WHEN 100.0*count(*) FILTER (WHERE {c} IS NULL)/count(*) > 50 THEN 'drop' "
         "WHEN 100.0*count(*) FILTER (WHERE {c} IS NULL)/count(*) > 20 THEN 'impute' ELSE 'keep' END AS decision "
         "FROM sparse"), SPARSE))
def _(spark, sf_dir):
    return rounded(ps.sparse_columns(sparse(spark, sf_dir), ["mostly_null", "partly_null", "sites", "nace_desc"]))


@query("drop_sparse_columns", "P10", on_company("SELECT company_id, partly_null FROM sparse", SPARSE))
def _(spark, sf_dir):
    df = sparse(spark, sf_dir).select("company_id", "mostly_null", "partly_null")
    return ps.drop_sparse_columns(df, ["mostly_null", "partly_null"])


@query("drop_null_rows", "P11", on_company(
    "SELECT company_id, revenue, it_budget FROM company "
    "WHERE revenue IS NOT NULL AND it_budget IS NOT NULL"))
def _(spark, sf_dir):
    return ps.drop_null_rows(company(spark, sf_dir).select("company_id", "revenue", "it_budget"),
                             ["revenue", "it_budget"])


@query("drop_zero_variance", "P12", on_company("SELECT company_id, sites, servers FROM company"))
def _(spark, sf_dir):
    df = company(spark, sf_dir).select("company_id", "sites", "servers").withColumn("constant", F.lit(7))
    return ps.drop_zero_variance(df, ["sites", "servers", "constant"])


@query("drop_single_category", "P13", on_company("SELECT company_id, entity_type FROM company"))
def _(spark, sf_dir):
    df = company(spark, sf_dir).select("company_id", "entity_type").withColumn("one_kind", F.lit("same"))
    return ps.drop_single_category(df, ["entity_type", "one_kind"])


@query("zeros_to_null", "P14", on_company(
    "SELECT company_id, CAST(nullif(employees,0) AS BIGINT) AS employees, round(nullif(revenue,0),6) AS revenue, "
    "nullif(servers,0) AS servers FROM company"))
def _(spark, sf_dir):
    df = clean.zeros_to_null(company(spark, sf_dir), ["employees", "revenue", "servers"])
    return df.select("company_id", F.col("employees").cast("bigint").alias("employees"),
                     r("revenue").alias("revenue"), "servers")


@query("scrub_non_finite", "P15", on_company(
    "SELECT company_id, round(CASE WHEN revenue > 0 THEN it_spend/revenue ELSE 0 END, 6) AS it_ratio FROM company"))
def _(spark, sf_dir):
    raw_ratio = F.when(F.col("revenue") > 0, F.col("it_spend") / F.nullif(F.col("revenue"), F.lit(0.0))).when(
        F.col("revenue") == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    df = company(spark, sf_dir).select("company_id", raw_ratio.alias("it_ratio"))
    return rounded(clean.scrub_non_finite(df, ["it_ratio"], to=0.0))


@query("require_target", "P16", on_company(
    "SELECT company_id, round(revenue,6) AS revenue FROM company WHERE revenue IS NOT NULL"))
def _(spark, sf_dir):
    return rounded(clean.require_target(company(spark, sf_dir), "revenue").select("company_id", "revenue"))


@query("filter_active", "P17", on_company("SELECT company_id, status FROM company WHERE lower(trim(status))='active'"))
def _(spark, sf_dir):
    return clean.filter_active(company(spark, sf_dir)).select("company_id", "status")


@query("rows_in_clusters", "P18", on_company("SELECT company_id, cluster FROM mega WHERE cluster IN (1, 9)", MEGA))
def _(spark, sf_dir):
    return rows_in_clusters(mega_labelled(spark, sf_dir), [1, 9]).select("company_id", "cluster")


@query("rows_outside_clusters", "P18", on_company(
    "SELECT company_id, cluster FROM mega WHERE cluster NOT IN (1, 9)", MEGA))
def _(spark, sf_dir):
    return rows_in_clusters(mega_labelled(spark, sf_dir), [1, 9], inside=False).select("company_id", "cluster")


@query("main_and_anomaly_rows", "U2,A21", on_company(
    "SELECT company_id, m.cluster, CASE WHEN n >= floor(t*0.5/100) THEN 'main' ELSE 'anomaly' END AS part "
    "FROM mega m JOIN (SELECT cluster, count(*) AS n FROM mega GROUP BY cluster) s ON s.cluster=m.cluster "
    "CROSS JOIN (SELECT count(*) AS t FROM mega) x", MEGA))
def _(spark, sf_dir):
    df = mega_labelled(spark, sf_dir).select("company_id", "cluster")
    main, anomaly = split_small_clusters(df)
    return rows_in_clusters(df, main).withColumn("part", F.lit("main")).unionByName(
        anomaly_rows(df, anomaly).select("company_id", "cluster").withColumn("part", F.lit("anomaly")))


# --- scalar parsing ---------------------------------------------------------------

@query("parse_range", "F1", on_company(
    "SELECT company_id, employee_band, CASE employee_band WHEN '1 to 10' THEN 5.5 WHEN '11-50' THEN 30.5 "
    "WHEN '51~200' THEN 125.5 WHEN '<10' THEN 5.0 WHEN '>1000' THEN 1500.0 WHEN '250' THEN 250.0 "
    "WHEN '-5' THEN -5.0 END::DOUBLE AS employees FROM company"))
def _(spark, sf_dir):
    return company(spark, sf_dir).select(
        "company_id", "employee_band", clean.parse_range(F.col("employee_band")).alias("employees"))


@query("combine_text", "F38", on_company(
    "SELECT company_id, coalesce(sic_desc,'') || ' ' || coalesce(naics_desc,'') || ' ' || coalesce(nace_desc,'') "
    "AS text FROM company"))
def _(spark, sf_dir):
    return company(spark, sf_dir).select(
        "company_id", clean.combine_text(["sic_desc", "naics_desc", "nace_desc"]).alias("text"))
