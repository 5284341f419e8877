"""Queries: derived measures, indicators, engineered features."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.catalog.base import AS_OF_YEAR, company, each, on_company, query, r, rounded
from firmlens.functions import bands, ratios
from firmlens.operators import features as ft
from firmlens.operators import profile_stats as ps
from firmlens.operators.segments import anomaly_categories, anomaly_rows, classify_anomalies

Y = AS_OF_YEAR


def one(name, ids, expr_sql, make, fit=None):
    """Register a query that computes one measure per company."""

    @query(name, ids, on_company(f"SELECT company_id, {expr_sql} AS {name} FROM company"))
    def _(spark, sf_dir):
        return company(spark, sf_dir).select("company_id", make().alias(name))


def div(a, b):
    return f"round(CAST({a} AS DOUBLE)/nullif({b},0), 6)"


def pos(a, b):
    return f"round(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE)/{b} END, 6)"


one("company_age_strict", "F2", f"CAST(CASE WHEN {Y}-year_founded BETWEEN 0 AND 500 THEN {Y}-year_founded END AS DOUBLE)",
    lambda: ratios.company_age(Y))
one("revenue_per_employee", "F5", div("revenue", "employees"), lambda: r(ratios.revenue_per_employee()))
one("market_value_per_employee", "F6", div("market_value", "employees"), lambda: r(ratios.market_value_per_employee()))
one("it_spend_ratio", "F7", div("it_spend", "revenue"), lambda: r(ratios.it_spend_ratio()))
one("employees_per_site", "F8", div("employees", "sites"), lambda: r(ratios.employees_per_site()))
one("technology_density_index", "F9",
    "round(CASE WHEN coalesce(servers,0)<>0 OR coalesce(storage,0)<>0 THEN "
    "CAST(coalesce(servers,0)+coalesce(storage,0) AS DOUBLE)/nullif(employees,0) END, 6)",
    lambda: r(ratios.technology_density_index()))
one("geographic_dispersion", "F10", "CAST((country IS NOT NULL)::INT + (region IS NOT NULL)::INT AS INT)",
    lambda: ratios.geographic_dispersion(["country", "region"]))
one("market_value_to_revenue_ratio", "F4,F11", pos("market_value", "revenue"),
    lambda: r(ratios.market_value_to_revenue_ratio()))
one("it_investment_intensity_zero", "F12", pos("(coalesce(it_budget,0)+coalesce(it_spend,0))", "revenue"),
    lambda: r(ratios.it_investment_intensity()))
one("single_site_concentration", "F13", pos("single_site_employees", "employees"),
    lambda: r(ratios.single_site_concentration()))
one("workforce_tech_ratio", "F14", pos("(coalesce(pcs,0)+coalesce(laptops,0))", "employees"),
    lambda: r(ratios.workforce_tech_ratio()))
one("tech_sophistication_index", "F15",
    pos("(3*coalesce(servers,0)+2*coalesce(storage,0)+coalesce(routers,0)+0.5*coalesce(pcs,0)+0.5*coalesce(laptops,0))",
        "employees"), lambda: r(ratios.tech_sophistication_index()))
one("mobile_ratio", "F16", pos("coalesce(laptops,0)", "(coalesce(laptops,0)+coalesce(desktops,0))"),
    lambda: r(ratios.mobile_ratio()))

SCALE = ("CASE WHEN {v} IS NULL OR {v} <= 0 THEN 'Unknown' WHEN {v} < {a} THEN 'Micro' WHEN {v} < {b} THEN 'Small' "
         "WHEN {v} < {c} THEN 'Mid-Market' WHEN {v} < {d} THEN 'Upper Mid-Market' ELSE 'Enterprise' END")
one("employee_scale", "F20", SCALE.format(v="employees", a=10, b=50, c=250, d=1000),
    lambda: bands.employee_scale(F.col("employees")))
one("revenue_scale_fixed", "F19", SCALE.format(v="revenue", a=1000000, b=10000000, c=100000000, d=1000000000),
    lambda: bands.revenue_scale(F.col("revenue")))
AGE = f"({Y}-year_founded)"
one("maturity_stage", "F18",
    f"CASE WHEN {AGE} IS NULL OR {AGE} < 0 THEN 'Unknown' WHEN {AGE} < 5 THEN 'Startup' WHEN {AGE} < 10 THEN 'Growth' "
    f"WHEN {AGE} < 20 THEN 'Mature' ELSE 'Established' END",
    lambda: bands.maturity_stage(F.lit(Y) - F.col("year_founded")))
one("age_bracket", "F25",
    f"CASE WHEN {AGE} < 0 THEN NULL WHEN {AGE} <= 5 THEN 'Startup' WHEN {AGE} <= 15 THEN 'Growth' WHEN {AGE} <= 30 "
    f"THEN 'Mature' WHEN {AGE} <= 100 THEN 'Established' ELSE 'Legacy' END",
    lambda: bands.age_bracket(F.lit(Y) - F.col("year_founded")))
SIZE = ("CASE WHEN employees IS NULL OR employees < 0 THEN NULL WHEN employees <= 10 THEN 'Micro' WHEN employees <= 50 THEN 'Small' "
        "WHEN employees <= 250 THEN 'Medium' WHEN employees <= 1000 THEN 'Large' WHEN employees <= 10000 THEN 'Enterprise' "
        "ELSE 'Mega-Corp' END")
one("size_bracket", "F26", SIZE, lambda: bands.size_bracket(F.col("employees")))
one("size_bracket_rank", "F26",
    f"CAST(list_position(['Micro','Small','Medium','Large','Enterprise','Mega-Corp'], {SIZE}) - 1 AS INT)",
    lambda: bands.bracket_rank(bands.size_bracket(F.col("employees"))))
one("is_multi_site", "F24", "CASE WHEN sites > 1 THEN 1 ELSE 0 END", ratios.is_multi_site)
one("is_developed_market", "F27",
    "CASE WHEN upper(country) IN ('FRANCE','GERMANY','JAPAN','UNITED STATES','UNITED KINGDOM','CANADA') THEN 1 ELSE 0 END",
    lambda: bands.is_developed_market(F.initcap("country")))
one("revenue_log", "F23", "round(ln(1+coalesce(revenue,0)), 6)", lambda: r(ratios.log1p_of("revenue")))
one("signed_log10_it_spend", "F32", "round(log10(1+abs(it_spend)), 6)", lambda: r(ratios.signed_log10("it_spend")))


@query("company_age_repaired", "F3", on_company(
    f"SELECT company_id, CAST(CASE WHEN a < 0 THEN 0 WHEN a > 200 THEN ma ELSE a END AS DOUBLE) AS company_age "
    "FROM aged CROSS JOIN (SELECT quantile_cont(CASE WHEN a < 0 THEN 0 ELSE a END, 0.5) AS ma FROM aged) x",
    f"my AS (SELECT quantile_cont(CAST(year_founded AS DOUBLE), 0.5) AS m FROM company)",
    f"aged AS (SELECT company_id, {Y} - CASE WHEN year_founded > {Y} OR year_founded < 1800 THEN m "
    "ELSE CAST(year_founded AS DOUBLE) END AS a FROM company CROSS JOIN my)"))
def _(spark, sf_dir):
    return ft.repaired_age(company(spark, sf_dir), Y).select("company_id", "company_age")


@query("it_investment_intensity_median", "F12", on_company(
    "SELECT company_id, round(CASE WHEN revenue > 0 THEN (coalesce(it_budget,mb)+coalesce(it_spend,ms))/revenue END, 6) "
    "AS it_investment_intensity FROM company CROSS JOIN (SELECT quantile_cont(it_budget,0.5) AS mb, "
    "quantile_cont(it_spend,0.5) AS ms FROM company) m"))
def _(spark, sf_dir):
    return rounded(ft.it_intensity(company(spark, sf_dir)).select("company_id", "it_investment_intensity"))


GROWTH = (
    "parts AS (SELECT company_id, CASE WHEN employees > 0 THEN revenue/employees ELSE 0 END AS a, "
    "CASE WHEN revenue > 0 THEN market_value/revenue ELSE 0 END AS b, "
    "CASE WHEN revenue > 0 THEN (coalesce(it_budget,mb)+coalesce(it_spend,ms))/revenue END AS c FROM company CROSS JOIN "
    "(SELECT quantile_cont(it_budget,0.5) AS mb, quantile_cont(it_spend,0.5) AS ms FROM company) m)"
)


@query("growth_potential_index", "F17", on_company(
    "SELECT company_id, round(0.4*(a-la)/(ha-la+1e-10)+0.3*(b-lb)/(hb-lb+1e-10)+0.3*(c-lc)/(hc-lc+1e-10), 6) "
    "AS growth_potential_index FROM parts CROSS JOIN (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, "
    "min(c) AS lc, max(c) AS hc FROM parts) x", GROWTH))
def _(spark, sf_dir):
    df = ft.growth_potential(ft.it_intensity(company(spark, sf_dir)))
    return rounded(df.select("company_id", "growth_potential_index"))


QUINT = ("q AS (SELECT quantile_cont(revenue,0.2) AS a, quantile_cont(revenue,0.4) AS b, quantile_cont(revenue,0.6) AS c, "
         "quantile_cont(revenue,0.8) AS d FROM company WHERE revenue > 0)")


@query("revenue_scale_quintiles", "F19", on_company(
    "SELECT company_id, " + SCALE.format(v="revenue", a="a", b="b", c="c", d="d")
    + " AS revenue_scale FROM company CROSS JOIN q", QUINT))
def _(spark, sf_dir):
    df = company(spark, sf_dir)
    return df.select("company_id", bands.revenue_scale(F.col("revenue"), ft.revenue_quintiles(df)).alias("revenue_scale"))


@query("calculate_indicators", "F21", on_company(
    "SELECT company_id, " + pos("market_value", "revenue") + " AS market_value_to_revenue_ratio, "
    + pos("single_site_employees", "employees") + " AS single_site_concentration, "
    + pos("coalesce(laptops,0)", "(coalesce(laptops,0)+coalesce(desktops,0))") + " AS mobile_ratio, "
    "round(p.c, 6) AS it_investment_intensity, "
    "round(0.4*(p.a-la)/(ha-la+1e-10)+0.3*(p.b-lb)/(hb-lb+1e-10)+0.3*(p.c-lc)/(hc-lc+1e-10), 6) AS growth_potential_index, "
    + SCALE.format(v="revenue", a="q.a", b="q.b", c="q.c", d="q.d") + " AS revenue_scale, "
    + SCALE.format(v="employees", a=10, b=50, c=250, d=1000) + " AS employee_scale "
    "FROM company JOIN parts p USING (company_id) CROSS JOIN q CROSS JOIN (SELECT min(a) AS la, max(a) AS ha, "
    "min(b) AS lb, max(b) AS hb, min(c) AS lc, max(c) AS hc FROM parts) x", GROWTH, QUINT))
def _(spark, sf_dir):
    cols = ["market_value_to_revenue_ratio", "single_site_concentration", "mobile_ratio", "it_investment_intensity",
            "growth_potential_index", "revenue_scale", "employee_scale"]
    return rounded(ft.calculate_indicators(company(spark, sf_dir)).select("company_id", *cols))


# --- engineered features ---------------------------------------------------------

ENG = (
    f"nz AS (SELECT company_id, industry, country, nullif(revenue,0) AS revenue, CAST(nullif(employees,0) AS DOUBLE) AS employees, "
    "nullif(it_spend,0) AS it_spend, nullif(market_value,0) AS market_value, CAST(nullif(servers,0) AS DOUBLE) AS servers, "
    f"CAST(nullif(storage,0) AS DOUBLE) AS storage, CAST(nullif(sites,0) AS DOUBLE) AS sites, "
    f"CASE WHEN {Y}-year_founded BETWEEN 0 AND 500 THEN CAST({Y}-year_founded AS DOUBLE) END AS company_age FROM company)",
    "eng AS (SELECT *, revenue/employees AS revenue_per_emp, it_spend/revenue AS it_spend_ratio, "
    "ln(1+coalesce(it_spend/employees,0)) AS tech_intensity_log, market_value/employees AS market_value_per_employee, "
    "revenue/sites AS revenue_per_site, it_spend/employees AS it_spend_per_employee, "
    "(coalesce(servers,0)+coalesce(storage,0))/employees AS technology_density, servers/storage AS server_storage_ratio, "
    "employees/sites AS employees_per_site, market_value/revenue AS market_to_revenue_ratio, "
    "market_value/employees AS capital_intensity FROM nz)",
)
ENG_COLS = list(ratios.ENGINEERED_RATIOS)
IMPUTED = (
    "med AS (SELECT " + ", ".join(f"quantile_cont({c},0.5) AS m_{c}" for c in ENG_COLS) + " FROM eng)",
    "imp AS (SELECT company_id, industry, country, revenue, employees, it_spend, market_value, servers, storage, sites, company_age, "
    + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in ENG_COLS) + " FROM eng CROSS JOIN med)",
)
# Engineered table with industry scores, reused by other query modules.
ENGINEERED_CTES = (
    *ENG, *IMPUTED,
    "ind AS (SELECT industry, " + ", ".join(
        f"avg({m}) AS a_{m}, stddev_samp({m}) AS s_{m}" for m in ft.ZSCORE_METRICS) + " FROM imp GROUP BY industry)",
    "feat AS (SELECT imp.*, " + ", ".join(
        f"CASE WHEN s_{m} > 0 THEN ({m}-a_{m})/s_{m} ELSE 0 END AS {m}_industry_zscore" for m in ft.ZSCORE_METRICS)
    + " FROM imp JOIN ind USING (industry))",
)


def engineered(spark, sf_dir):
    base = company(spark, sf_dir).withColumn("company_age", ratios.company_age(Y))
    return ft.engineer_features(base)


@query("engineered_ratios", "F22,P14", on_company(
    "SELECT company_id, " + ", ".join(
        f"round({c},6) AS {c}" if c.endswith("_log") else c for c in ENG_COLS) + " FROM eng", *ENG))
def _(spark, sf_dir):
    # Plain divisions are equal bit for bit in both engines; only the logarithm is rounded.
    return ft.engineered_ratios(company(spark, sf_dir)).select("company_id", *ENG_COLS).withColumn(
        "tech_intensity_log", r("tech_intensity_log"))


@query("region_codes", "F28", on_company(
    "SELECT company_id, country, CAST(coalesce(code, -1) AS INT) AS region_encoded FROM company LEFT JOIN "
    "(SELECT country, dense_rank() OVER (ORDER BY country) - 1 AS code FROM (SELECT DISTINCT country FROM company "
    "WHERE country IS NOT NULL) d) c USING (country)"))
def _(spark, sf_dir):
    return ft.category_codes(company(spark, sf_dir), "country", "region_encoded").select(
        "company_id", "country", "region_encoded")


@query("engineer_features", "F29,A7,W1", on_company(
    "SELECT company_id, round(revenue_per_emp,6) AS revenue_per_emp, round(it_spend_ratio,6) AS it_spend_ratio, "
    "round(server_storage_ratio,6) AS server_storage_ratio, round(ln(1+coalesce(it_spend,0)),6) AS it_spend_log, "
    "CASE WHEN sites > 1 THEN 1 ELSE 0 END AS is_multi_site, " + SIZE + " AS size_bracket, "
    "round(it_spend_ratio_industry_zscore,6) AS it_spend_ratio_industry_zscore, "
    "round(technology_density_industry_zscore,6) AS technology_density_industry_zscore FROM feat", *ENGINEERED_CTES))
def _(spark, sf_dir):
    return rounded(engineered(spark, sf_dir).select(
        "company_id", "revenue_per_emp", "it_spend_ratio", "server_storage_ratio", "it_spend_log", "is_multi_site",
        "size_bracket", "it_spend_ratio_industry_zscore", "technology_density_industry_zscore"))


@query("industry_zscore", "W1", on_company(
    "SELECT company_id, industry, round(CASE WHEN s > 0 THEN (it_spend-a)/s ELSE 0 END, 6) AS it_spend_industry_zscore "
    "FROM company JOIN (SELECT industry, avg(it_spend) AS a, stddev_samp(it_spend) AS s FROM company GROUP BY industry) g "
    "USING (industry)"))
def _(spark, sf_dir):
    return rounded(ps.group_zscore(company(spark, sf_dir), ["it_spend"], "industry").select(
        "company_id", "industry", "it_spend_industry_zscore"))


@query("subset_zscore", "W2", on_company(
    "SELECT company_id, " + ", ".join(f"round(({c}-a_{c})/(s_{c}+1e-10),6) AS {c}_subset_zscore" for c in ("revenue", "sites"))
    + " FROM company CROSS JOIN (SELECT " + ", ".join(
        f"avg({c}) AS a_{c}, stddev_samp({c}) AS s_{c}" for c in ("revenue", "sites")) + " FROM company) g"))
def _(spark, sf_dir):
    return rounded(ps.subset_zscore(company(spark, sf_dir), ["revenue", "sites"]).select(
        "company_id", "revenue_subset_zscore", "sites_subset_zscore"))


REFINED = {
    "tech_density_refined": "it_spend/servers", "operating_leverage": "revenue/employees", "it_spend_per_site": "it_spend/sites",
    "servers_per_site": "servers/sites", "storage_to_server_ratio": "storage/servers", "mv_per_it_spend": "market_value/it_spend",
    "revenue_per_year_age": "revenue/nullif(company_age,0)",
}


@query("refined_features", "F30", on_company(
    "SELECT company_id, " + ", ".join(f"{e} AS {n}" for n, e in REFINED.items()) + " FROM nz", ENG[0]))
def _(spark, sf_dir):
    base = ft.engineered_ratios(company(spark, sf_dir).withColumn("company_age", ratios.company_age(Y)))
    return ft.refined_features(base).select("company_id", *REFINED)


@query("auto_log10", "F31", on_company(
    "SELECT company_id, round(CASE WHEN wr THEN log10(revenue+1) ELSE revenue END,6) AS revenue, "
    "round(CASE WHEN ws THEN log10(sites+1) ELSE sites END,6) AS sites FROM company CROSS JOIN (SELECT "
    "max(revenue) FILTER (WHERE revenue>0)/(min(revenue) FILTER (WHERE revenue>0)+1e-10) > 100 AS wr, "
    "max(sites) FILTER (WHERE sites>0)/(min(sites) FILTER (WHERE sites>0)+1e-10) > 100 AS ws FROM company) x"))
def _(spark, sf_dir):
    return rounded(ps.auto_log10(company(spark, sf_dir), ["revenue", "sites"]).select("company_id", "revenue", "sites"))


# --- anomaly categories over the whole engineered table ---------------------------------

LIMITS = ("lim AS (SELECT quantile_cont(revenue_per_emp,0.99) AS p99, quantile_cont(company_age,0.1) AS p10 FROM feat)")
CATEGORY = (
    "CASE WHEN revenue_per_emp > p99 AND company_age < p10 AND p10 > 0 THEN 'True Unicorn' WHEN revenue_per_emp > p99 THEN 'High Performer' "
    "WHEN company_age > 30 AND revenue < 100000 THEN 'Zombie Firm' "
    "WHEN (CASE WHEN revenue > 0 THEN it_spend/revenue ELSE 0 END) > 0.10 OR it_spend > 1000000 THEN 'Tech-Heavy Outlier' "
    "WHEN revenue_per_emp > 500000 THEN 'Lean Operator' ELSE 'Strategic Outlier' END"
)


@query("classify_anomalies", "F33,A24", on_company(
    "SELECT company_id, c AS category, CASE c WHEN 'True Unicorn' THEN 'p99_efficiency|young' WHEN 'High Performer' THEN "
    "'p99_efficiency|not_young' WHEN 'Zombie Firm' THEN 'low_revenue_for_age' || CASE WHEN employees > 10 THEN "
    "'|inefficient_headcount' ELSE '' END WHEN 'Tech-Heavy Outlier' THEN 'high_it_ratio' || CASE WHEN it_spend > 1000000 THEN "
    "'|high_it_spend' ELSE '' END WHEN 'Lean Operator' THEN 'lean' ELSE concat_ws('|', CASE WHEN revenue > 0 THEN 'has_revenue' END, "
    "CASE WHEN employees > 0 THEN 'has_employees' END) END AS flags FROM (SELECT *, " + CATEGORY + " AS c FROM feat CROSS JOIN lim) z",
    *ENGINEERED_CTES, LIMITS))
def _(spark, sf_dir):
    df = engineered(spark, sf_dir)
    return classify_anomalies(df, df).select("company_id", "category", F.array_join("flags", "|").alias("flags"))


@query("anomaly_categories", "A29", on_company(
    "SELECT category, n, rank, company_id, original_cluster FROM (SELECT category, company_id, cluster AS original_cluster, "
    "count(*) OVER (PARTITION BY category) AS n, CAST(row_number() OVER (PARTITION BY category ORDER BY company_id) AS INT) AS rank "
    "FROM (SELECT company_id, CAST(CASE WHEN company_id % 10 < 6 THEN 0 WHEN company_id < 10 THEN 9 ELSE 1 + company_id % 3 END AS INT) "
    "AS cluster, " + CATEGORY + " AS category FROM feat CROSS JOIN lim) z WHERE cluster IN (9, 2)) y WHERE rank <= 5",
    *ENGINEERED_CTES, LIMITS))
def _(spark, sf_dir):
    k = F.col("company_id")
    df = engineered(spark, sf_dir).withColumn(
        "cluster", F.when(k % 10 < 6, 0).when(k < 10, 9).otherwise(1 + k % 3).cast("int"))
    return anomaly_categories(classify_anomalies(anomaly_rows(df, [9, 2]), df)).drop("flags")
