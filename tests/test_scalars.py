"""Edge cases of scalar operators, resolvers and driver-side statistics."""

import math

import pytest
from pyspark.sql import functions as F

from firmlens.functions import bands, clean, ratios, resolve
from firmlens.functions.special import chi2_sf, f_sf

HEADERS = ["Company Name", "Country", "REVENUE (usd)", "Market Value (USD)", "IT spend", "Employees Single Site",
           "Employees Total", "Company Sites", "No. of Servers", "Year Found"]


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_parse_range(spark):
    texts = ["1 to 10", "11-50", "51~200", "<10", ">1000", "250", "-5", "n/a", None, "1,000", "a to b", "5d", "12.5"]
    want = [5.5, 30.5, 125.5, 5.0, 1500.0, 250.0, -5.0, None, None, None, None, None, 12.5]
    assert values(spark, texts, clean.parse_range) == want


def test_resolvers_disagree_on_purpose():
    assert resolve.resolve_column(HEADERS, resolve.NUMERIC_PATTERNS["employees"]) == "Employees Single Site"
    assert resolve.resolve_by_keywords(HEADERS, *resolve.KEYWORDS["employees"]) == "Employees Total"
    assert resolve.resolve_column(HEADERS, ["no such"]) is None
    assert resolve.resolve_by_keywords(["Sales revenue"], *resolve.KEYWORDS["revenue"]) == "Sales revenue"
    assert resolve.resolve_geo_and_id(HEADERS) == (["Country"], "Company Name")


def test_roles_need_a_number():
    with pytest.raises(ValueError):
        resolve.resolve_roles(["country", "city"])


def test_strict_age(spark):
    got = values(spark, [2026, 1526, 1525, 2030, None], lambda v: ratios.company_age(2026, "v"), "int")
    assert got == [0.0, 500.0, None, None, None]


@pytest.mark.parametrize("fn, rows, want", [
    (bands.maturity_stage, [4.9, 5.0, 10.0, 20.0, -1.0, None], ["Startup", "Growth", "Mature", "Established", "Unknown", "Unknown"]),
    (bands.employee_scale, [0.0, 9.0, 10.0, 250.0, 1000.0, None], ["Unknown", "Micro", "Small", "Upper Mid-Market", "Enterprise", "Unknown"]),
    (bands.age_bracket, [0.0, 5.0, 5.1, 100.0, 101.0, -1.0, None], ["Startup", "Startup", "Growth", "Established", "Legacy", None, None]),
    (bands.size_bracket, [0.0, 10.0, 11.0, 10000.0, 10001.0], ["Micro", "Micro", "Small", "Enterprise", "Mega-Corp"]),
])
def test_bands(spark, fn, rows, want):
    assert values(spark, rows, fn, "double") == want


def test_density_and_dispersion(spark):
    df = spark.createDataFrame([(0, 0, 5, None, "x"), (None, 4, 2, "a", "b")], "servers int, storage int, employees int, country string, region string")
    got = df.select(ratios.technology_density_index(), ratios.geographic_dispersion(["country", "region"])).collect()
    assert [tuple(r) for r in got] == [(None, 1), (2.0, 2)]


def test_anomaly_precedence(spark):
    df = spark.createDataFrame(
        [(31.0, 99_999.0, 10.0, 1.0, 5.0), (30.0, 99_999.0, 10.0, 1.0, 5.0), (1.0, 1e6, 2e6, 1.0, 5.0), (50.0, 1e6, 2e6, 1.0, 5.0),
         (5.0, 1e6, 6e5, 2e5, 5.0), (5.0, 1e6, 6e5, 1.0, 5.0), (None, None, 1.0, None, None)],
        "company_age double, revenue double, revenue_per_emp double, it_spend double, employees double")
    category = bands.anomaly_category(1e6, 3.0)
    assert [r[0] for r in df.select(category).collect()] == [
        "Zombie Firm", "Strategic Outlier", "True Unicorn", "High Performer", "Tech-Heavy Outlier", "Lean Operator", "Strategic Outlier"]


def test_tail_probabilities():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert chi2_sf(10.0, 2) == pytest.approx(math.exp(-5), rel=1e-12)
    assert chi2_sf(200.0, 6) == pytest.approx(math.exp(-100) * sum(100**j / math.factorial(j) for j in range(3)), rel=1e-10)
    assert chi2_sf(0.0, 3) == 1.0
    assert f_sf(2.0, 2, 20) == pytest.approx((1 + 2 * 2.0 / 20) ** -10, rel=1e-12)
    assert f_sf(0.5, 2, 400) == pytest.approx((1 + 2 * 0.5 / 400) ** -200, rel=1e-10)
    assert f_sf(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-4)


def test_nan_and_infinity_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-1.5,), (None,)], "x double")
    assert [r[0] for r in clean.scrub_non_finite(df, ["x"]).collect()] == [None, None, -1.5, None]
    assert [r[0] for r in clean.scrub_non_finite(df, ["x"], to=0.0).collect()] == [0.0, 0.0, -1.5, 0.0]
