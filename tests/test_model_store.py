"""Stored segmentations, counted processing and the full run."""

import subprocess
import sys

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from firmlens.operators import kmeans as km
from firmlens.plans import model_store as store
from firmlens.plans import pipelines as pl

LATER = """
import sys
from pyspark.sql import SparkSession
from firmlens.plans import model_store as store
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
model = store.load_model(spark, sys.argv[1])
model.assign(spark.read.parquet(sys.argv[2])).select("company_id", "cluster").write.parquet(sys.argv[3])
"""


@pytest.fixture(scope="module")
def fitted(companies):
    prepared = pl.preprocess(companies, 2026)
    data = km.spread_out(prepared.frame.select("company_id", "features")).persist()
    return prepared, km.kmeans(data, 4, n_init=2)


def labels(df):
    return sorted(map(tuple, df.select("company_id", "cluster").collect()))


def test_a_later_process_labels_alike(spark, companies, fitted, tmp_path):
    path, rows, out = (str(tmp_path / n) for n in ("models", "rows", "out"))
    assert store.versions(spark, path) == []
    assert store.save_model(spark, path, *fitted, 2026) == 1
    companies.write.parquet(rows)
    subprocess.run([sys.executable, "-c", LATER, path, rows, out], check=True, cwd=ROOT, timeout=240)
    assert labels(spark.read.parquet(out)) == labels(pl.assign_segment(companies, *fitted, 2026))


def test_versions_stay_apart(spark, companies, fitted, tmp_path):
    path = str(tmp_path / "models")
    prepared, fit = fitted
    numbers = pl.preprocess(companies, 2026, use_text=False)
    plain = km.kmeans(km.spread_out(numbers.frame.select("company_id", "features")).persist(), 3, n_init=1)
    assert [store.save_model(spark, path, prepared, fit, 2026), store.save_model(spark, path, numbers, plain, 2020)] == [1, 2]
    assert store.versions(spark, path) == [1, 2]
    first, last = store.load_model(spark, path, 1), store.load_model(spark, path)
    assert (last.version, last.as_of_year, last.fit.k, last.prepared.tfidf) == (2, 2020, 3, None)
    assert (first.fit.centres == fit.centres).all() and (first.fit.n == fit.n).all() and first.fit.inertia == fit.inertia
    for name in ("numeric", "roles", "fences", "medians", "scaler", "tfidf", "ages"):
        assert getattr(first.prepared, name) == getattr(prepared, name)
    with pytest.raises(ValueError, match="no version 9"):
        store.load_model(spark, path, 9)


def test_a_broken_version_is_refused(spark, fitted, tmp_path):
    path = str(tmp_path / "models")
    store.save_model(spark, path, *fitted, 2026)
    store.parameters(spark, path, 1).where("part <> 'members'").write.parquet(f"{path}/version=2")
    with pytest.raises(ValueError, match="parameters"):
        store.load_model(spark, path)
    assert store.load_model(spark, path, 1).version == 1
    with pytest.raises(ValueError, match="no version None"):
        store.load_model(spark, str(tmp_path / "none"))


def test_the_write_counts(spark, tmp_path):
    rows = [(1, "a", 10, 5.0, 7.0), (1, "a", 10, 5.0, 7.0), (2, "b", 0, 5.0, 7.0), (3, "c", 4, None, 1.0)]
    df = spark.createDataFrame(rows, "company_id int, `Company Name` string, `Employees Total` int, `Market Value (USD)` double, `Revenue (USD)` double")
    done = pl.process(df, 2026, keep=("company_id",), path=str(tmp_path / "p"))
    assert done.counts == {"rows_read": 4, "copies": 1, "not_valid": 2, "kept": 1}
    assert done.table.count() == 1 and "__copies" not in done.table.columns
    assert pl.process(df, 2026, keep=("company_id",)).counts is None
    nothing = pl.process(df.where("company_id < 0"), 2026, keep=("company_id",), path=str(tmp_path / "q"))
    assert nothing.counts == {"rows_read": 0, "copies": 0, "not_valid": 0, "kept": 0}


def test_full_run_by_density(companies):
    found = pl.run_full(companies, 2026, method="dbscan", eps=2.0, min_samples=5)
    sections = {r[0] for r in found.report.select("section").distinct().collect()}
    assert {"density", "choice", "sizes", "statistics", "collinearity", "linear"} <= sections
    sizes = {r["cluster"]: r["count"] for r in found.labelled.groupBy("cluster").count().collect()}
    numbered = [sizes[c] for c in sorted(c for c in sizes if c >= 0)]
    assert numbered == sorted(numbered, reverse=True) and sum(sizes.values()) == companies.count()
    choice = {r["metric"]: r["value"] for r in found.report.where("section = 'choice'").collect()}
    assert choice["k"] == len(numbered) and choice["noise"] == sizes.get(-1, 0)
    with pytest.raises(ValueError, match="unknown method"):
        pl.run_full(companies, 2026, method="other")


def test_full_run_reports_membership(companies):
    report = pl.run_full(companies, 2026, n_clusters=3, n_init=1).report.persist()
    sections = {r[0] for r in report.select("section").distinct().collect()}
    assert {"logistic", "cross_validation", "confusion", "classes", "drivers", "chi_square", "statistics", "shares", "modes", "collinearity"} <= sections
    assert report.where("section = 'cross_validation'").count() == 5
    tested = report.where("section = 'confusion'").agg(F.sum("value")).first()[0]
    assert report.where("section = 'classes' AND subject = 'accuracy' AND metric = 'support'").first()["value"] == tested
