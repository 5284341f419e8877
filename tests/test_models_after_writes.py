"""Models must predict in sessions that have counted rows while writing."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from firmlens.operators import models as md


def observed(spark):
    seen = Observation()
    spark.range(10).observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 10}


def test_two_segments_predicted_after_an_observed_write(spark):
    observed(spark)
    df = spark.range(200).select(
        F.col("id").alias("company_id"), (F.col("id") % 2).cast("int").alias("cluster"),
        ((F.col("id") % 2) * 10 + F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    model = md.fit_logistic(df, ["x", "y"])
    assert md.accuracy(model.predict(df)) == 1.0


def test_line_predicted_after_an_observed_write(spark):
    observed(spark)
    df = spark.range(200).select((F.col("id") * 2.0 + 1).alias("revenue"), F.col("id").cast("double").alias("x"))
    found = md.fit_linear(df, ["x"], "revenue", "none").predict(df)
    assert found.where("abs(predicted - revenue) > 1e-6").isEmpty()
