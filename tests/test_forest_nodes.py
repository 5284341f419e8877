"""The forest keeps each row's node, and its importances are those of a forest that walks its trees."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from firmlens.operators import models as md


def test_forest_keeps_nodes(spark, monkeypatch):
    df = spark.range(400).select(
        (F.col("id") % 17).cast("double").alias("a"), F.sin("id").alias("b"), (F.col("id") % 3).cast("int").alias("cluster"))
    made = []

    def forest(**options):
        made.append(RandomForestClassifier(**options))
        return made[-1]

    monkeypatch.setattr(md, "RandomForestClassifier", forest)
    found = {r[0]: r[1] for r in md.forest_importance(df, ["a", "b"], trees=5, depth=4).collect()}
    assert made[0].getCacheNodeIds()
    rows = df.select(md.to_vector_of(["a", "b"]).alias("__v"), F.col("cluster").cast("double").alias("__y"))
    plain = RandomForestClassifier(featuresCol="__v", labelCol="__y", numTrees=5, maxDepth=4, seed=42).fit(rows)
    assert list(found.values()) == pytest.approx(plain.featureImportances.toArray().tolist())
