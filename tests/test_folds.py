"""Cross-validation in shared scans against separate fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.operators import folds as fo
from firmlens.operators import models as md

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 900)
    x = rng.normal(size=(900, 3)) * [1, 50, 0.01] + np.outer(y, [1.0, 20.0, 0.0]) + [0, 1e4, 0]
    return spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(900)], "company_id int, a double, b double, c double, cluster int")


def test_accuracies_equal_separate_fits(rows):
    shared = {r[0]: r[1] for r in md.kfold_accuracy(rows, FEATURES).collect()}
    folded = rows.withColumn("__fold", F.floor(md._uniform("company_id", 43) * 5).cast("int"))
    separate = {r[0]: r[1] for r in md._separate_folds(folded, FEATURES, "cluster").collect()}
    assert shared == separate and sorted(shared) == [0, 1, 2, 3, 4]


def test_weights_equal_the_single_fit(rows):
    staged = fo.fold_rows(rows.withColumn("f", F.col("company_id") % 2), FEATURES, "cluster", "f", [0, 1, 2])
    model = fo.fit_folds(staged, 3)[0]
    single = md.fit_logistic(rows.where("company_id % 2 = 1"), FEATURES)
    want = single.model.coefficientMatrix.toArray()
    # Weights are unique up to a constant per feature over the classes, which the penalty sets to zero mean.
    assert np.allclose(model.weights[:, :-1], want, atol=1e-4)
    gaps = model.weights[:, -1] - model.weights[:, -1].mean(), single.model.interceptVector.toArray()
    assert np.allclose(gaps[0], gaps[1] - gaps[1].mean(), atol=1e-4)
    assert model.steps < 15


def test_the_gradient_vanishes(rows):
    staged = fo.fold_rows(rows.withColumn("f", F.col("company_id") % 3), FEATURES, "cluster", "f", [0, 1, 2])
    for m in fo.fit_folds(staged, 3):
        train = rows.where(F.col("company_id") % 3 != m.fold).toPandas()
        inputs = m.inputs(train[FEATURES].to_numpy())
        scores = np.exp(inputs @ m.weights.T)
        error = scores / scores.sum(axis=1, keepdims=True) - np.eye(3)[train["cluster"]]
        pull = m.weights.copy()
        pull[:, -1] = 0
        assert np.abs((error.T @ inputs + pull) / len(train)).max() < 1e-5


def test_a_class_outside_training_and_constant_columns(spark):
    data = [(i, 1.0, float(i % 7), 0.0, 9 if i < 3 else i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "company_id int, a double, b double, c double, cluster int")
    staged = fo.fold_rows(df.withColumn("f", (F.col("company_id") >= 3).cast("int") + F.col("company_id") % 2 * (F.col("company_id") >= 3).cast("int")), FEATURES, "cluster", "f", [0, 1, 9])
    models = {m.fold: m for m in fo.fit_folds(staged, 3)}
    assert list(models[0].classes) == [0, 1]  # class 9 lies in fold 0 alone
    assert fo.hits(staged, list(models.values()))[0] == (3, 0)
    assert all(np.isfinite(m.weights).all() for m in models.values())


def test_separable_classes_and_few_rows(spark):
    df = spark.createDataFrame([(i, float(i), 0.0, 0.0, int(i >= 20)) for i in range(40)], "company_id int, a double, b double, c double, cluster int")
    found = {r[0]: r[1] for r in md.kfold_accuracy(df, FEATURES).collect()}
    folded = df.withColumn("__fold", F.floor(md._uniform("company_id", 43) * 5).cast("int"))
    assert found == {r[0]: r[1] for r in md._separate_folds(folded, FEATURES, "cluster").collect()}
    one = df.limit(1)
    assert md.kfold_accuracy(one, FEATURES).count() == 0
    assert md.kfold_accuracy(df.limit(0), FEATURES).count() == 0
