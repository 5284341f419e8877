"""Predictive models that explain the segments and the financial targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.clean import require_target
from firmlens.operators.folds import MAX_WEIGHTS, fit_folds, fold_rows, hits
from firmlens.operators.profile_stats import dbl, varying_columns
from firmlens.operators.quantiles import quantiles
from firmlens.operators.vectors import Scaler, standard_scaler, to_vector
from firmlens.session import lit_map, local_rows, scratch_path

# fixed values: columns derived from a target, by name fragment
LEAKS = {
    "revenue": ["it_budget", "it_spend", "it budget", "it spend", "it_investment_intensity",
                "market_value_to_revenue_ratio"],
    "market_value": ["market_value_to_revenue_ratio", "ps_ratio"],
}


# --- splitting ----------------------------------------------------------------------------------

def _uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the key only, so splits repeat under any partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)


def split(
    df: DataFrame, test: float = 0.2, stratify: str | None = None, key: str = "company_id", seed: int = 42
) -> DataFrame:
    """Adds ``is_test``: the rows with the largest hashes, per class if every class has two rows."""
    staged = df.withColumn("__u", _uniform(key, seed))
    if stratify:
        counts = [r["n"] for r in df.groupBy(stratify).agg(F.count("*").alias("n")).collect()]
        if len(counts) < 2 or min(counts) < 2:
            stratify = None
    cuts = quantiles(staged, ["__u"], [1.0 - test], stratify)
    if stratify:
        kind = df.schema[stratify].dataType.simpleString()
        cut = lit_map({g: per["__u"][0] for g, per in cuts.items()}, kind, "double")[F.col(stratify)]
    else:
        cut = F.lit(cuts[None]["__u"][0])
    return staged.withColumn("is_test", F.col("__u") > cut).drop("__u")


def parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(~F.col("is_test")), df.where(F.col("is_test"))


# --- classification ---------------------------------------------------------------------------------

def without_summary(spark, model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The model alone, written and read back.

    The training summary of two classes holds the session, and a session that has observed a write
    cannot be sent to tasks, so predictions of the fitted object would fail from then on.
    """
    path = scratch_path(spark, "model")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


@dataclass(frozen=True)
class Logistic:
    model: LogisticRegressionModel
    scaler: Scaler
    labels: list

    def predict(self, df: DataFrame) -> DataFrame:
        vec = self.scaler.vector(df, "__x").withColumn("__v", to_vector("__x"))
        index = F.col("prediction").cast("int")
        names = F.array(*[F.lit(v) for v in self.labels])
        return self.model.transform(vec).withColumn("predicted", F.get(names, index)).drop(
            "__x", "__v", "rawPrediction", "probability", "prediction")

    def coefficients(self, spark) -> DataFrame:
        weights = self.model.coefficientMatrix.toArray()
        rows = [(label, c, float(weights[i, j])) for i, label in enumerate(self.labels) for j, c in enumerate(self.scaler.cols)]
        return local_rows(spark, rows, "cluster int, feature string, coefficient double")


def fit_logistic(train: DataFrame, features: list[str], label: str = "cluster", c: float = 1.0) -> Logistic:
    """Multinomial model with an L2 penalty; scaling is fitted on the training rows only."""
    counts = {r[0]: r[1] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    scaler = standard_scaler(train, features)
    code = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)).cast("double") - 1
    vec = scaler.vector(train, "__x").select(to_vector("__x").alias("__v"), code.alias("__y"))
    vec = vec.persist()
    fitted = LogisticRegression(
        featuresCol="__v", labelCol="__y", family="multinomial", regParam=1.0 / (c * sum(counts.values())),
        elasticNetParam=0.0, standardization=False, maxIter=1000,
    ).fit(vec)
    vec.unpersist()
    return Logistic(without_summary(train.sparkSession, fitted), scaler, labels)


def accuracy(predicted: DataFrame, label: str = "cluster", prediction: str = "predicted") -> float:
    return predicted.agg(F.avg((F.col(label) == F.col(prediction)).cast("double"))).first()[0]


def kfold_accuracy(
    df: DataFrame, features: list[str], label: str = "cluster", folds: int = 5, key: str = "company_id", seed: int = 42
) -> DataFrame:
    """Accuracy of each fold that holds rows, fitted on the other folds; every scan of the table serves all folds."""
    folded = df.withColumn("__fold", F.floor(_uniform(key, seed + 1) * folds).cast("int"))
    labels = sorted(r[0] for r in df.select(label).distinct().collect())
    if len(labels) * (len(features) + 1) > MAX_WEIGHTS:
        return _separate_folds(folded, features, label)
    rows = fold_rows(folded, features, label, "__fold", labels).persist()
    found = hits(rows, fit_folds(rows, len(features)))
    rows.unpersist()
    return local_rows(df.sparkSession, [(f, hit / n) for f, (n, hit) in sorted(found.items())], "fold int, accuracy double")


def _separate_folds(folded: DataFrame, features: list[str], label: str) -> DataFrame:
    """The same for models whose curvature is too large to add up: one fit after the other."""
    rows, folded = [], folded.persist()
    for f in sorted(r[0] for r in folded.select("__fold").distinct().collect()):
        model = fit_logistic(folded.where(F.col("__fold") != f), features, label)
        rows.append((f, accuracy(model.predict(folded.where(F.col("__fold") == f)), label)))
    folded.unpersist()
    return local_rows(folded.sparkSession, rows, "fold int, accuracy double")


def confusion(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    return predicted.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_report(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro, weighted and accuracy rows."""
    cells = confusion(predicted, label, prediction)
    # One row per class and side, then folded by class: the k x k cells are all that is left of the table.
    sides = cells.select(
        F.explode(F.array(
            F.struct(F.col("label").alias("c"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
                     F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed")),
            F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("support"),
                     F.col("n").alias("guessed")),
        )).alias("s")).select("s.*")
    totals = sides.groupBy("c").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed"))
    p = F.coalesce(F.col("hit") / F.nullif(F.col("guessed"), F.lit(0)), F.lit(0.0))
    rec = F.coalesce(F.col("hit") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    classes = totals.withColumns({"precision": p, "recall": rec}).withColumn("f1", f1)
    measures = ("precision", "recall", "f1")
    named = classes.select(F.col("c").cast("string").alias("class"), *measures, "support")
    macro = classes.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support")).select(
        F.lit("macro avg").alias("class"), *measures, "support")
    weighted = classes.agg(*[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures],
                           F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *measures, "support")
    share = F.sum("hit") / F.sum("support")
    overall = classes.agg(share.alias("precision"), share.alias("recall"), share.alias("f1"), F.sum("support").alias("support")).select(
        F.lit("accuracy").alias("class"), *measures, "support")
    return named.unionByName(macro).unionByName(weighted).unionByName(overall)


def forest_importance(
    df: DataFrame, features: list[str], label: str = "cluster", trees: int = 100, depth: int = 20, seed: int = 42
) -> DataFrame:
    """Importance of each feature in a forest that predicts the cluster."""
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    code = {v: i for i, v in enumerate(sorted(counts))}
    kind = df.schema[label].dataType.simpleString()
    rows = df.select(to_vector_of(features).alias("__v"), lit_map(code, kind, "double")[F.col(label)].alias("__y"))
    vec = rows.persist()
    # Each row's node in every tree is kept: otherwise the trees go to the tasks, which walk them for every row in each pass.
    model = RandomForestClassifier(
        featuresCol="__v", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True).fit(vec)
    vec.unpersist()
    weights = model.featureImportances.toArray()
    return local_rows(df.sparkSession, [(c, float(w)) for c, w in zip(features, weights)], "feature string, importance double")


def to_vector_of(cols: list[str]) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.array(*[dbl(c) for c in cols]))


# --- regression -----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Linear:
    model: LinearRegressionModel
    scaler: Scaler
    target: str

    def predict(self, df: DataFrame) -> DataFrame:
        vec = self.scaler.vector(df, "__x").withColumn("__v", to_vector("__x"))
        return self.model.transform(vec).withColumnRenamed("prediction", "predicted").drop("__x", "__v")

    def coefficients(self, spark) -> DataFrame:
        rows = [(c, float(w)) for c, w in zip(self.scaler.cols, self.model.coefficients)]
        return local_rows(spark, rows, "feature string, coefficient double")


def penalty(kind: str, alpha: float, n: int, sigma: float, l1: float = 0.5) -> tuple[float, float]:
    """(regParam, elasticNetParam) giving the usual penalty on unscaled targets.

    The built-in solver works on the target divided by its population
    deviation ``sigma``, which rescales L1 and L2 parts differently.
    """
    if kind == "ridge":
        return alpha * sigma / n, 0.0
    if kind == "lasso":
        return alpha, 1.0
    if kind == "elasticnet":
        total = alpha * l1 + alpha * (1 - l1) * sigma
        return total, alpha * l1 / total
    if kind == "none":
        return 0.0, 0.0
    raise ValueError(f"unknown regularisation {kind}")


def fit_linear(train: DataFrame, features: list[str], target: str, kind: str = "ridge", alpha: float = 1.0) -> Linear:
    row = train.agg(F.count("*").alias("n"), F.stddev_pop(dbl(target)).alias("s")).first()
    reg, mix = penalty(kind, alpha, row["n"], row["s"] or 1.0)
    scaler = standard_scaler(train, features)
    vec = scaler.vector(train, "__x").select(to_vector("__x").alias("__v"), dbl(target).alias("__y"))
    vec = vec.persist()
    model = LinearRegression(
        featuresCol="__v", labelCol="__y", regParam=reg, elasticNetParam=mix, standardization=False, maxIter=2000, tol=1e-9,
    ).fit(vec)
    vec.unpersist()
    return Linear(model, scaler, target)


def regression_metrics(predicted: DataFrame, target: str, prediction: str = "predicted") -> DataFrame:
    """Mean squared error and R2, one pass."""
    y, p = dbl(target), dbl(prediction)
    return predicted.agg(
        F.count("*").alias("n"), F.avg((y - p) ** 2).alias("mse"),
        (1 - F.sum((y - p) ** 2) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"))


def exclude_leaky(df: DataFrame, features: list[str], target: str, limit: float = 0.95) -> list[str]:
    """Features that are neither derived from the target by name nor almost equal to it."""
    fragments = next((f for name, f in LEAKS.items() if name in target.lower()), [])
    named = [c for c in features if not any(f in c.lower() for f in fragments)]
    usable = [c for c in varying_columns(df, named) if c != target]
    row = df.agg(*[F.corr(dbl(c), dbl(target)).alias(c) for c in usable]).first() if usable else {}
    gone = {c for c in usable if row[c] is not None and abs(row[c]) > limit} | {target}
    return [c for c in named if c not in gone]


def default_target(columns: list[str]) -> str:
    found = next((c for c in ("revenue", "market_value") if c in columns), None)
    if found is None:
        raise ValueError("no revenue or market value column")
    return found


def linear_analysis(
    df: DataFrame, features: list[str], target: str | None = None, kind: str = "ridge", alpha: float = 1.0,
    key: str = "company_id",
) -> tuple[Linear, DataFrame]:
    """Leak-free fit on a split; returns the model and metrics for both parts."""
    target = target or default_target(df.columns)
    kept = exclude_leaky(df, features, target)
    train, test = parts(split(require_target(df, target), key=key))
    model = fit_linear(train, kept, target, kind, alpha)
    metrics = regression_metrics(model.predict(train), target).withColumn("part", F.lit("train")).unionByName(
        regression_metrics(model.predict(test), target).withColumn("part", F.lit("test")))
    return model, metrics
