"""Scaling, encoding and reduction of feature vectors.

Features travel as one ``array<double>`` column.  Fitted values (means,
medians, a d x d matrix) are small; applying them needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.operators.profile_stats import dbl, iqr_fences, outlier_report, varying_columns
from firmlens.operators.quantiles import quantiles
from firmlens.session import bounded_collect, local_rows


@dataclass(frozen=True)
class Scaler:
    """Centre and divisor per column."""

    cols: list[str]
    centre: list[float]
    scale: list[float]
    kind: str

    def column(self, c: str) -> Column:
        i = self.cols.index(c)
        return (dbl(c) - F.lit(self.centre[i])) / F.lit(self.scale[i])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.cols})

    def vector(self, df: DataFrame, out: str = "features") -> DataFrame:
        return df.withColumn(out, F.array(*[self.column(c) for c in self.cols]))


def standard_scaler(df: DataFrame, cols: list[str]) -> Scaler:
    """Mean and population deviation (1 where there is no spread)."""
    row = df.agg(
        *[F.avg(dbl(c)).alias(f"{c}|m") for c in cols],
        *[F.when(F.min(dbl(c)) < F.max(dbl(c)), F.stddev_pop(dbl(c))).alias(f"{c}|s") for c in cols],
    ).first()
    return Scaler(list(cols), [row[f"{c}|m"] or 0.0 for c in cols], [row[f"{c}|s"] or 1.0 for c in cols], "standard")


def robust_scaler(df: DataFrame, cols: list[str]) -> Scaler:
    """Exact median and inter-quartile range (divisor 1 where the range is 0)."""
    q = quantiles(df, cols, [0.25, 0.5, 0.75])[None]
    return Scaler(list(cols), [q[c][1] or 0.0 for c in cols], [(q[c][2] or 0.0) - (q[c][0] or 0.0) or 1.0 for c in cols], "robust")


def auto_scaler(df: DataFrame, cols: list[str], share: float = 0.05) -> Scaler:
    """Robust if any column has more than 5 % rows outside its fences, else standard."""
    fences = iqr_fences(df, cols)
    worst = outlier_report(df, fences).agg(F.max("pct_out")).first()[0] if fences else None
    return robust_scaler(df, cols) if (worst or 0) > share * 100 else standard_scaler(df, cols)


def choose_metric(n_numeric: int, n_categorical: int) -> str:
    """Distance family by the kinds of columns."""
    total = n_numeric + n_categorical
    if total and n_categorical / total > 0.5:
        return "gower"
    return "euclidean" if total and n_numeric / total > 0.8 else "mixed"


# --- moments -------------------------------------------------------------------------

@dataclass(frozen=True)
class Moments:
    cols: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray  # sample covariance
    corr: np.ndarray


def complete_vectors(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as one vector ``v``; rows with a null or NaN in any of them are left out."""
    return df.select(*[dbl(c).alias(c) for c in cols]).dropna().select(array_to_vector(F.array(*cols)).alias("v"))


def moments(df: DataFrame, cols: list[str]) -> Moments:
    """Count, means, covariance and correlation of complete rows, from JVM-side passes."""
    vec = complete_vectors(df, cols)
    row = vec.agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")
    ).select("s.count", "s.mean", "s.variance").first()
    std = np.sqrt(row["variance"].toArray())
    corr = np.nan_to_num(Correlation.corr(vec, "v").first()[0].toArray(), nan=0.0)
    np.fill_diagonal(corr, 1.0)
    return Moments(list(cols), row["count"], row["mean"].toArray(), corr * np.outer(std, std), corr)


# --- collinearity ----------------------------------------------------------------------

def prune_correlated(df: DataFrame, cols: list[str], limit: float = 0.9) -> list[str]:
    """Columns left after dropping, for each pair above the limit, the one with less variance."""
    m = moments(df, cols)
    gone = set()
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            if abs(m.corr[i, j]) > limit:
                gone.add(cols[i] if m.cov[i, i] < m.cov[j, j] else cols[j])
    return [c for c in cols if c not in gone]


def vif(corr: np.ndarray) -> np.ndarray:
    """Variance inflation 1 / (1 - R2) of each column against the others, from correlations."""
    out = np.empty(len(corr))
    for j in range(len(corr)):
        others = [i for i in range(len(corr)) if i != j]
        if not others:
            out[j] = 1.0
            continue
        r = corr[others, j]
        r2 = float(r @ np.linalg.pinv(corr[np.ix_(others, others)], rcond=1e-12) @ r)
        out[j] = np.inf if r2 >= 1 - 1e-12 else 1.0 / (1.0 - r2)
    return out


def vif_report(df: DataFrame, cols: list[str], limit: float = 10.0) -> DataFrame:
    """Inflation factor per column with a flag above the limit."""
    usable = varying_columns(df, cols)
    factors = vif(moments(df, usable).corr)
    return local_rows(df.sparkSession, [(c, float(v), int(v > limit)) for c, v in zip(usable, factors)],
                      "feature string, vif double, high int")


def vif_prune(df: DataFrame, cols: list[str], limit: float = 10.0, max_rounds: int = 10) -> list[str]:
    """Drop the worst column per round; the table is read once, for the correlations."""
    kept = varying_columns(df, cols)
    full = moments(df, kept).corr
    index = list(range(len(kept)))
    for _ in range(max_rounds):
        if len(index) < 2:
            break
        factors = vif(full[np.ix_(index, index)])
        if factors.max() <= limit:
            break
        index.pop(int(factors.argmax()))
    return [kept[i] for i in index]


# --- reduction -------------------------------------------------------------------------

@dataclass(frozen=True)
class Projection:
    """x -> (x - centre) . components, as an array column."""

    cols: list[str]
    centre: np.ndarray
    components: np.ndarray  # d x k
    explained: np.ndarray  # variance ratio per component

    def transform(self, df: DataFrame, out: str = "pc") -> DataFrame:
        """Adds ``<out>1 ... <out>k``; weighted sums of columns, so no shuffle and no Python."""
        centred = [dbl(c) - F.lit(float(m)) for c, m in zip(self.cols, self.centre)]
        return df.withColumns(
            {
                f"{out}{k + 1}": sum((x * float(w) for x, w in zip(centred, self.components[:, k])), start=F.lit(0.0))
                for k in range(self.components.shape[1])
            }
        )

    def keep(self, threshold: float = 0.85) -> Projection:
        """The first components that reach the threshold; all of them if none does."""
        reached = np.nonzero(np.cumsum(self.explained) >= threshold)[0]
        k = int(reached[0]) + 1 if len(reached) else len(self.explained)
        return Projection(self.cols, self.centre, self.components[:, :k], self.explained[:k])

    def loadings(self, spark) -> DataFrame:
        rows = [(f"pc{k + 1}", c, float(self.components[i, k]))
                for k in range(self.components.shape[1]) for i, c in enumerate(self.cols)]
        return local_rows(spark, rows, "component string, feature string, loading double")

    def spectrum(self, spark) -> DataFrame:
        rows = [(k + 1, float(v)) for k, v in enumerate(self.explained)]
        return local_rows(spark, rows, "component int, explained double")


def _fix_signs(components: np.ndarray) -> np.ndarray:
    """Make the largest loading of every component positive."""
    top = np.abs(components).argmax(axis=0)
    return components * np.where(components[top, range(components.shape[1])] < 0, -1.0, 1.0)


def pca(df: DataFrame, cols: list[str], k: int | None = None) -> Projection:
    """Principal components of complete rows; unlike the built-in model the projection is centred."""
    k = min(k or len(cols), len(cols))
    vec = complete_vectors(df, cols)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(vec)
    mean = vec.agg(Summarizer.mean(F.col("v")).alias("m")).first()[0].toArray()
    return Projection(list(cols), mean, _fix_signs(model.pc.toArray()), model.explainedVariance.toArray())


def truncated_svd(df: DataFrame, cols: list[str], k: int) -> Projection:
    """Uncentred singular vectors, from the d x d second-moment matrix.

    The explained ratio is the variance of each projected column over the
    total variance of the inputs.
    """
    m = moments(df, cols)
    gram = m.cov * (m.n - 1) + m.n * np.outer(m.mean, m.mean)
    values, vectors = np.linalg.eigh(gram)
    top = _fix_signs(vectors[:, np.argsort(values)[::-1][:k]])
    spread = np.einsum("ik,ij,jk->k", top, m.cov, top)
    return Projection(list(cols), np.zeros(len(cols)), top, spread / np.trace(m.cov))


def famd(df: DataFrame, numeric: list[str], categorical: list[str], k: int = 20, max_categories: int = 1000):
    """Mixed-data components: (frame with the encoded columns, projection up to 85 %).

    Numbers are standardised; a category with share p becomes the centred
    indicator divided by sqrt(p).  Then principal components of all of them.
    """
    n = df.count()
    encoded = {f"num_{c}": standard_scaler(df, [c]).column(c) for c in varying_columns(df, numeric)}
    for c in categorical:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        shares = sorted(bounded_collect(counts, max_categories, f"categories of {c}"))
        if len(shares) < 2:
            continue
        for i, (value, count) in enumerate(shares):
            p = count / n
            indicator = F.coalesce((F.col(c) == F.lit(value)).cast("double"), F.lit(0.0))
            encoded[f"cat_{c}_{i}"] = (indicator - p) / float(np.sqrt(p))
    if len(encoded) < 2:
        raise ValueError("not enough varying columns")
    frame = df.withColumns(encoded)
    k = max(1, min(k, len(numeric) + len(categorical) - 1))
    return frame, pca(frame, list(encoded), k).keep(0.85)


def to_vector(c: str = "features") -> Column:
    return array_to_vector(F.col(c))


def to_array(c: str) -> Column:
    return vector_to_array(F.col(c))
