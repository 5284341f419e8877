"""Multinomial logistic models of all cross-validation folds, fitted in shared scans.

Separate fits scan the table once per fold and iteration.  Here one pass over
the rows is one Newton step of every fold: a partition returns, per fold, the
summed loss, gradient and curvature of the rows that fold trains on, never rows.
The loss is convex, so a step that does not lower it is halved until it does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.operators.kmeans import add_partials, few_partitions, matrix
from firmlens.operators.profile_stats import dbl
from firmlens.session import cut_lineage, spread_out

# Weights (classes x features) up to which a fold's curvature matrix is formed; larger models are fitted one by one.
MAX_WEIGHTS = 1_000
MAX_STEPS = 100
# A fold is done when half the squared Newton decrement, the loss still to gain, is below this.
GAIN_LEFT = 1e-12


@dataclass(frozen=True)
class FoldModel:
    """Weights (classes x (features + 1), the intercept last) on features centred and divided as given."""

    fold: int
    classes: np.ndarray  # codes of the classes among the training rows
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    steps: int

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.centre) / self.scale, np.ones(len(x))])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[(self.inputs(x) @ self.weights.T).argmax(axis=1)]


def _blocks(batches):
    for batch in batches:
        if batch.num_rows:
            yield matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("fold").to_numpy()


def _derivatives(inputs: np.ndarray, code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature summed over the rows, as one flat vector."""
    k, d = weights.shape
    scores = inputs @ weights.T
    scores -= scores.max(axis=1, keepdims=True)
    total = np.log(np.exp(scores).sum(axis=1))
    share = np.exp(scores - total[:, None])
    hit = np.eye(k)[code]
    curvature = np.zeros((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            weight = share[:, a] * ((a == b) - share[:, b])
            part = (inputs * weight[:, None]).T @ inputs
            curvature[a, :, b], curvature[b, :, a] = part, part
    loss = (total - (scores * hit).sum(axis=1)).sum()
    return np.concatenate([[loss], ((share - hit).T @ inputs).ravel(), curvature.ravel()])


def _scan(rows: DataFrame, models: list[FoldModel], few: bool) -> dict[int, np.ndarray]:
    """One pass: the derivatives of every model over the rows outside its fold."""

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for x, y, fold in _blocks(batches):
            for m in models:
                mine = fold != m.fold
                if mine.any():
                    found = _derivatives(m.inputs(x[mine]), np.searchsorted(m.classes, y[mine]), m.weights)
                    sums[m.fold] = sums[m.fold] + found if m.fold in sums else found
        if sums:
            yield pa.RecordBatch.from_pydict({
                "model": pa.array(list(sums), pa.int32()), "stats": pa.array(list(sums.values()), pa.list_(pa.float64()))})

    return add_partials(rows.mapInArrow(partial, "model int, stats array<double>"), few)


def hits(rows: DataFrame, models: list[FoldModel]) -> dict[int, tuple[int, int]]:
    """Per fold (rows held out, rows whose class was predicted), from one pass."""

    def partial(batches):
        sums = {m.fold: np.zeros(2) for m in models}
        for x, y, fold in _blocks(batches):
            for m in models:
                mine = fold == m.fold
                if mine.any():
                    sums[m.fold] += mine.sum(), (m.predict(x[mine]) == y[mine]).sum()
        yield pa.RecordBatch.from_pydict({
            "model": pa.array(list(sums), pa.int32()), "stats": pa.array(list(sums.values()), pa.list_(pa.float64()))})

    found = add_partials(rows.mapInArrow(partial, "model int, stats array<double>"), few_partitions(rows))
    return {f: (int(n), int(hit)) for f, (n, hit) in found.items()}


def _moments(rows: DataFrame, width: int, folds: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(mean, population deviation) of the rows outside each fold; 1 where there is no spread.

    Every fold's own moments come from one aggregate and are put together without subtracting large sums.
    """
    x = [F.get("x", F.lit(j)) for j in range(width)]
    per = rows.groupBy("fold").agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*[F.var_pop(c) for c in x]).alias("var"),
        F.array(*[F.min(c) for c in x]).alias("low"), F.array(*[F.max(c) for c in x]).alias("high")).collect()
    out = {}
    for f in folds:
        train = [r for r in per if r["fold"] != f]
        n = np.array([r["n"] for r in train], float)[:, None]
        means, spreads = np.array([r["mean"] for r in train]), np.array([r["var"] for r in train])
        mean = (n * means).sum(axis=0) / n.sum()
        var = (n * (spreads + (means - mean) ** 2)).sum(axis=0) / n.sum()
        varies = np.min([r["low"] for r in train], axis=0) < np.max([r["high"] for r in train], axis=0)
        out[f] = (mean, np.where(varies & (var > 0), np.sqrt(var), 1.0))
    return out


def fold_rows(df: DataFrame, features: list[str], label: str, fold: str, labels: list) -> DataFrame:
    """x (features), y (code of the label) and fold of every row, written once for all scans."""
    code = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)).cast("int") - 1
    rows = df.select(F.array(*[dbl(c) for c in features]).alias("x"), code.alias("y"), F.col(fold).cast("int").alias("fold"))
    return spread_out(cut_lineage(rows))


def fit_folds(rows: DataFrame, width: int, c: float = 1.0) -> list[FoldModel]:
    """One model per fold of ``rows`` (x, y, fold), trained on all other folds, with an L2 penalty on the weights.

    The model is that of ``fit_logistic``: features are scaled on the training rows, intercepts are not penalised.  A
    fold that holds all rows has nothing to train on and gives no model.
    """
    cells = [tuple(r) for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()]
    sizes = {f: sum(n for g, _, n in cells if g != f) for f in sorted({f for f, _, _ in cells})}
    folds = [f for f, n in sizes.items() if n]
    scaling = _moments(rows, width, folds)
    few = few_partitions(rows)
    models: dict[int, FoldModel] = {}
    for f in folds:
        classes = np.array(sorted({y for g, y, _ in cells if g != f}))
        models[f] = FoldModel(f, classes, np.zeros((len(classes), width + 1)), *scaling[f], 0)
    if any(m.weights.size > MAX_WEIGHTS for m in models.values()):
        raise ValueError(f"more than {MAX_WEIGHTS} weights")

    def total(m: FoldModel, sums: np.ndarray):
        """Penalised mean loss with its gradient and curvature."""
        k, d = m.weights.shape
        free = np.ones((k, d))
        free[:, -1] = 0.0
        n, l2 = sizes[m.fold], free / (c * sizes[m.fold])
        loss = sums[0] / n + 0.5 * (l2 * m.weights**2).sum()
        gradient = sums[1:1 + k * d] / n + (l2 * m.weights).ravel()
        return loss, gradient, sums[1 + k * d:].reshape(k * d, k * d) / n + np.diag(l2.ravel())

    at = {f: total(m, s) for f, s in _scan(rows, list(models.values()), few).items() for m in [models[f]]}
    # The same constant on all intercepts changes nothing: the least-squares step leaves that direction alone.
    pending = {f: -np.linalg.lstsq(h, g, rcond=1e-12)[0] for f, (_, g, h) in at.items()}
    pending = {f: step for f, step in pending.items() if -at[f][1] @ step / 2 > GAIN_LEFT}
    for _ in range(MAX_STEPS):
        if not pending:
            break
        tried = [FoldModel(f, m.classes, m.weights + step.reshape(m.weights.shape), m.centre, m.scale, m.steps + 1)
                 for f, step in pending.items() for m in [models[f]]]
        sums = _scan(rows, tried, few)
        left = {}
        for m in tried:
            found, step = total(m, sums[m.fold]), pending[m.fold]
            if found[0] <= at[m.fold][0] + 1e-4 * (at[m.fold][1] @ step):
                models[m.fold], at[m.fold] = m, found
                step = -np.linalg.lstsq(found[2], found[1], rcond=1e-12)[0]
                if -found[1] @ step / 2 > GAIN_LEFT:
                    left[m.fold] = step
            elif np.abs(step).max() > 1e-9:
                left[m.fold] = step / 2
        pending = left
    return [models[f] for f in folds]
