"""K-Means with several starts and several K, sharing every scan of the data.

The built-in estimator fits one K from one start.  A sweep of ten K with ten
starts would scan the table a hundred times per iteration round; here every
Lloyd iteration updates all models in one scan.  Each partition returns summed
vectors per centre, which are added up by a small aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.operators.validate import CentroidStats
from firmlens.session import spread_out  # noqa: F401  (callers prepare the data with it)

# Rounds in which candidates for starting centres are drawn from all rows, and how many a round draws for each centre.
DRAW_ROUNDS, DRAW_FACTOR = 4, 2
# Rows and centres whose distances are worked out at once; they stay in a core's cache.
ROWS, STACKED = 1_024, 64
# Partitions whose winners one task merges.
MERGED = 64


@dataclass(frozen=True)
class Fit:
    """Centres (largest cluster first) with the statistics of their members."""

    centres: np.ndarray
    n: np.ndarray
    inertia: float
    spread: np.ndarray
    group: int = 0
    rounds: int = 0

    @property
    def k(self) -> int:
        return len(self.centres)

    def quality(self) -> CentroidStats:
        """Davies-Bouldin and Calinski-Harabasz inputs; no further pass is needed."""
        used = self.n > 0
        return CentroidStats(list(range(used.sum())), self.n[used], self.centres[used], self.spread[used], self.inertia)


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a 2-d array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


# Partial sums of this few partitions are added on the driver, saving a shuffle per iteration.
FEW_PARTITIONS = 64


def few_partitions(data: DataFrame) -> bool:
    return data.rdd.getNumPartitions() <= FEW_PARTITIONS


def add_partials(parts: DataFrame, few: bool, key: str = "model") -> dict[int, np.ndarray]:
    """Sum the vectors emitted by the partitions, per model.

    A partition emits one row per model, never data rows.  With many
    partitions the rows are added up by a distributed aggregation.
    """
    if few:
        out: dict[int, np.ndarray] = {}
        for batch in parts.select(key, "stats").toArrow().to_batches():
            for number, stats in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = stats.values.to_numpy(zero_copy_only=False)
                out[number] = out[number] + block if number in out else block
        return out
    summed = parts.groupBy(key).agg(Summarizer.sum(array_to_vector(F.col("stats"))).alias("s"))
    return {row[key]: row["s"].toArray() for row in summed.collect()}


def square_gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gaps = (x**2).sum(axis=1)[:, None] - 2.0 * (x @ centres.T) + (centres**2).sum(axis=1)[None]
    return np.maximum(gaps, 0.0)


def _stacked(models: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, list[int], np.ndarray]]:
    """Models of one group and equal K side by side, a bounded number of centres each: (group, K, numbers, factors of [row, its square, 1])."""
    by_kind: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for number, group, centres in models:
        by_kind.setdefault((group, len(centres)), []).append((number, centres))
    out = []
    for (group, k), some in by_kind.items():
        most = max(1, STACKED // k)
        for lo in range(0, len(some), most):
            centres = np.concatenate([c for _, c in some[lo:lo + most]])
            out.append((group, k, [m for m, _ in some[lo:lo + most]],
                        np.column_stack([-2.0 * centres, np.ones(len(centres)), (centres**2).sum(axis=1)])))
    return out


def _members(rows: np.ndarray, stacks: list[tuple], spreads: bool) -> dict[int, np.ndarray]:
    """Per model a (k, d + 3) block of counts, squared and plain distances (left at zero without ``spreads``), and sums of its rows."""
    d = rows.shape[1]
    out = {number: np.zeros((k, d + 3)) for _, k, numbers, _ in stacks for number in numbers}
    for lo in range(0, len(rows), ROWS):
        x = rows[lo:lo + ROWS]
        n = len(x)
        upright = np.concatenate([x, (x**2).sum(axis=1)[:, None], np.ones((n, 1))], axis=1).T.copy()
        counted = np.concatenate([np.ones((n, 1)), x], axis=1)
        for _, k, numbers, factors in stacks:
            gaps = factors @ upright
            np.maximum(gaps, 0.0, out=gaps)
            gaps = gaps.reshape(-1, k, n)
            best = gaps.min(axis=1)
            own = (gaps == best[:, None]).astype(float)
            if own.sum() > len(numbers) * n:  # a row with several nearest centres belongs to the first of them
                own = np.zeros_like(gaps)
                np.put_along_axis(own, gaps.argmin(axis=1)[:, None], 1.0, axis=1)
            sums = (own.reshape(-1, n) @ counted).reshape(-1, k, d + 1)
            far = own @ np.stack([best, np.sqrt(best)], axis=2) if spreads else None
            for i, number in enumerate(numbers):
                block = out[number]
                block[:, 0] += sums[i, :, 0]
                block[:, 3:] += sums[i, :, 1:]
                if spreads:
                    block[:, 1:3] += far[i]
    return out


def _scan(data: DataFrame, models: list[tuple[int, int, np.ndarray]], few: bool, spreads: bool = True) -> dict[int, np.ndarray]:
    """One pass: per model a (k, d + 3) block of counts, squared and plain distances (if ``spreads``), and sums."""
    grouped = "grp" in data.columns
    stacks = _stacked(models)

    def partial(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("features"))
            groups = batch.column("grp").to_numpy() if grouped else None
            for group in dict.fromkeys(g for g, *_ in stacks) if grouped else (None,):
                rows = x[groups == group] if grouped else x
                if not len(rows):
                    continue
                for number, block in _members(rows, [s for s in stacks if not grouped or s[0] == group], spreads).items():
                    blocks[number] = blocks[number] + block if number in blocks else block
        if blocks:
            yield pa.RecordBatch.from_pydict({
                "model": pa.array(list(blocks), pa.int32()),
                "stats": pa.array([b.ravel() for b in blocks.values()], pa.list_(pa.float64())),
            })

    cols = ["features", "grp"] if grouped else ["features"]
    sums = add_partials(data.select(*cols).mapInArrow(partial, "model int, stats array<double>"), few)
    return {m: sums[m].reshape(len(c), -1) for m, _, c in models if m in sums}


def _draw(data: DataFrame, models: list[tuple[int, int, np.ndarray | None, int]], turn: int) -> dict[int, np.ndarray]:
    """One pass: per model (number, group, centres, wanted) that many rows, drawn in proportion to the squared distance.

    Every row runs a race that its distance speeds up; the first rows win, whatever the partitioning.  A partition
    sends its own winners only.
    """
    grouped = "grp" in data.columns

    def winners(race: np.ndarray, points: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.argsort(race, kind="stable")[:wanted]
        first = first[np.isfinite(race[first])]
        return race[first], points[first]

    def emit(best: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "model": pa.array([m for m, (race, _) in best.items() for _ in race], pa.int32()),
            "race": pa.array([v for race, _ in best.values() for v in race], pa.float64()),
            "point": pa.array([p for _, points in best.values() for p in points], pa.list_(pa.float64())),
        })

    def partial(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, h = matrix(batch.column("features")), batch.column("h").to_numpy().view(np.uint64)
            groups = batch.column("grp").to_numpy() if grouped else None
            for number, group, centres, wanted in models:
                mine = groups == group if grouped else slice(None)
                rows = x[mine]
                if not len(rows):
                    continue
                gaps = np.ones(len(rows)) if centres is None else square_gaps(rows, centres).min(axis=1)
                mixed = (h[mine] ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)) * np.uint64(0x94D049BB133111EB)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                uniform = ((mixed >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
                with np.errstate(divide="ignore"):
                    race = np.where(gaps > 0, -np.log(uniform) / gaps, np.inf)
                race, points = winners(race, rows, wanted)
                if number in best:
                    race, points = winners(np.concatenate([best[number][0], race]), np.concatenate([best[number][1], points]), wanted)
                best[number] = (race, points)
        if best:
            yield emit(best)

    wanted_of = {number: wanted for number, _, _, wanted in models}

    def merge(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows:
                number, race, points = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
                for m in np.unique(number):
                    own, rows = race[number == m], points[number == m]
                    if m in best:
                        own, rows = np.concatenate([best[m][0], own]), np.concatenate([best[m][1], rows])
                    best[m] = winners(own, rows, wanted_of[m])
        if best:
            yield emit(best)

    schema = "model int, race double, point array<double>"
    parts = data.select("features", "h", *(["grp"] if grouped else [])).mapInArrow(partial, schema)
    left = data.rdd.getNumPartitions()
    while left > MERGED:
        left = -(-left // MERGED)
        parts = parts.repartition(left).mapInArrow(merge, schema)
    found: dict[int, list] = {}
    for row in parts.collect():  # at most MERGED times the wanted rows
        found.setdefault(row["model"], []).append((row["race"], row["point"]))
    return {m: np.array([p for _, p in sorted(rows)[:wanted_of[m]]]) for m, rows in found.items()}


def draw_candidates(
    data: DataFrame, sizes: dict[int, int], n_init: int, seed: int, key: str
) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Per (group, start) weighted candidates for its centres, drawn from all rows in a few shared passes.

    Candidates are drawn in rounds, each round more of them where rows are still far from all (parallel oversampling
    for k-means++); a candidate's weight is the number of rows that are nearest to it.
    """
    hashed = data.withColumn("h", F.xxhash64(F.col(key), F.lit(seed)))
    names = [(g, i) for g in sizes for i in range(n_init)]
    held: dict[int, np.ndarray] = _draw(hashed, [(m, g, None, 1) for m, (g, _) in enumerate(names)], 0)
    for turn in range(1, DRAW_ROUNDS + 1):
        asked = [(m, g, held[m], DRAW_FACTOR * sizes[g]) for m, (g, _) in enumerate(names) if m in held]
        for m, points in _draw(hashed, asked, turn).items():
            held[m] = np.concatenate([held[m], points])
    blocks = _scan(data, [(m, names[m][0], points) for m, points in held.items()], few_partitions(data))
    return {names[m]: (points, blocks[m][:, 0]) for m, points in held.items()}


def settled(candidates: tuple[np.ndarray, np.ndarray], k: int, seed: int, rounds: int = 25) -> np.ndarray:
    """``k`` starting centres: k-means++ and Lloyd's iterations on the weighted candidates."""
    points, weights = candidates
    centres = plus_plus(points, k, seed, weights)
    for _ in range(rounds):
        nearest = square_gaps(points, centres).argmin(axis=1)
        share = np.eye(len(centres))[nearest] * weights[:, None]
        n = share.sum(axis=0)[:, None]
        moved = np.where(n > 0, (share.T @ points) / np.maximum(n, 1), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def mean_variance(data: DataFrame) -> dict[int, float]:
    """Mean variance of the features over all rows, per group."""
    vector = array_to_vector(F.col("features")).alias("v")
    group = F.col("grp").alias("g") if "grp" in data.columns else F.lit(0).alias("g")
    rows = data.select(group, vector).groupBy("g").agg(Summarizer.variance(F.col("v")).alias("s")).collect()
    return {row["g"]: float(row["s"].toArray().mean()) for row in rows}


def fit_many(
    data: DataFrame, starts: list[tuple[int, np.ndarray]], max_iter: int = 100, tol: float = 1e-4,
) -> list[Fit]:
    """Run Lloyd's iterations from all starts at once; ``data`` should be persisted.

    ``starts`` are (group, centres); with a ``grp`` column a start only sees the
    rows of its group.  A model stops when its centres move by less than ``tol``
    times the mean variance.
    """
    few = few_partitions(data)
    centres = [c for _, c in starts]
    limit = {g: max(tol * v, 1e-12) for g, v in mean_variance(data).items()}
    rounds = [0] * len(starts)
    active = list(range(len(starts)))
    for _ in range(max_iter):
        blocks = _scan(data, [(i, starts[i][0], centres[i]) for i in active], few, spreads=False)
        moving = []
        for i in active:
            block = blocks.get(i)
            if block is None:
                continue
            used = block[:, 0] > 0
            moved = centres[i].copy()
            moved[used] = block[used, 3:] / block[used, :1]
            shift = ((moved - centres[i]) ** 2).sum()
            centres[i] = moved
            rounds[i] += 1
            if shift > limit[starts[i][0]]:
                moving.append(i)
        active = moving
        if not active:
            break
    final = _scan(data, [(i, g, centres[i]) for i, (g, _) in enumerate(starts)], few)
    fits = []
    for i, (g, start) in enumerate(starts):
        block = final.get(i, np.zeros((len(start), start.shape[1] + 3)))
        order = np.lexsort([*centres[i].T[::-1], -block[:, 0]])
        block = block[order]
        n = block[:, 0]
        fits.append(Fit(centres[i][order], n, float(block[:, 1].sum()), block[:, 2] / np.maximum(n, 1), g, rounds[i]))
    return fits


def plus_plus(rows: np.ndarray, k: int, seed: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Starting centres, each drawn with probability proportional to its weight times the squared distance so far."""
    rng = np.random.default_rng(seed)
    weights = np.ones(len(rows)) if weights is None or not weights.sum() else weights
    picked = [rows[rng.choice(len(rows), p=weights / weights.sum())]]
    gaps = ((rows - picked[0]) ** 2).sum(axis=1)
    while len(picked) < k:
        total = (gaps * weights).sum()
        i = rng.choice(len(rows), p=gaps * weights / total) if total > 0 else rng.integers(len(rows))
        picked.append(rows[i])
        gaps = np.minimum(gaps, ((rows - rows[i]) ** 2).sum(axis=1))
    return np.array(picked)


def kmeans_by_k(
    data: DataFrame, ks: list[int], n_init: int = 10, seed: int = 42, key: str = "company_id", max_iter: int = 100
) -> dict[int, Fit]:
    """Best of ``n_init`` starts for every K, all fitted together."""
    drawn = draw_candidates(data, {0: max(ks)}, n_init, seed, key)
    starts = [(k, settled(drawn[0, i], k, seed + i)) for k in ks for i in range(n_init)]
    fits = fit_many(data, [(0, c) for _, c in starts], max_iter)
    best: dict[int, Fit] = {}
    for (k, _), fit in zip(starts, fits):
        if k not in best or fit.inertia < best[k].inertia:
            best[k] = fit
    return best


def kmeans(data: DataFrame, k: int, n_init: int = 10, seed: int = 42, key: str = "company_id") -> Fit:
    return kmeans_by_k(data, [k], n_init, seed, key)[k]


def kmeans_in_groups(
    data: DataFrame, k_of_group: dict[int, int], n_init: int = 10, seed: int = 42, key: str = "company_id"
) -> dict[int, Fit]:
    """Separate K-Means inside every group of the ``grp`` column, all in the same scans."""
    drawn = draw_candidates(data, k_of_group, n_init, seed, key)
    starts = [(g, settled(drawn[g, i], k, seed + i)) for g, k in k_of_group.items() for i in range(n_init)]
    best: dict[int, Fit] = {}
    for fit in fit_many(data, starts):
        if fit.group not in best or fit.inertia < best[fit.group].inertia:
            best[fit.group] = fit
    return best


def nearest(centres: list[np.ndarray], features: Column) -> Column:
    """Array with the index of the nearest centre, one entry per centre set."""

    @F.pandas_udf("array<int>")
    def assign(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy())
        found = np.stack([square_gaps(rows, c).argmin(axis=1) for c in centres], axis=1)
        return pd.Series(list(found.astype("int32")))

    return assign(features)


def predict(df: DataFrame, fit: Fit, out: str = "cluster", features: str = "features") -> DataFrame:
    """Adds the cluster of every row; all other columns are kept."""
    return df.withColumn(out, F.get(nearest([fit.centres], F.col(features)), F.lit(0)))


def predict_all(df: DataFrame, fits: dict[int, Fit], prefix: str = "k") -> DataFrame:
    """Adds one label column per fit (``k2``, ``k3``, ...) with a single pass through Python."""
    ks = list(fits)
    staged = df.withColumn("__all", nearest([fits[k].centres for k in ks], F.col("features")))
    return staged.withColumns({f"{prefix}{k}": F.get("__all", F.lit(i)) for i, k in enumerate(ks)}).drop("__all")


def predict_in_groups(df: DataFrame, fits: dict[int, Fit], out: str = "sub") -> DataFrame:
    """Adds the sub-cluster within each row's group; 0 for groups that were left whole."""
    held = {g: f.centres for g, f in fits.items()}

    @F.pandas_udf("int")
    def assign(x: pd.Series, grp: pd.Series) -> pd.Series:
        rows, g = np.stack(x.to_numpy()), grp.to_numpy()
        label = np.zeros(len(rows), dtype="int32")
        for group, centres in held.items():
            mine = g == group
            if mine.any():
                label[mine] = square_gaps(rows[mine], centres).argmin(axis=1)
        return pd.Series(label)

    return df.withColumn(out, assign("features", "grp"))


def stability_centres(
    data: DataFrame, fit: Fit, refits: int = 5, seed: int = 42, n_init: int = 10, key: str = "company_id"
) -> tuple[float, bool]:
    """Mean shift of the centres over refits from other starts; stable up to 0.1."""
    from firmlens.operators.validate import centre_shift

    drawn = draw_candidates(data, {0: fit.k}, refits * n_init, seed + 1000, key)
    starts = [(0, settled(drawn[0, i], fit.k, seed + 1000 + i)) for i in range(refits * n_init)]
    fits = fit_many(data, starts)
    best = [min(fits[r * n_init:(r + 1) * n_init], key=lambda f: f.inertia) for r in range(refits)]
    shift = float(np.mean([centre_shift(b.centres, fit.centres) for b in best]))
    return shift, shift <= 0.1


