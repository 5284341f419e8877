"""Cluster quality: silhouette, Davies-Bouldin, Calinski-Harabasz, adjusted Rand, stability."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.operators.separable import cluster_sums
from firmlens.session import bounded_collect, cut_lineage, local_rows

MAX_CLUSTERS = 10_000
# The exact silhouette holds tiles of rows against a stream of half of the others: rows below which a table is one tile, tiles
# of larger ones, and the bytes of a tile with its sums above which there are more.
TILE_ROWS, TILES, TILE_BYTES = 2_048, 16, 128 << 20
# Held and streamed rows whose distances are worked out at once; they stay in a core's cache.
BLOCK = (192, 384)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


@dataclass(frozen=True)
class CentroidStats:
    labels: list
    n: np.ndarray
    centres: np.ndarray
    spread: np.ndarray  # mean distance to the own centre
    within: float  # sum of squared distances to the own centre

    def davies_bouldin(self) -> float:
        gap = np.linalg.norm(self.centres[:, None] - self.centres[None], axis=2)
        np.fill_diagonal(gap, np.inf)
        with np.errstate(divide="ignore"):
            return float(((self.spread[:, None] + self.spread[None]) / gap).max(axis=1).mean())

    def calinski_harabasz(self) -> float:
        n, k = self.n.sum(), len(self.n)
        overall = (self.n[:, None] * self.centres).sum(axis=0) / n
        between = float((self.n * ((self.centres - overall) ** 2).sum(axis=1)).sum())
        return float(between / (k - 1) / (self.within / (n - k))) if self.within > 0 else 1.0


def centroid_stats(df: DataFrame, label: str = "cluster", features: str = "features") -> CentroidStats:
    """Two passes: centres per cluster, then distances to the own centre (both JVM-side)."""
    labelled = df.where(F.col(label).isNotNull())
    centres = bounded_collect(
        labelled.groupBy(label).agg(
            F.count("*").alias("n"), Summarizer.mean(array_to_vector(F.col(features))).alias("centre")
        ),
        MAX_CLUSTERS, "clusters",
    )
    centres = sorted(centres, key=lambda row: row[label])
    kind = df.schema[label].dataType.simpleString()
    frame = local_rows(df.sparkSession, [(row[label], row["centre"].toArray().tolist()) for row in centres],
                       f"{label} {kind}, __centre array<double>")
    d2 = squared_distance(F.col(features), F.col("__centre"))
    gaps = {
        row[label]: row
        for row in labelled.select(label, features).join(F.broadcast(frame), label).groupBy(label)
        .agg(F.avg(F.sqrt(d2)).alias("spread"), F.sum(d2).alias("within")).collect()
    }
    return CentroidStats(
        [row[label] for row in centres],
        np.array([row["n"] for row in centres], dtype=float),
        np.array([row["centre"].toArray() for row in centres]),
        np.array([gaps[row[label]]["spread"] for row in centres]),
        float(sum(gaps[row[label]]["within"] for row in centres)),
    )


def davies_bouldin(df: DataFrame, label: str = "cluster", features: str = "features") -> float:
    return centroid_stats(df, label, features).davies_bouldin()


def calinski_harabasz(df: DataFrame, label: str = "cluster", features: str = "features") -> float:
    return centroid_stats(df, label, features).calinski_harabasz()


# --- silhouette ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Silhouette:
    score: float
    rows: int  # rows whose own silhouette was measured
    exact: bool
    stderr: float


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two blocks."""
    return _block_distances(_with_squares(x), _against(y), np.empty((len(x), len(y))))


def _with_squares(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, (x**2).sum(axis=1), np.ones(len(x))])


def _against(y: np.ndarray) -> np.ndarray:
    return np.column_stack([-2.0 * y, np.ones(len(y)), (y**2).sum(axis=1)]).T


def _block_distances(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The same of blocks made ready, into memory that is used again: |x|^2 - 2xy + |y|^2 is one product."""
    np.matmul(x, y, out=out)
    np.maximum(out, 0.0, out=out)
    return np.sqrt(out, out=out)


def _gower(weights: np.ndarray, n_numeric: int):
    """Distance of mixed rows: scaled differences of numbers, mismatches of coded categories."""

    def distance(x, y):
        total = np.zeros((len(x), len(y)))
        for j in range(x.shape[1]):
            gap = np.abs(x[:, j][:, None] - y[:, j][None])
            total += gap * weights[j] if j < n_numeric else gap > 0
        return total / x.shape[1]

    return distance


def _by_label(codes: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows in which those with the same labels are neighbours, where each run of them starts, and its clusters (runs x clusters)."""
    starts = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(int)
    order = np.lexsort(codes.T)
    codes = codes[order]
    runs = np.concatenate([[0], np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1])
    member = np.zeros((len(runs), sum(widths)))
    for start, own in zip(starts, codes[runs].T):
        member[np.arange(len(runs)), start + own] = 1.0
    return order, runs, member


def _cuts(runs: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, int]:
    """Starts, from ``lo``, of the runs that reach into rows lo to hi, and the number of the first of them."""
    first = int(np.searchsorted(runs, lo, side="right")) - 1
    last = int(np.searchsorted(runs, hi, side="left"))
    return np.maximum(runs[first:last] - lo, 0), first


def _meet(distance, x: np.ndarray, codes: np.ndarray, y: np.ndarray, widths: list[int], y_codes: np.ndarray | None = None, same: np.ndarray | None = None):
    """Summed distance from each row of ``y`` to every cluster of ``x`` of every labelling, side by side; with ``y_codes``
    also from each row of ``x`` to every cluster of ``y``.  A distance is worked out once for both.  ``same`` tells which row of
    ``x`` a row of ``y`` is itself (-1: none); its distance to itself is zero, free of roundings.

    Distances to rows with the same labels are added up first, so a pair costs the same however many labellings there are.
    """
    order, runs, member = _by_label(codes, widths)
    euclidean = distance is _distances
    held = _with_squares(x[order]) if euclidean else x[order]
    there, back = np.empty((len(y), sum(widths))), None
    y_order = np.arange(len(y))
    if y_codes is not None:
        y_order, y_runs, y_member = _by_label(y_codes, widths)
        back = np.zeros((len(x), sum(widths)))
    y = y[y_order]
    if same is not None:
        place = np.empty(len(x) + 1, int)
        place[order], place[-1] = np.arange(len(x)), -1
        same = place[same][y_order]
    space = np.empty(BLOCK)
    for at in range(0, len(y), BLOCK[1]):
        part = y[at:at + BLOCK[1]]
        n = len(part)
        part = _against(part) if euclidean else part
        if back is not None:
            y_cuts, y_first = _cuts(y_runs, at, at + n)
        sums = np.zeros((len(runs), n))
        for lo in range(0, len(held), BLOCK[0]):
            rows = held[lo:lo + BLOCK[0]]
            # A short block fills the front of the space, so it is contiguous as well.
            gaps = _block_distances(rows, part, space.reshape(-1)[:len(rows) * n].reshape(len(rows), n)) if euclidean else distance(rows, part)
            if same is not None:
                own = np.flatnonzero((same[at:at + n] >= lo) & (same[at:at + n] < lo + len(rows)))
                gaps[same[at + own] - lo, own] = 0.0
            cuts, first = _cuts(runs, lo, lo + len(rows))
            for i, (start, end) in enumerate(zip(cuts, [*cuts[1:], len(rows)])):
                sums[first + i] += gaps[start:end].sum(axis=0)
            if back is not None:
                added = gaps.sum(axis=1)[:, None] if len(y_cuts) == 1 else np.add.reduceat(gaps, y_cuts, axis=1)
                back[lo:lo + len(rows)] += added @ y_member[y_first:y_first + len(y_cuts)]
        there[y_order[at:at + n]] = sums.T @ member
    if back is not None:
        placed = np.empty_like(back)
        placed[order] = back
        back = placed
    return there, back


def silhouettes(
    df: DataFrame,
    labels: list[str],
    features: str = "features",
    key: str = "company_id",
    anchors: int | None = None,
    distance=_distances,
    gower_weights: np.ndarray | None = None,
) -> list[Silhouette]:
    """Mean Euclidean silhouette of each label column; distances are shared by all of them.

    ``gower_weights`` (scales of the leading numbers; coded categories follow) asks for mixed distances:
    their sums come from running totals per column, exact and linear in the rows.
    Euclidean sums are exact at any size as well: every two tiles of rows meet once, one held against the stream of the other,
    and only summed distances per row leave a task.  The work is quadratic by definition.  Rows without a label in any column are left out.
    ``anchors=m`` asks for another operator, an unbiased estimate: ``m`` rows,
    picked by hash, are measured against all rows in one linear pass, and the
    standard error is returned too.
    """
    df = df.dropna(subset=labels)
    sizes = []
    coded = []
    counted = df.groupBy(*labels).agg(F.count("*").alias("__n"))
    # Labels may come from a costly prediction; one pass over the rows counts all of them.
    counted = cut_lineage(counted) if len(labels) > 1 else counted
    for c in labels:
        counts = {row[0]: row[1] for row in bounded_collect(
            counted.groupBy(c).agg(F.sum("__n").alias("n")), MAX_CLUSTERS, "clusters")}
        names = sorted(counts)
        sizes.append(np.array([counts[v] for v in names], dtype=float))
        coded.append(F.array_position(F.array(*[F.lit(v) for v in names]), F.col(c)).cast("int") - 1)
    total = int(sizes[0].sum())
    widths = [len(s) for s in sizes]
    base = df.select(F.col(key).alias("id"), F.col(features).alias("x"), F.array(*coded).alias("codes"))
    if gower_weights is not None and anchors is None:
        sums = cluster_sums(base, gower_weights, sizes)
    elif anchors is None:
        sums = _tiled_sums(base, total, widths, distance)
    else:
        sums = _anchor_sums(base, anchors, widths, distance)
    scored = _scored(sums, sizes).select(F.posexplode("s").alias("which", "s"))
    found = {row["which"]: row for row in scored.groupBy("which").agg(
        F.avg("s").alias("score"), F.count("s").alias("n"), F.stddev_samp("s").alias("sd")).collect()}
    exact = anchors is None
    return [
        Silhouette(
            found[i]["score"], found[i]["n"], exact,
            0.0 if exact else (found[i]["sd"] or 0.0) / math.sqrt(found[i]["n"]),
        )
        for i in range(len(labels))
    ]


def silhouette(df: DataFrame, label: str = "cluster", **options) -> Silhouette:
    """Mean Euclidean silhouette of one label column (see ``silhouettes``)."""
    return silhouettes(df, [label], **options)[0]


def _scored(sums: DataFrame, sizes) -> DataFrame:
    """(s): the silhouettes of each row under every labelling, from its (codes, sums)."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sizes])[:-1]]).astype(int)

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s, own = _matrix(batch.column("sums")), _matrix(batch.column("codes"))
            out = np.zeros(own.shape)
            rows = np.arange(len(s))
            for i, (start, size) in enumerate(zip(starts, sizes)):
                block = s[:, start:start + len(size)]
                c = own[:, i]
                a = block[rows, c] / np.maximum(size[c] - 1, 1)
                mean = block / size
                mean[rows, c] = np.inf
                b = mean.min(axis=1)
                worst = np.maximum(a, b)
                ok = (size[c] > 1) & np.isfinite(b) & (worst > 0)
                out[:, i] = np.where(ok, (b - a) / np.where(ok, worst, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([_list_column(out)], ["s"])

    return sums.select("codes", "sums").mapInArrow(score, "s array<double>")


def _tiling(total: int, values: int, cores: int) -> tuple[int, int]:
    """(tiles, segments): a row is held once per segment and streamed to half of the tiles; a held row takes ``values`` numbers.

    The number of tiles is odd, so that each tile meets as many others as any other tile does.
    """
    tiles = max(1, min(math.ceil(total / TILE_ROWS), TILES), math.ceil(total * 8 * values / TILE_BYTES))
    tiles += 1 - tiles % 2
    return tiles, max(1, min(math.ceil(4 * cores / tiles), tiles))


def _tiled_sums(base: DataFrame, total: int, widths, distance) -> DataFrame:
    """Every tile meets itself and the half of the tiles behind it, in a circle, so any two tiles meet once.

    A task holds a tile and streams a segment of the rows of those tiles; it returns sums of the streamed rows and of the held
    ones.  The copies of a row are bounded until tiles reach ``TILE_BYTES``.
    """
    cores = base.sparkSession.sparkContext.defaultParallelism
    width = len((base.select("x").first() or [[]])[0])
    tiles, segments = _tiling(total, width + sum(widths), cores)
    place = F.xxhash64("id")
    block, segment = F.pmod(place, F.lit(tiles)).cast("int"), F.pmod(F.shiftright(place, 32), F.lit(segments)).cast("int")
    # Kinds: 0 is held, 1 streams by its own tile and 2 by another one.
    cells = F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda s: F.struct((block * segments + s).alias("cell"), F.lit(0).alias("kind"))),
        F.transform(F.sequence(F.lit(0), F.lit(tiles // 2)), lambda t: F.struct(
            (F.pmod(block - t, F.lit(tiles)) * segments + segment).alias("cell"), F.when(t == 0, 1).otherwise(2).alias("kind"))))
    dealt = base.withColumn("at", F.explode(cells)).select("id", "x", "codes", "at.kind", "at.cell")
    # A partition is one cell; the held rows come first.
    dealt = dealt.repartitionById(tiles * segments, F.col("cell")).sortWithinPartitions("kind").drop("cell")
    kind = base.schema["id"].dataType.simpleString()

    def emit(rows: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("id"), rows.column("codes"), _list_column(sums)], ["id", "codes", "sums"])

    def tile(batches):
        held, x, codes, ids, sums = [], None, None, None, None
        for batch in batches:
            # A kind ends inside a batch at most once.
            ends = np.searchsorted(batch.column("kind").to_numpy(), [1, 2, 3])
            if ends[0]:
                held.append(batch.slice(0, ends[0]))
            for lo, hi, other in ((ends[0], ends[1], False), (ends[1], ends[2], True)):
                if lo == hi or not held:
                    continue
                if x is None:
                    x, codes = (np.concatenate([_matrix(h.column(c)) for h in held]) for c in ("x", "codes"))
                    ids = pd.Index(pa.concat_arrays([h.column("id") for h in held]).to_pandas())
                rows = batch.slice(lo, hi - lo)
                same = None if other or not ids.is_unique else ids.get_indexer(rows.column("id").to_pandas())
                found, back = _meet(distance, x, codes, _matrix(rows.column("x")), widths, _matrix(rows.column("codes")) if other else None, same)
                yield emit(rows, found)
                if other:
                    sums = back if sums is None else sums + back
        if sums is not None:
            lo = 0
            for h in held:
                yield emit(h, sums[lo:lo + h.num_rows])
                lo += h.num_rows

    return _add_up(dealt.mapInArrow(tile, f"id {kind}, codes array<int>, sums array<double>"))


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a 2-d array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _anchor_sums(base: DataFrame, anchors: int, widths, distance) -> DataFrame:
    picked = base.orderBy(F.xxhash64("id"), "id").limit(anchors).collect()
    points = np.array([row["x"] for row in picked])
    spark = base.sparkSession
    held = spark.sparkContext.broadcast(points)  # bounded by the anchor count

    def partial(batches):
        out = None
        for pdf in batches:
            if len(pdf):
                part, _ = _meet(distance, np.stack(pdf["x"]), np.stack(pdf["codes"]), held.value, widths)
                out = part if out is None else out + part
        if out is not None:
            yield pd.DataFrame({"a": np.arange(len(out)), "sums": list(out)})

    parts = base.select("x", "codes").mapInPandas(partial, "a int, sums array<double>")
    own = local_rows(spark, [(i, list(row["codes"])) for i, row in enumerate(picked)], "a int, codes array<int>")
    return _add_up(parts.join(F.broadcast(own), "a").withColumnRenamed("a", "id"))


def _add_up(parts: DataFrame) -> DataFrame:
    """(codes, sums) of each id.  Every task sends an id once, so adding up before the shuffle would gain nothing; behind it
    the rows of an id are neighbours, and whole batches are added up at once."""

    def add(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sums = batch.column("id"), _matrix(batch.column("sums"))
            runs = np.concatenate([[0], np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1])
            added = np.add.reduceat(sums, runs, axis=0)
            codes = _matrix(batch.column("codes"))[runs]
            if last is not None:
                if last[0] == ids[0]:
                    added[0] += last[2][0]
                else:
                    yield _lists(last[1], last[2])
            # The last id may go on in the next batch.
            last = ids[-1], codes[-1:], added[-1:]
            if len(runs) > 1:
                yield _lists(codes[:-1], added[:-1])
        if last is not None:
            yield _lists(last[1], last[2])

    return parts.repartition("id").sortWithinPartitions("id").mapInArrow(add, "codes array<int>, sums array<double>")


def _lists(codes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_list_column(codes.astype("int32")), _list_column(sums)], ["codes", "sums"])


def _list_column(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="int32") * rows.shape[1]), pa.array(rows.ravel()))


# --- agreement -------------------------------------------------------------------------------

def adjusted_rand(df: DataFrame, a: str, b: str) -> float:
    """Adjusted Rand index of two label columns from their contingency counts."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))

    def pairs(counts: DataFrame) -> float:
        return float(counts.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0)

    both = pairs(cells)
    first, second = (pairs(cells.groupBy(c).agg(F.sum("n").alias("n"))) for c in (a, b))
    every = pairs(cells.agg(F.sum("n").alias("n")))
    expected = first * second / every if every else 0.0
    top = (first + second) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)


def centre_shift(found: np.ndarray, reference: np.ndarray) -> float:
    """Mean distance from each centre to its nearest reference centre (k x k values)."""
    return float(np.linalg.norm(found[:, None] - reference[None], axis=2).min(axis=1).mean())


def nearest_centre_distance(df: DataFrame, centres: DataFrame, features: str = "features") -> DataFrame:
    """Distance of every row to its nearest centre; the k centres become literals."""
    rows = bounded_collect(centres, MAX_CLUSTERS, "centres")
    gaps = [F.sqrt(squared_distance(F.col(features), F.array(*[F.lit(float(v)) for v in row[0]]))) for row in rows]
    nearest = gaps[0] if len(gaps) == 1 else F.least(*gaps)
    return df.withColumn("nearest", nearest)


def validation_gate(score: float, strict: bool = False, threshold: float = 0.5) -> bool:
    """True if the silhouette passes; raises instead of failing when ``strict``."""
    passed = score > threshold
    if strict and not passed:
        raise ValueError(f"clustering quality insufficient: silhouette {score:.3f}, needed {threshold}")
    return passed
