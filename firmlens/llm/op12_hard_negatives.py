"""Hard negatives by bounds along a spanning tree of the anchors.

A row's score for an anchor is the inner product of their integer vectors.  Anchors
go into groups, and the anchors of a group form a minimum spanning tree.  Blocks of
rows meet every group: along an edge of the tree from parent p to child c a row x
has a score within |c - p| * |x| of its score (or its bounds) at p, so only rows
whose bounds overlap the window that is asked for are scored anew, exactly.

The first pass looks for the best rows of the anchor's own label: its window begins
at the least of those found so far.  The second pass looks, for every positive, at
rows of other labels: its window is the share of the positive's score that the
caller allows, and begins higher once enough rows were found.  Only the first few
rows of each anchor (and positive) leave a task.

Results: rows with a null id, label, vector or component, or a component that is
not finite, take no part; of rows that share an id one counts (the least label and
vector); a shorter vector counts as ending in zeros; an anchor without
another row of its label, or a positive without rows in its window, gives no rows;
ties go by id; an empty table gives no rows; other columns are never looked at.
Components from 2**20 on after scaling end the query, because scores would not be exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import cut_lineage
from firmlens.llm.vectors import blob, floored, in_blocks, matrix, usable, widest
from firmlens.session import lookup_join

# Anchors of one group; a block of rows has at most that many bounds a row.
GROUP_ANCHORS = 512
# Groups whose findings a task holds before it gives them out.
HELD_GROUPS = 32
# Groups (one row each, under 1 MB) that may be sent to every task; more of them are shuffled.
SENT_GROUPS = 64
FACTOR = 256


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge length) of a minimum spanning tree, parents before their children; the root is the point nearest to the mean."""
    n = len(points)
    order, parent, edge = np.empty(n, np.int32), np.full(n, -1, np.int32), np.zeros(n)
    at = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    gap, near, out = np.full(n, np.inf), np.full(n, -1, np.int32), np.ones(n, bool)
    for i in range(n):
        order[i], parent[at], edge[at] = at, near[at], 0.0 if near[at] < 0 else gap[at]
        out[at] = False
        away = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        closer = out & (away < gap)
        gap[closer], near[closer] = away[closer], at
        if i + 1 < n:
            at = int(np.where(out, gap, np.inf).argmin())
    return order, parent, edge


@dataclass
class Block:
    """Rows with ids, labels and integer vectors."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray

    def __post_init__(self):
        self.norms = np.sqrt((self.points**2).sum(axis=1))


@dataclass
class Group:
    """Anchors with their tree."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray

    def __post_init__(self):
        self.order, self.parent, self.edge = spanning_tree(self.points)

    def walk(self, block: Block, window) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, their exact scores) for every anchor; the rows hold all those with a score in ``window(anchor)`` = (low, high).

        The window is asked for when the anchor is reached, so it may follow from what was found before.
        """
        low, high = np.empty((2, len(self.ids), len(block.ids)))
        children = np.bincount(self.parent[self.parent >= 0], minlength=len(self.ids))
        for a in self.order:
            p = self.parent[a]
            if p < 0:
                scores = block.points @ self.points[a]
                low[a] = high[a] = scores
                least, most = window(a)
                rows = np.flatnonzero((scores >= least) & (scores <= most))
                yield a, rows, scores[rows]
                continue
            # A little more than the bound, for the roundings of roots and products.
            reach = (self.edge[a] * (1 + 1e-12)) * block.norms + 1e-6
            low[a], high[a] = low[p] - reach, high[p] + reach
            least, most = window(a)
            rows = np.flatnonzero((high[a] >= least) & (low[a] <= most))
            scores = block.points[rows] @ self.points[a]
            if children[a]:
                low[a][rows] = high[a][rows] = scores
            yield a, rows, scores


class Leaders:
    """The first ``n`` (id, score) of each of several lists: higher scores first, ties by smaller id."""

    def __init__(self, lists: int, n: int):
        self.n = n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * lists
        self.scores: list[np.ndarray] = [np.zeros(0)] * lists

    def least(self, at: int) -> float:
        """The score that a further row must reach."""
        return self.scores[at][-1] if len(self.scores[at]) == self.n else -np.inf

    def add(self, at: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > 4 * self.n:
            keep = scores >= np.partition(scores, len(scores) - self.n)[len(scores) - self.n]
            ids, scores = ids[keep], scores[keep]
        ids, scores = np.concatenate([self.ids[at], ids]), np.concatenate([self.scores[at], scores])
        first = np.lexsort((ids, -scores))[: self.n]
        self.ids[at], self.scores[at] = ids[first], scores[first]


class BestOfLabel:
    """First pass, one group: the best rows of each anchor's label, the anchor itself apart."""

    def __init__(self, group: Group, n: int):
        self.group, self.found = group, Leaders(len(group.ids), n)

    def meet(self, block: Block) -> None:
        present = set(block.labels.tolist())

        def window(a):
            return (self.found.least(a), np.inf) if self.group.labels[a] in present else (np.inf, -np.inf)

        for a, rows, scores in self.group.walk(block, window):
            fits = (block.labels[rows] == self.group.labels[a]) & (block.ids[rows] != self.group.ids[a]) & (scores >= self.found.least(a))
            if fits.any():
                self.found.add(a, block.ids[rows[fits]], scores[fits])

    def rows(self) -> list[np.ndarray]:
        sizes = [len(x) for x in self.found.ids]
        anchors = np.repeat(self.group.ids, sizes)
        return [anchors, np.concatenate(self.found.ids), np.concatenate(self.found.scores).astype(np.int64)]


class BestInWindow:
    """Second pass, one group: for each anchor and positive the best rows of other labels whose score lies in the positive's window."""

    def __init__(self, group: Group, positives: list[tuple[np.ndarray, np.ndarray]], n: int, shares: tuple[int, int]):
        self.group, self.positives = group, positives
        self.first = np.cumsum([0, *[len(p[0]) for p in positives]])
        self.found = Leaders(int(self.first[-1]), n)
        # shares[0] * positive <= 100 * negative <= shares[1] * positive, in whole numbers.
        self.low = [-(-(shares[0] * s) // 100) for _, s in positives]
        self.high = [(shares[1] * s) // 100 for _, s in positives]

    def _open(self, a: int) -> np.ndarray:
        """What a row must reach for each positive of the anchor."""
        reach = [self.found.least(int(at)) for at in range(self.first[a], self.first[a + 1])]
        return np.maximum(self.low[a], reach) if len(reach) else np.zeros(0)

    def meet(self, block: Block) -> None:
        def window(a):
            least, most = self._open(a), self.high[a]
            asked = least <= most
            return (least[asked].min(), most[asked].max()) if asked.any() else (np.inf, -np.inf)

        for a, rows, scores in self.group.walk(block, window):
            other = block.labels[rows] != self.group.labels[a]
            for i, least in enumerate(self._open(a)):
                fits = other & (scores >= least) & (scores <= self.high[a][i])
                if fits.any():
                    self.found.add(int(self.first[a]) + i, block.ids[rows[fits]], scores[fits])

    def rows(self) -> list[np.ndarray]:
        sizes = [len(x) for x in self.found.ids]
        anchors = np.repeat(np.repeat(self.group.ids, np.diff(self.first)), sizes)
        ids = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in self.positives]])
        scores = np.concatenate([np.zeros(0, np.int64), *[p[1] for p in self.positives]])
        none = np.zeros(0, np.int64)
        return [anchors, np.repeat(ids, sizes), np.repeat(scores, sizes), np.concatenate([none, *self.found.ids]), np.concatenate([none, *self.found.scores]).astype(np.int64)]


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of rows: ids, labels and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches):
            ids, labels = (blob(np.asarray(b.column(i), np.int64)) for i in (0, 1))
            points = blob(matrix(b.column(2), width).astype(np.int32))
            yield pa.RecordBatch.from_pylist([{"ids": ids, "labels": labels, "points": points}])

    return rows.select("id", "label", "v").mapInArrow(run, "ids binary, labels binary, points binary")


def _grouped(anchors: DataFrame, groups: int, width: int) -> DataFrame:
    """Groups of anchors (and what was found for them) as one row each."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        points = matrix(pa.array(pdf["v"].tolist(), pa.list_(pa.int32())), width).astype(np.int32)
        n = pdf["positives"].map(len).to_numpy(np.int64)
        pos = [p for row in pdf["positives"] for p in row]
        values = [blob(pdf["id"].to_numpy(np.int64)), blob(pdf["label"].to_numpy(np.int64)), blob(points), blob(n)]
        values += [blob(np.array([p[k] for p in pos], np.int64)) for k in ("id", "score")]
        return pd.DataFrame([[int(pdf["g"].iloc[0]), *values]], columns=["g", "g_ids", "g_labels", "g_points", "p_n", "p_ids", "p_scores"])

    keyed = anchors.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    return keyed.groupBy("g").applyInPandas(pack, "g int, g_ids binary, g_labels binary, g_points binary, p_n binary, p_ids binary, p_scores binary")


def _met(blocks: DataFrame, packed: DataFrame, groups: int, width: int, start, names: list[str]) -> DataFrame:
    """What ``start(group, positives)`` finds in the blocks it meets; each block meets each group of anchors once."""

    def numbers(column, i, kind=np.int64):
        return np.frombuffer(column[i].as_buffer(), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, object] = {}

        def out():
            for state in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in state.rows()], names)
            held.clear()

        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                g = c["g"][i].as_py()
                if g not in held:
                    if len(held) == HELD_GROUPS:
                        yield from out()
                    group = Group(numbers(c["g_ids"], i), numbers(c["g_labels"], i), numbers(c["g_points"], i, np.int32).reshape(-1, width).astype(float))
                    cuts = np.cumsum(numbers(c["p_n"], i))[:-1]
                    ids, scores = (np.split(numbers(c[x], i), cuts) for x in ("p_ids", "p_scores"))
                    held[g] = start(group, list(zip(ids, scores, strict=True)))
                points = numbers(c["points"], i, np.int32).reshape(-1, width).astype(float)
                held[g].meet(Block(numbers(c["ids"], i), numbers(c["labels"], i), points))
        yield from out()

    every = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return lookup_join(every, packed, ["g"], "inner", SENT_GROUPS).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _first(found: DataFrame, keys: list[str], id_: str, score: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key with their ``rank``; tasks have left few rows a key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), id_)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(
    rows: DataFrame, is_anchor: Column, id_: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    positives: int = 5, negatives: int = 10, shares: tuple[int, int] = (30, 90), group_anchors: int = GROUP_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` and ``label`` are expressions over the columns of ``rows``; scores of negatives lie between ``shares`` hundredths of the positive's.
    """
    label = F.col("label") if label is None else label
    taken = rows.where(F.col(id_).isNotNull() & usable(vector)).select(
        F.col(id_).cast("long").alias("id"), label.cast("long").alias("label"), floored(vector, FACTOR).alias("v"), is_anchor.alias("anchor"))
    least = F.min(F.struct("label", "v", "anchor")).alias("row")
    taken = cut_lineage(taken.where("label IS NOT NULL").groupBy("id").agg(least).select("id", "row.*"))
    width = max(1, widest(taken, "v"))
    anchors = taken.where("anchor")
    groups = max(1, -(-anchors.count() // group_anchors))
    blocks = cut_lineage(_packed(taken, width))

    nothing = F.array().cast("array<struct<id:bigint,score:bigint>>")
    bare = cut_lineage(_grouped(anchors.withColumn("positives", nothing), groups, width))
    near = _met(blocks, bare, groups, width, lambda group, _: BestOfLabel(group, positives), ["anchor_id", "positive_id", "positive_score"])
    near = _first(near, ["anchor_id"], "positive_id", "positive_score", positives)
    of_anchor = near.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    full = cut_lineage(_grouped(anchors.join(of_anchor, "id"), groups, width))
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    hard = _met(blocks, full, groups, width, lambda group, found: BestInWindow(group, found, negatives, shares), names)
    return _first(hard, ["anchor_id", "positive_id"], "negative_id", "negative_score", negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def corrected_label() -> Column:
    """The label that the query uses: shifted by one where the id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def every_hundredth() -> Column:
    return F.col("vec_id") % 100 == 0


def oracle_sql() -> str:
    """The same rows, every anchor scored against every row."""
    return """
        WITH kept AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                   list_inner_product(a.v, b.v)::BIGINT AS score
            FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT p.anchor_id, p.positive_id,
               row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
               n.other_id AS negative_id, p.positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id
        WHERE NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 10"""
