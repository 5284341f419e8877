"""Vector codes: product quantisation by Lloyd rounds over cover trees.

Integer vectors are cut into equal parts, and each part position has its own
codebook.  Rows stay in blocks; for every block and part position a cover tree is
built once over the distinct parts: a node holds a centre, the radius around it
and a range of the parts in tree order, with running sums of the parts and their
copies.  In a round a task goes down the trees with the codebook.  Where the
nearest entry of a centre stays nearest for the whole ball (second distance less
first above twice the radius) the subtree is assigned at once and its sums are two
looks at the running sums; only nodes that are left open are opened, down to
single parts, which are compared exactly.  The sums of a task, one row per part position and entry,
make the next codebook, so a round brings no more than that to the driver.

Results: rows without a vector, with null or with non-finite components are left
out; a shorter vector counts as ending in zeros, up to a multiple of the parts;
fewer rows than entries make a smaller codebook; rows that share an id all count
and all come back (null ids too, which come last among the first entries); rows
without a label form one label; an empty table gives no rows; other columns are
never looked at.  Components from 2**20 on after scaling end the query, because distances would not be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import cut_lineage
from firmlens.llm.vectors import blob, floored, in_blocks, matrix, usable, widest
from firmlens.session import lookup_join

PARTS, ENTRIES, ROUNDS, FACTOR = 4, 256, 4, 1024
# Rows of one block; a tree costs the square of it, once.
TREE_ROWS = 2_048


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers, exact in doubles."""
    return (points**2).sum(axis=1)[:, None] - 2.0 * (points @ entries.T) + (entries**2).sum(axis=1)[None]


@dataclass
class CoverTree:
    """Nodes over distinct points in tree order; children of a node stand side by side."""

    points: np.ndarray  # distinct points, in tree order
    copies: np.ndarray  # rows of each point
    centre: np.ndarray  # per node: its point
    lo: np.ndarray  # per node: first point of its subtree
    hi: np.ndarray  # per node: behind the last one
    radius: np.ndarray  # per node: largest distance from the centre to a point of the subtree
    first: np.ndarray  # per node: first child
    children: np.ndarray  # per node: how many

    KINDS = (np.int32, np.int64, np.int32, np.int32, np.int32, np.float64, np.int32, np.int32)

    def blobs(self) -> list[bytes]:
        return [blob(np.asarray(x, kind)) for x, kind in zip(astuple(self), self.KINDS, strict=True)]

    @classmethod
    def of_blobs(cls, blobs: list[pa.Buffer], width: int) -> CoverTree:
        arrays = [np.frombuffer(b, kind) for b, kind in zip(blobs, cls.KINDS, strict=True)]
        return cls(arrays[0].reshape(-1, width).astype(float), *arrays[1:])

    @classmethod
    def over(cls, points: np.ndarray, copies: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """(tree over distinct points, where each given point stands in it)."""
        parent, level = _nets(points)
        below: list[list[int]] = [[] for _ in points]
        for p in range(len(points)):
            if parent[p] >= 0:
                below[parent[p]].append(p)
        order, nodes = [], []  # nodes: [centre, lo, hi, first child, children]
        # A node is a point with the children that it still covers, from its widest level down; its first child is the point itself with less.
        root = max(range(len(points)), key=lambda p: level[p])
        nodes.append([root, 0, 0, 0, 0])
        stack = [(0, root, sorted(below[root], key=lambda c: -level[c]), False)]
        while stack:
            at, p, covered, done = stack.pop()
            if done:
                nodes[at][2] = len(order)
                continue
            nodes[at][1] = len(order)
            if not covered:
                order.append(p)
                nodes[at][2] = len(order)
                continue
            same = next((i for i, c in enumerate(covered) if level[c] != level[covered[0]]), len(covered))
            opened = [(p, covered[same:]), *[(c, sorted(below[c], key=lambda x: -level[x])) for c in covered[:same]]]
            nodes[at][3:] = [len(nodes), len(opened)]
            stack.append((at, p, covered, True))
            for i, (q, rest) in enumerate(opened):
                stack.append((len(nodes) + i, q, rest, False))
            nodes.extend([q, 0, 0, 0, 0] for q, _ in opened)
        order = np.array(order)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        table = np.array(nodes)
        sorted_points = points[order].astype(float)
        radius = np.zeros(len(nodes))
        for i in np.flatnonzero(table[:, 4]):
            subtree = sorted_points[table[i, 1] : table[i, 2]]
            radius[i] = np.sqrt(((subtree - points[table[i, 0]]) ** 2).sum(axis=1).max())
        return cls(sorted_points, copies[order], place[table[:, 0]], table[:, 1], table[:, 2], radius, table[:, 3], table[:, 4]), place

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first point, end, entry) of ranges that together are all points; each point's entry is its nearest, ties to the lowest."""
        # Of equal entries only the lowest can be chosen; the others would hide that a ball is clear.
        distinct = np.sort(np.unique(entries, axis=0, return_index=True)[1])
        used = entries[distinct]
        known = np.full(len(self.points), -1, np.int64)
        best, gap = np.zeros(len(self.points), np.int64), np.full(len(self.points), np.inf)
        starts, ends, chosen = [], [], []
        wave = np.zeros(1, np.int64)
        while len(wave):
            centre = self.centre[wave]
            new = np.unique(centre[known[centre] < 0])
            if len(new):
                known[new] = 0
                found = squared(self.points[new], used)
                best[new] = found.argmin(axis=1)
                if len(used) > 1:
                    two = np.sqrt(np.partition(found, 1, axis=1)[:, :2])
                    gap[new] = two[:, 1] - two[:, 0]
            clear = (self.children[wave] == 0) | (gap[centre] > 2 * self.radius[wave] * (1 + 1e-12) + 1e-6)
            done = wave[clear]
            starts.append(self.lo[done])
            ends.append(self.hi[done])
            chosen.append(distinct[best[centre[clear]]])
            left = wave[~clear]
            n = self.children[left].astype(np.int64)
            wave = np.repeat(self.first[left] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(chosen)

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their summed parts per entry, from differences of running sums."""
        starts, ends, chosen = self.assign(entries)
        running = np.zeros((len(self.points) + 1, self.points.shape[1]), np.int64)
        np.cumsum(self.points.astype(np.int64) * self.copies[:, None], axis=0, out=running[1:])
        rows = np.concatenate([[0], np.cumsum(self.copies)])
        counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
        np.add.at(counts, chosen, rows[ends] - rows[starts])
        np.add.at(sums, chosen, running[ends] - running[starts])
        return counts, sums

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """The entry of every distinct point, in tree order."""
        starts, ends, chosen = self.assign(entries)
        order = np.argsort(starts, kind="stable")
        return np.repeat(chosen[order], (ends - starts)[order])


def _nets(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, level) of distinct points: those of one level are more than 2**level apart, and a parent is of a higher level and nearer than 2**(level + 1).

    The points are taken farthest first, so each prefix is a net of all points.
    """
    n = len(points)
    points = points.astype(float)
    parent, level = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    away = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    near = np.zeros(n, np.int64)
    above, now = near.copy(), None
    level[0] = int(np.floor(np.log2(max(away.max(), 1.0)))) + 2
    for _ in range(n - 1):
        p = int(away.argmax())
        level[p] = int(np.floor(np.log2(away[p])))
        if level[p] != now:
            # From here on points are of a lower level: what was chosen so far are their possible parents.
            above, now = near.copy(), level[p]
        parent[p] = above[p]
        gap = np.sqrt(((points - points[p]) ** 2).sum(axis=1))
        closer = gap < away
        away[closer], near[closer] = gap[closer], p
        away[p] = 0.0
    return parent, level


_BLOCK = "points binary, places array<binary>, trees array<array<binary>>"


def forests(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of rows (id, label, v) with one cover tree per part position."""
    part = width // PARTS
    kinds = dict(rows.dtypes)
    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, {_BLOCK}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches, TREE_ROWS):
            points = matrix(b.column(2), width).astype(np.int32)
            places, trees = [], []
            for k in range(PARTS):
                distinct, inverse, copies = np.unique(points[:, k * part : (k + 1) * part], axis=0, return_inverse=True, return_counts=True)
                tree, place = CoverTree.over(distinct, copies)
                places.append(blob(place[inverse.reshape(-1)].astype(np.int32)))
                trees.append(tree.blobs())
            whole = pa.array([0, b.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(whole, b.column(0)), pa.ListArray.from_arrays(whole, b.column(1)), pa.array([blob(points)]),
                 pa.array([places], pa.list_(pa.binary())), pa.array([trees], pa.list_(pa.list_(pa.binary())))],
                ["ids", "labels", "points", "places", "trees"])

    return rows.select("id", "label", "v").mapInArrow(run, schema)


def _trees(batch: pa.RecordBatch, i: int, part: int) -> list[CoverTree]:
    return [CoverTree.of_blobs([x.as_buffer() for x in tree.values], part) for tree in batch.column("trees")[i].values]


def next_codebook(blocks: DataFrame, book: np.ndarray) -> np.ndarray:
    """One Lloyd round; ``book`` is (parts x entries x components), and entries without rows stay."""
    parts, entries, part = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, part), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for k, tree in enumerate(_trees(batch, i, part)):
                    n, s = tree.sums(book[k].astype(float))
                    counts[k] += n
                    sums[k] += s
        at = np.argwhere(counts > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(counts[at[:, 0], at[:, 1]]),
             pa.array(list(sums[at[:, 0], at[:, 1]]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = blocks.select("trees").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(part)]).alias("sums"))
    book = book.copy()
    # At most one row per part position and entry.
    for r in total.collect():
        book[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return book


def coded(blocks: DataFrame, book: np.ndarray, kinds: dict[str, str]) -> DataFrame:
    """(id, label, code, error) of every row."""
    parts, _, part = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                points = np.frombuffer(batch.column("points")[i].as_buffer(), np.int32).reshape(-1, parts, part).astype(np.int64)
                places = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("places")[i].values]
                codes = np.stack([t.codes(book[k].astype(float))[places[k]] for k, t in enumerate(_trees(batch, i, part))], axis=1)
                error = np.zeros(len(points), np.int64)
                for k in range(parts):
                    error += ((points[:, k] - book[k][codes[:, k]]) ** 2).sum(axis=1)
                text = [c.tobytes().hex() for c in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(text, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in book.reshape(-1).tolist()).encode()).hexdigest()


def first_codebook(rows: DataFrame, width: int) -> np.ndarray:
    """The parts of the rows with the smallest ids, ascending; at most as many rows as a codebook has entries."""
    seeds = rows.orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).select("v").collect()
    points = np.zeros((len(seeds), width), np.int64)
    for i, r in enumerate(seeds):
        points[i, : len(r["v"])] = r["v"]
    return points.reshape(len(seeds), PARTS, width // PARTS).transpose(1, 0, 2).copy()


def compress(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row with a usable vector."""
    taken = cut_lineage(rows.where(usable(vector)).select(F.col(id_).alias("id"), F.col(label).alias("label"), floored(vector, FACTOR).alias("v")))
    width = -(-max(1, widest(taken, "v")) // PARTS) * PARTS
    book = first_codebook(taken, width)
    if not book.shape[1]:
        return taken.limit(0).select(F.col("id").alias(id_), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    blocks = cut_lineage(forests(taken, width))
    for _ in range(rounds):
        book = next_codebook(blocks, book)
    codes = cut_lineage(coded(blocks, book, dict(taken.dtypes)).withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    by_label = codes.groupBy("of").agg(F.sum("error").alias("label_error"))
    return lookup_join(codes, by_label, ["of"]).select(F.col("id").alias(id_), "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same rows, every part compared with every entry; a vector has the same length in all rows."""
    steps = [f"""
        kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor({FACTOR} * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cut AS (
            SELECT row_number() OVER () AS id, vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v
            FROM kept, range({PARTS}) AS parts(part)),
        c0 AS (
            SELECT part, entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM cut) WHERE entry < {ENTRIES})"""]
    for i in range(rounds + 1):
        steps.append(f"""
        n{i} AS (
            SELECT id, vec_id, cut.part, any_value(label) AS label, any_value(cut.v) AS v,
                   arg_min(entry, gap * {ENTRIES} + entry) AS entry, min(gap) AS gap
            FROM (SELECT cut.*, entry, list_inner_product(cut.v, cut.v) - 2 * list_inner_product(cut.v, c.v) + list_inner_product(c.v, c.v) AS gap
                  FROM cut JOIN c{i} c ON cut.part = c.part) cut
            GROUP BY id, vec_id, cut.part)""")
        if i < rounds:
            steps.append(f"""
        m{i} AS (
            SELECT part, entry, list(m ORDER BY pos) AS v
            FROM (SELECT part, entry, pos, floor(sum(x) / count(*)) AS m
                  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM n{i}) GROUP BY part, entry, pos)
            GROUP BY part, entry),
        c{i + 1} AS (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON c.part = m.part AND c.entry = m.entry)""")
    last = f"n{rounds}"
    return f"""
        WITH {",".join(steps)},
        rows AS (
            SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error
            FROM {last} GROUP BY vec_id),
        book AS (
            SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
            FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM c{rounds}))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows, book"""
