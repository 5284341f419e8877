"""Near copies by circulant MinHash, banding and exact Jaccard verification.

A text's set are the hashes of its distinct k-word shingles.  Two permutations
of the 32-bit values make all signature coordinates: the first scatters the
set once, the second, shifted circularly by one place per coordinate, ranks it;
a coordinate is the least rank.  Rows of the signature form bands; texts that
share a band are candidates, unless the low bits of their coordinates differ in
more places than likeness allows (short of five standard deviations).

Documents with equal sets are one node.  In rounds, the nodes of a band are
compared with a leader of it that is drawn by hash, and links are contracted to
components; then all pairs of a band that are still in different components are
compared, so every candidate pair is either verified on the full sets or already
connected.  Bands of copies therefore cost a few comparisons per member and not
one per pair.  What is left for that last round are mostly texts that share a long passage and
are not quite alike enough; their nodes get a longer signature of two low bits a
coordinate, from the same two permutations, which tells them apart without a look at the sets.
Of pairs at the very threshold either comparison of bits loses about 3 in 10 million, less the more alike they are.

Results: a text without words has an empty set and is alone; fewer words than a
shingle make one shingle of all; a null doc_id is alone, its component null;
repeated rows get equal answers; rows that share a doc_id but not a text count
as linked; an empty table gives no rows; ``deduplicate`` keeps all other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import checked_broadcast, cut_lineage, flat_text, rebatched
from firmlens.llm.components import components
from firmlens.llm.words import WordHashes, distinct, mix32, mix64, shingles

# A pair of likeness 0.8 misses all 64 bands of 8 rows with probability (1 - 0.8**8)**64 = 8e-6.
BANDS, ROWS = 64, 8
# Rounds in which the members of a band are compared with one leader, before all pairs that are left.
LEADER_ROUNDS = 2
# Longs of low bits that keep pairs with no chance of the likeness out of the verification.
LONGS = 8
# Coordinates and bits of each in the longer signature of nodes that the rounds have not connected.
MARKS, MARK_BITS = 4_096, 2
_SCATTER = (0x9E3779B1, 0x85EBCA77)
_RANK = (0x85EBCA6B, 0xC2B2AE35)


def signatures(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(n coordinates x texts) from the shingle hashes of texts that begin at ``starts``, none of them empty."""
    scattered = mix32((hashes >> np.uint64(32)).astype(np.uint32), *_SCATTER)
    out = np.empty((n, len(starts)), np.uint32)
    for k in range(n):
        out[k] = np.minimum.reduceat(mix32(scattered + np.uint32(k), *_RANK), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts x bands) hashes of each band with its number."""
    keys = np.empty((signature.shape[1], bands), np.uint64)
    for b in range(bands):
        key = np.full(signature.shape[1], b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + signature[b * rows + r])
        keys[:, b] = key
    return keys


def low_bits(signature: np.ndarray) -> np.ndarray:
    """(texts x LONGS): the lowest bits of the first 64 * LONGS coordinates, zeros where there are fewer."""
    odd = np.zeros((signature.shape[1], 64 * LONGS), np.uint8)
    used = signature[: 64 * LONGS]
    odd[:, : len(used)] = (used & np.uint32(1)).T
    return np.packbits(odd, axis=1).view(np.int64)


def most_differing(percent: int, coordinates: int = BANDS * ROWS, bits: int = 1, longest: int = 64 * LONGS) -> int:
    """Coordinates of that many low bits in which two texts of that likeness differ at most, but for five standard deviations' chance.

    Coordinates that disagree have equal low bits once in ``2**bits`` times.
    """
    n, p = min(longest, coordinates), (1 - percent / 100) * (1 - 0.5**bits)
    return int(n * p + 5 * (n * p * (1 - p)) ** 0.5) + 1


def sketches(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, low) of every row; the two set numbers name the set."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for batch in rebatched(batches, limit=1 << 20):
            found, n = shingles(*hasher.words(*flat_text(batch.column(1))), k)
            own, sizes = distinct(found, n)
            full = np.flatnonzero(sizes)
            first = (np.cumsum(sizes) - sizes)[full]
            names = np.zeros((2, len(sizes)), np.int64)
            keys, low = np.zeros((0, bands), np.uint64), np.zeros((0, LONGS), np.int64)
            if len(full):
                names[0, full] = np.add.reduceat(mix64(own + np.uint64(1)), first).view(np.int64)
                names[1, full] = np.bitwise_xor.reduceat(mix64(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first).view(np.int64)
                signature = signatures(own, first, bands * rows)
                keys, low = band_keys(signature, bands, rows), low_bits(signature)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
            lows = pa.ListArray.from_arrays(pa.array(ends // bands * LONGS), pa.array(low.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(names[0]), pa.array(names[1]), lists, lows], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "low"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, bands array<long>, low array<long>")


def sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, own) with the sorted distinct shingle hashes; one row per doc_id."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for batch in rebatched(batches, limit=1 << 20):
            own, sizes = distinct(*shingles(*hasher.words(*flat_text(batch.column(1))), k))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(own.view(np.int64)))], ["doc_id", "own"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, own array<long>")
    return rows.groupBy("doc_id").agg(F.max("own").alias("own"))


def marks(own: DataFrame) -> DataFrame:
    """(node, marks): the low bits of ``MARKS`` coordinates of each set, one plane of longs after the other."""
    kind = dict(own.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            offsets = np.asarray(column.offsets, np.int64)
            values = np.asarray(column.values).view(np.uint64)
            at = 0
            while at < batch.num_rows:
                # Sets of about a megabyte at a time, however the rows come.
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 17), side="right")) - 1)
                signature = signatures(values[offsets[at] : offsets[to]], offsets[at:to] - offsets[at], MARKS)
                planes = [np.packbits(np.ascontiguousarray(((signature >> np.uint32(bit)) & np.uint32(1)).astype(np.uint8).T), axis=1).view(np.int64) for bit in range(MARK_BITS)]
                rows = np.concatenate(planes, axis=1)
                ends = np.arange(to - at + 1, dtype=np.int32) * rows.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))], ["node", "marks"])
                at = to

    return own.select("doc_id", "own").mapInArrow(run, f"node {kind}, marks array<long>")


def verified(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``percent`` hundredths of their union in common.

    Sets are compared row by row where they were joined: no batch of them is held, however long they are.
    """
    with_b = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("own").alias("own_b")), "b")
    with_both = with_b.join(own.select(F.col("doc_id").alias("a"), F.col("own").alias("own_a")), "a")
    both = F.size(F.array_intersect("own_a", "own_b")).cast("long")
    counted = with_both.select("a", "b", both.alias("both"), (F.size("own_a") + F.size("own_b")).cast("long").alias("sum"))
    return counted.where((F.col("both") > 0) & (F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent)).select("a", "b")


def _may_reach(n_a: Column, n_b: Column, low_a: Column, low_b: Column, percent: int, coordinates: int) -> Column:
    """Sizes that allow the likeness, and signatures that do not speak against it."""
    differ = sum((F.bit_count(low_a[k].bitwiseXOR(low_b[k])) for k in range(1, LONGS)), F.bit_count(low_a[0].bitwiseXOR(low_b[0])))
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (differ <= most_differing(percent, coordinates))


def _leader_pairs(state: DataFrame, percent: int, coordinates: int, round_: int) -> DataFrame:
    """Distinct pairs (a, b) of each band's leader, drawn by hash anew in every round, with the members of other components."""
    draw = F.xxhash64("band", "node", F.lit(round_))
    leaders = state.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(F.struct("node", "n", "component", "low"), draw).alias("leader")).where("lo < hi")
    met = state.join(leaders, "band").where((F.col("component") != F.col("leader.component")) & _may_reach(F.col("n"), F.col("leader.n"), F.col("low"), F.col("leader.low"), percent, coordinates))
    return met.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()


def _marks_allow(marks_a: Column, marks_b: Column, percent: int) -> Column:
    """Longer signatures that do not speak against the likeness."""
    longs = MARKS // 64
    odd = F.zip_with(marks_a, marks_b, lambda x, y: x.bitwiseXOR(y))
    planes = [F.slice(odd, 1 + plane * longs, longs) for plane in range(MARK_BITS)]
    either = reduce(lambda x, y: F.zip_with(x, y, Column.bitwiseOR), planes)
    return F.aggregate(either, F.lit(0), lambda n, x: n + F.bit_count(x)) <= most_differing(percent, MARKS, MARK_BITS, MARKS)


def _pairs_apart(state: DataFrame, own: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """Distinct pairs (a, b) that share a band and not the component."""
    mixed = state.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    apart = cut_lineage(state.join(mixed, "band", "left_semi"))
    nodes = apart.select(F.col("node").alias("doc_id")).distinct()
    long = cut_lineage(marks(own.join(checked_broadcast(nodes), "doc_id", "left_semi")))
    # A pair comes from the first band that both are in, however many they share; a node has at most as many as the signature.
    own_bands = apart.groupBy("node").agg(F.collect_list("band").alias("of"))
    apart = apart.join(long.join(own_bands, "node"), "node")
    left, right = (apart.select("band", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "component", "low", "marks", "of")]) for side in "ab")
    open_ = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & _may_reach(F.col("n_a"), F.col("n_b"), F.col("low_a"), F.col("low_b"), percent, coordinates)
    once = F.array_min(F.array_intersect("of_a", "of_b")) == left["band"]
    met = left.join(right, (left["band"] == right["band"]) & open_ & _marks_allow(F.col("marks_a"), F.col("marks_b"), percent) & once)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def link(docs: DataFrame, k: int, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    sketch = cut_lineage(sketches(docs, k, bands, rows))
    of_set = ["set_a", "set_b", "n_shingles"]
    named = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = cut_lineage(named.groupBy(*of_set).agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("low", "doc_id").alias("low")))
    band_rows = nodes.select(F.explode("bands").alias("band"), "node", F.col("n_shingles").alias("n"))
    shared = band_rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band")
    candidates = cut_lineage(band_rows.join(shared, "band", "left_semi").join(nodes.select("node", "low"), "node"))
    used = cut_lineage(candidates.select(F.col("node").alias("doc_id")).distinct())
    own = cut_lineage(sets(docs.select("doc_id", "text").join(checked_broadcast(used), "doc_id", "left_semi"), k))
    # Rows of one doc_id with several sets: the id links them.
    twice = named.groupBy("doc_id", *of_set).agg(F.lit(1).alias("one")).join(nodes.drop("bands", "low"), of_set).where("doc_id <> node")
    links = twice.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    final, compared = components(cut_lineage(links)), None
    for round_ in range(LEADER_ROUNDS + 1):
        state = candidates.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
        pairs = _leader_pairs(state, percent, bands * rows, round_) if round_ < LEADER_ROUNDS else _pairs_apart(state, own, percent, bands * rows)
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        compared = pairs if compared is None else compared.union(pairs)
        known = final.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        final = cut_lineage(components(verified(pairs, own, percent).union(known)))
    by_set = nodes.select(*of_set, "node").join(final, "node", "left").select(*of_set, F.coalesce("component", "node").alias("component"))
    # Copies of one text share a set: the joint side has one row per set, and hot sets are split by the engine.
    joined = sketch.drop("bands", "low").join(by_set, of_set, "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns; of repeated rows of one doc_id one stays."""
    away = cut_lineage(link(docs, k, percent).where(~F.col("kept")).select("doc_id").distinct())
    kept = docs.join(checked_broadcast(away), "doc_id", "left_anti")
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
