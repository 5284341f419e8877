"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on words of ordinary texts, one on
words that toxic texts use beyond their share (a likelihood-ratio test against
ordinary texts, copies of a text counted once).  The toxic side compresses with
both dictionaries in a row, the ordinary side with its own alone.  A window is
one word of the text, in lower case and between blanks; behind it stands an
anchor that both sides know, so that headers and the encoder's blind tail cost
the same on both.  A window's distance is how many bytes shorter the toxic side
makes it, a text's the largest of its windows'.  On training texts that the
dictionaries have not seen, each distance gets the share of toxic texts among
all of its kind, made monotone: that is the score.

Labels are learned from at most about ``SAMPLE_DOCS`` rows of each label, chosen by
a hash of doc_id, each whole.  Every text is scored, whole.

Results: a null or empty text has distance 0; if one label was never learned the
score is the share of toxic labels (0 without labels); several labels of one
doc_id count as the largest, null labels as none; rows are scored one by one;
an empty table gives no rows; ``reject`` keeps all other columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.llm.common import cut_lineage, rebatched

SAMPLE_DOCS = 6_000
THRESHOLD = 0.7
# Shares of the training texts, in tenths, whose words go into the dictionaries; the rest calibrates.
DICTIONARY_TENTHS = 7
ORDINARY_BYTES = 64 << 10
# A word is toxic text's own from this likelihood ratio and this share of toxic texts on.
LEAST_RATIO = 30.0
LEAST_SHARE = 0.004
MAX_DISTANCE = 16
# Longer words are cut into windows of so many bytes.
WINDOW_BYTES = 64
KEPT_WORDS = 400_000
ANCHOR = bytes((37 * i + 11) % 256 for i in range(48))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: Column) -> Column:
    """Lower-case words between single blanks, everything but letters left out."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}+", " ")))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    scores: list[float]


class Distance:
    """Distances of words under one model."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # The ordinary side has foreign bytes in the place of the toxic words, so that all offsets are the same.
        filler = bytes(248 + (i * i // 7 + 3 * i) % 8 for i in range(len(toxic)))
        self.sides = [_compressor(filler + ordinary + ANCHOR), _compressor(toxic + ordinary + ANCHOR)]
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        data = word.encode()
        best = 0
        for at in range(0, len(data), WINDOW_BYTES):
            window = b" " + data[at : at + WINDOW_BYTES] + b" " + ANCHOR
            ordinary, toxic = (len(side.compress(window)) for side in self.sides)
            best = max(best, ordinary - toxic)
        return min(best, MAX_DISTANCE)

    def texts(self, column: pa.Array) -> np.ndarray:
        """Largest distance of each text's words."""
        words = pc.split_pattern(column, " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        for w in distinct:
            if w not in known:
                known[w] = self.word(w)
        each = np.fromiter((known[w] for w in distinct), np.int16, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        offsets = np.asarray(words.offsets) - words.offsets[0].as_py()
        return np.maximum.reduceat(each, offsets[:-1]) if len(each) else np.zeros(len(column), np.int16)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(3, window_log=18, hash_log=17, chain_log=17, write_content_size=0, write_dict_id=0, write_checksum=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def _train(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary; plain content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _train_ordinary(counts: dict[str, int]) -> bytes:
    """From runs of words, each as often as it counts (50 times at most)."""
    words = [w for w, n in sorted(counts.items()) for _ in range(min(n, 50))]
    np.random.default_rng(0).shuffle(words)
    return _train([(" " + " ".join(words[i : i + 16]) + " ").encode() for i in range(0, len(words), 16)], ORDINARY_BYTES, 256)


def _train_toxic(own: dict[str, int]) -> bytes:
    """From runs of one word each, so that training cuts no two words together; words it lost are added whole."""
    samples = [((" " + w) * 8 + " ").encode() for w, n in sorted(own.items()) for _ in range(min(n, 20))]
    out = _train(samples, max(1024, 6 * sum(len(w.encode()) + 1 for w in own)), 32)
    return out + "".join(f" {w} " for w in sorted(own, key=lambda w: (own[w], w)) if f" {w} ".encode() not in out).encode()


def _toxic_words(toxic: dict[str, int], ordinary: dict[str, int], n_toxic: int, n_ordinary: int) -> dict[str, int]:
    out = {}
    for w, a in toxic.items():
        b, n = ordinary.get(w, 0), n_toxic + n_ordinary
        if a / n_toxic <= b / n_ordinary or a < LEAST_SHARE * n_toxic:
            continue
        ratio = 2 * (a * math.log(a * n / ((a + b) * n_toxic)) + (b * math.log(b * n / ((a + b) * n_ordinary)) if b else 0.0))
        if ratio >= LEAST_RATIO:
            out[w] = a
    return out


def _monotone(toxic: np.ndarray, total: np.ndarray, prior: float) -> list[float]:
    """Share of toxic texts by distance, never falling (adjacent violators pooled), with one pseudo text of the prior."""
    blocks: list[list[float]] = []
    for t, n in zip(toxic, total, strict=True):
        blocks.append([float(t), float(n), 1])
        while len(blocks) > 1 and blocks[-2][0] * (blocks[-1][1] or 1e-9) >= blocks[-1][0] * (blocks[-2][1] or 1e-9):
            t2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return [(t + prior) / (n + 1.0) for t, n, k in blocks for _ in range(int(k))]


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_DOCS) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, words, part) of the bounded sample, each distinct text once, and how many labelled rows there are of each label."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    usable = usable.where(~held_out())
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, min(1.0, per_label / n)).otherwise(share)
    picked = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * float(1 << 30))
    # About per_label ids of each label.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("hash", F.xxhash64("words")).dropDuplicates(["toxic", "hash"])
    return rows.select("toxic", "words", (F.pmod("hash", F.lit(10)) >= DICTIONARY_TENTHS).alias("calibrates")), counts


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_DOCS) -> Model:
    rows, counts = training_rows(docs, labels, per_label)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if not counts.get(0) or not counts.get(1):
        return Model(b"", b"", [prior] * (MAX_DISTANCE + 1))
    sample = cut_lineage(rows)
    part = sample.where(~F.col("calibrates"))
    sizes = {r["toxic"]: r["n"] for r in part.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(b"", b"", [prior] * (MAX_DISTANCE + 1))
    by_word = part.select("toxic", F.explode(F.array_distinct(F.split("words", " "))).alias("word")).groupBy("toxic", "word").agg(F.count("*").alias("n"))
    found: dict[int, dict[str, int]] = {0: {}, 1: {}}
    # Words of the bounded sample that two texts share.
    for r in by_word.where((F.col("n") > 1) & (F.col("word") != "")).toLocalIterator():
        found[r["toxic"]][r["word"]] = r["n"]
    own = _toxic_words(found[1], found[0], sizes[1], sizes[0])
    ordinary, toxic = _train_ordinary(found[0]), _train_toxic(own) if own else b""
    model = Model(ordinary, toxic, [])
    held = distances(sample.where(F.col("calibrates")).select("toxic", "words"), model)
    table = np.zeros((2, MAX_DISTANCE + 1))
    for r in held.groupBy("toxic", "distance").agg(F.count("*").alias("n")).collect():
        table[r["toxic"], r["distance"]] = r["n"]
    # The sample holds labels in other shares than the table: weigh them back, both by the sizes before any change.
    factor = min(1.0, table.sum() / sum(counts.values()))
    for label in (0, 1):
        table[label] *= counts[label] / max(1.0, table[label].sum()) * factor
    model.scores = _monotone(table[1], table.sum(axis=0), prior)
    return model


def distances(rows: DataFrame, model: Model, words: str = "words") -> DataFrame:
    """``rows`` with each text's ``distance`` in place of its words."""
    ordinary, toxic = model.ordinary, model.toxic
    kept = [f for f in rows.schema.fields if f.name != words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Distance(ordinary, toxic)
        for batch in rebatched(batches, size_of=words):
            at = batch.schema.get_field_index(words)
            found = measure.texts(batch.column(at).cast(pa.string()))
            others = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), pa.array(found.astype(np.int32))], [*(batch.schema.names[k] for k in others), "distance"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("distance", T.IntegerType())]))


def _score(model: Model) -> Column:
    return F.element_at(F.array(*[F.lit(float(s)) for s in model.scores]), F.col("distance") + 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and distance of every row."""
    rows = docs.select("doc_id", held_out().alias("held_out"), words_of(F.col("text")).alias("words"))
    scored = distances(rows, model).withColumn("score", _score(model))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("distance").cast("long").alias("distance"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    kept = distances(docs.select(row, words_of(F.col("text")).alias("words")), model).where(_score(model) < THRESHOLD)
    return kept.select(*[F.col("row")[c].alias(c) for c in names])
