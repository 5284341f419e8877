"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: at a context of up to ``ORDER``
preceding bytes, a byte that followed ``c`` times there has probability
``(2c - 1) / 2n``; the rest, ``distinct / 2n``, is the escape to the context one
byte shorter (escape method D, without exclusions), and below the empty context
every byte of 256 is equally likely.  Statistics are frozen after training, so
the exact code length of a byte depends only on it and the bytes before; a
text's code length is the sum over its bytes.  The language with the shortest
code wins, and the score is its posterior among the learned languages.

Training texts are a sample of the labelled rows: at most about ``SAMPLE_DOCS``
of each language, chosen by a hash of doc_id, each whole.  That bounds the
model.  Every text is scored, whole.

Results: a null text or one without a letter is ``und`` with score 0; equal
texts get equal answers; ties go to the first language in sorted order; if no
language could be learned every answer is ``und``; an empty table gives no rows;
repeated rows are answered one by one and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import flat_text, rebatched

# Longest context in bytes.
ORDER = 3
# Bound on the training documents of a language; each is read whole.
SAMPLE_DOCS = 3_000
# Bytes of text scored at a time.
STEP_BYTES = 1 << 20


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text) of about ``per_language`` labelled rows of each language, chosen by hash."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("__share") * float(1 << 30)
    return rows.join(F.broadcast(counts.select("lang", share.alias("__share"))), "lang").where(picked).select("lang", "text")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) for the ORDER + 1 bytes that end at each byte; bytes before a text's start are spaces."""
    width = ORDER + 1
    for batch in rebatched(batches):
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        data, offsets = flat_text(batch.column(1))
        for lang in sorted(set(langs)):
            parts = [np.concatenate([np.full(ORDER, 32, np.uint8), data[offsets[i] : offsets[i + 1]]]) for i in np.flatnonzero(langs == lang)]
            grams = np.concatenate([_grams(p, width) for p in parts])
            keys, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
            )


def _grams(padded: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(max(0, len(padded) - width + 1), np.uint32)
    for k in range(width):
        out = (out << np.uint32(8)) | padded[k : k + len(out)]
    return out


class ContextTrees:
    """Frozen code lengths of all languages, laid out for lookups.

    A state is a context that occurs in some language's training texts.
    ``next`` leads from a state and a byte symbol to the longest known context
    that then ends there; ``bits`` holds the code length of every symbol at every
    state, a row per language.
    """

    def __init__(self, counts: dict[str, dict[int, int]]):
        self.languages = sorted(counts)
        grams = {g for c in counts.values() for g in c}
        seen = sorted({(g >> 8 * k) & 255 for g in grams for k in range(ORDER + 1)})
        # All bytes outside the training text have the same code length in any context: they share symbol 0.
        self.symbol = np.zeros(256, np.int32)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.n_symbols = len(seen) + 1
        by_order = [{lang: {} for lang in self.languages} for _ in range(ORDER + 1)]
        for lang, c in counts.items():
            for g, n in c.items():
                symbols = tuple(int(self.symbol[(g >> 8 * k) & 255]) for k in range(ORDER, -1, -1))
                for k in range(ORDER + 1):
                    followers = by_order[k][lang].setdefault(symbols[ORDER - k : ORDER], {})
                    followers[symbols[ORDER]] = followers.get(symbols[ORDER], 0) + n
        contexts: list[list[tuple]] = [sorted({c for lang in self.languages for c in by_order[k][lang]}) for k in range(ORDER + 1)]
        # Row 0 of each order stands for an unknown context; order 0 has the empty context alone, as row 0.
        ids: list[dict[tuple, int]] = [{(): 0}] + [{c: i + 1 for i, c in enumerate(contexts[k])} for k in range(1, ORDER + 1)]
        size = self.n_symbols
        # bits[k][row, symbol, language]: code length when the longest context looked at has k bytes.
        previous = np.full((1, size, len(self.languages)), 8.0, np.float64)
        levels = []
        for k in range(ORDER + 1):
            rows = 1 if k == 0 else len(contexts[k]) + 1
            level = np.empty((rows, size, len(self.languages)), np.float64)
            if k:
                level[0] = 0.0  # never used: an unknown context falls back to its known suffix
            for c, row in ids[k].items():
                shorter = previous[ids[k - 1][c[1:]]] if k else previous[0]
                for j, lang in enumerate(self.languages):
                    followers = by_order[k][lang].get(c)
                    if not followers:
                        level[row, :, j] = shorter[:, j]
                        continue
                    total, distinct = sum(followers.values()), len(followers)
                    level[row, :, j] = shorter[:, j] - np.log2(distinct / (2 * total))
                    for s, n in followers.items():
                        # The byte is coded here or after an escape, whichever way its probability is the sum of both.
                        here, below = (2 * n - 1) / (2 * total), distinct / (2 * total) * 2.0 ** -shorter[s, j]
                        level[row, s, j] = -np.log2(here + below)
            levels.append(level)
            previous = level
        # States are numbered order by order.  The known contexts are closed under prefixes and suffixes, so a
        # state's transitions are those of its suffix, but for the longer contexts that are known.
        self.first = np.cumsum([0] + [len(level) for level in levels])
        self.bits = np.ascontiguousarray(np.concatenate(levels).astype(np.float32).reshape(self.first[-1] * size, len(self.languages)).T)
        self.next = np.zeros((self.first[-1], size), np.int32)
        for k in range(ORDER + 1):
            for c, row in ids[k].items():
                if k:
                    self.next[self.first[k] + row] = self.next[self.first[k - 1] + ids[k - 1][c[1:]]]
            for c, row in ids[k + 1].items() if k < ORDER else ():
                self.next[self.first[k] + ids[k][c[:-1]], c[-1]] = self.first[k + 1] + row

    def states(self, symbols: np.ndarray) -> np.ndarray:
        """State before each symbol of a padded run: the longest known context among the last ORDER symbols.

        A state depends on the last ORDER symbols only, so ORDER lookups from the
        empty context give it for all positions at once.
        """
        n = len(symbols) - ORDER
        state = np.zeros(n, np.int32)
        for k in range(ORDER):
            state = self.next.reshape(-1)[state * self.n_symbols + symbols[k : k + n]]
        return state

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        texts, out = len(offsets) - 1, np.zeros((len(offsets) - 1, len(self.languages)))
        start = 0
        while start < texts:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + STEP_BYTES, side="right")) - 1)
            lengths = np.diff(offsets[start : stop + 1])
            # Each text is preceded by ORDER spaces.
            ends = np.cumsum(lengths + ORDER)
            padded = np.full(int(ends[-1]), self.symbol[32], np.int32)
            keep = np.ones(len(padded), bool)
            for k in range(ORDER):
                keep[ends - lengths - ORDER + k] = False
            padded[keep] = self.symbol[data[offsets[start] : offsets[stop]]]
            if len(padded) > ORDER:
                cells = self.states(padded).astype(np.int64) * self.n_symbols + padded[ORDER:]
                own = keep[ORDER:]
                cells = cells[own]
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                full = np.flatnonzero(lengths)
                if len(full):
                    for j in range(len(self.languages)):
                        out[start + full, j] = np.add.reduceat(self.bits[j][cells], bounds[full], dtype=np.float64)
            start = stop
        return out


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> ContextTrees:
    """Counts in Spark, summed per language; only the counts of the bounded sample reach the driver."""
    rows = training_rows(docs.select("doc_id", "text", "lang"), per_language)
    grams = rows.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[int, int]] = {}
    for r in grams.toLocalIterator():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return ContextTrees(counts)


def identify(docs: DataFrame, model: ContextTrees) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = docs.sparkSession
    # Plain arrays, so a worker needs no installed copy of this package.
    shared = spark.sparkContext.broadcast(vars(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = ContextTrees.__new__(ContextTrees)
        vars(trees).update(shared.value)
        for batch in rebatched(batches):
            column = batch.column(2)
            data, offsets = flat_text(column)
            lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()])
            if trees.languages:
                bits = trees.code_lengths(data, offsets)
                best = bits.argmin(axis=1)
                odds = np.exp2(-(bits - bits.min(axis=1, keepdims=True)))
                posterior = 1.0 / odds.sum(axis=1)
            else:
                lettered[:] = False
            lang = [trees.languages[best[i]] if ok else "und" for i, ok in enumerate(lettered)]
            score = [float(posterior[i]) if ok else 0.0 for i, ok in enumerate(lettered)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
