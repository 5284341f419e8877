"""Token ids in wavelet-matrix files, one file per shard of consecutive documents.

Texts become ids with the ``tokenizers`` library; each document ends with one
extra id.  A shard's ids are stored as a wavelet matrix: one bit plane per bit
of the largest id, each stably sorted by the bits above it.  Planes carry rank
counts per block, so a file by itself answers token access, counts of an id in
a range and the place of its k-th occurrence, without being unpacked.

File layout, little-endian: magic ``WVM1``, u32 planes, u64 ids, u64 documents;
then the document ends (u64 each); then for every plane, high bit first, its
number of zeros (u64), the bits (64 to a word, padded) and the count of ones
before each block of ``BLOCK_WORDS`` words (u64 each).  The whole is one zstd
frame.  A file is written under a private name and renamed, so a task that runs
twice leaves one whole file.

Results: a null text is empty and has only the end id; repeated rows and equal
doc_ids keep their own places, ordered by text; a null doc_id comes first; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import WordStore, byte_buckets, rebatched, scratch_path, text_bytes, tokenizer_path

MODEL = "word_bpe_49k.json"
END_ID = 2
# Text bytes of the documents that share a file, on average.
SHARD_BYTES = 6 << 20
BLOCK_WORDS = 8
# Words whose ids a task keeps.
KEPT_WORDS = 400_000
_MAGIC = b"WVM1"
_PARTING = "0"
# Small letters that no normaliser step changes, whatever stands beside them.
_LETTERS = "a-zß-öø-ÿ"
_WORD = re.compile(f"[{_LETTERS}]+")
# A run of ASCII marks (an apostrophe aside) between such a letter and a blank.
_LETTERS_AND_MARKS = rf"([{_LETTERS}])([!-&(-/:-@\[-`{{-~]+) "


class WaveletMatrix:
    """Rank, select and access over a sequence of ids, from bit planes."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray], n: int):
        self.planes, self.zeros, self.ranks, self.n = planes, zeros, ranks, n

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << level)) != 0
            words = np.frombuffer(_padded(np.packbits(bit, bitorder="little")), dtype="<u8")
            planes.append(words)
            ranks.append(_block_ranks(words))
            zeros.append(int(len(bit) - bit.sum()))
            ids = np.concatenate([np.compress(~bit, ids), np.compress(bit, ids)])
        return cls(planes, zeros, ranks, len(ids))

    def _ones(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane: a block count, whole words, and part of a word."""
        word, block = i >> 6, (i >> 6) // BLOCK_WORDS
        plane = self.planes[level]
        n = int(self.ranks[level][block]) + sum(int(w).bit_count() for w in plane[block * BLOCK_WORDS : word])
        return n + (int(plane[word]) & ((1 << (i & 63)) - 1)).bit_count() if i & 63 else n

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, words in enumerate(self.planes):
            bit = int(words[i >> 6]) >> (i & 63) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id in [start, stop)."""
        lo, hi = self._range(token, start, self.n if stop is None else stop)
        return hi - lo

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            if token >> (len(self.planes) - 1 - level) & 1:
                i = self._place(level, i - self.zeros[level], 1)
            else:
                i = self._place(level, i, 0)
        return i

    def _place(self, level: int, k: int, bit: int) -> int:
        """Place of the k-th such bit: search the block counts, then the words of a block."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def ids(self) -> np.ndarray:
        """All ids in order: from the last plane up, each plane tells where the rows of the one below it came from."""
        values = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, (words, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(words.view(np.uint8), bitorder="little", count=self.n).view(bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~bit)] = values[:zeros]
            above[np.flatnonzero(bit)] = values[zeros:] | values.dtype.type(1 << k)
            values = above
        return values


def _padded(packed: np.ndarray) -> bytes:
    return packed.tobytes() + b"\0" * (-len(packed) % 8 + 8)


def _block_ranks(words: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(words).astype(np.uint64)
    blocks = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK_WORDS)) if len(ones) else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.cumsum(blocks)]).astype("<u8")


def pack(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A shard file's bytes."""
    matrix = WaveletMatrix.build(ids)
    parts = [_MAGIC, np.uint32(len(matrix.planes)).tobytes(), np.uint64(matrix.n).tobytes(), np.uint64(len(ends)).tobytes(), ends.astype("<u8").tobytes()]
    for words, zeros, ranks in zip(matrix.planes, matrix.zeros, matrix.ranks, strict=True):
        parts += [np.uint64(zeros).tobytes(), words.tobytes(), ranks.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> tuple[WaveletMatrix, np.ndarray]:
    """The matrix and the document ends of a shard file."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    if raw[:4] != _MAGIC:
        raise ValueError("not a shard file")
    planes_n, n, n_docs = int(np.frombuffer(raw, "<u4", 1, 4)[0]), *map(int, np.frombuffer(raw, "<u8", 2, 8))
    at = 24
    ends = np.frombuffer(raw, "<u8", n_docs, at).astype(np.int64)
    at += 8 * n_docs
    n_words = (((n + 7) // 8 + 7) // 8) + 1
    n_ranks = -(-n_words // BLOCK_WORDS) + 1
    planes, zeros, ranks = [], [], []
    for _ in range(planes_n):
        zeros.append(int(np.frombuffer(raw, "<u8", 1, at)[0]))
        planes.append(np.frombuffer(raw, "<u8", n_words, at + 8))
        ranks.append(np.frombuffer(raw, "<u8", n_ranks, at + 8 + 8 * n_words))
        at += 8 + 8 * (n_words + n_ranks)
    return WaveletMatrix(planes, zeros, ranks, n), ends


class Encoder:
    """Ids of texts by the ``tokenizers`` library, which sees each distinct word of a task once.

    Spaces and line breaks part what the vocabulary's normaliser and pre-tokeniser treat apart, ASCII case is dropped
    by the normaliser, and a run of Latin letters is parted from ASCII punctuation behind it (an apostrophe aside).
    Texts with combining marks or with what may be a special token go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        # The model's characters for the bytes of each letter.
        self.signs = {ord(c): "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in map(chr, range(0xDF, 0x100)) if _WORD.fullmatch(c)}
        self.store = WordStore(self._learn, KEPT_WORDS)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _short(self, parts: list[str]) -> dict[str, list[int]]:
        """Ids of parts without white space, by the library's cheapest call that gives the same.

        A run of small Latin letters is one pre-token as it stands, so the model itself is asked.  Others go in groups,
        parted by a digit on its own, which is always one pre-token and one id; parts with that digit go one by one.
        """
        tokenize, signs, fits = self.tokenizer.model.tokenize, self.signs, _WORD.fullmatch
        out = {p: [t.id for t in tokenize(p if p.isascii() else p.translate(signs))] for p in parts if fits(p)}
        rest = [p for p in parts if p not in out]
        grouped = [p for p in rest if p and _PARTING not in p]
        out |= dict(zip(rest := [p for p in rest if not p or _PARTING in p], self._whole(rest), strict=True))
        (parting,) = self._whole([_PARTING])[0]
        groups = [grouped[k : k + 200] for k in range(0, len(grouped), 200)]
        for group, ids in zip(groups, self._whole([f" {_PARTING} ".join(g) for g in groups]), strict=True):
            found: list[list[int]] = [[]]
            for i in ids:
                if i == parting:
                    found.append([])
                else:
                    found[-1].append(i)
            out |= zip(group, found, strict=True)
        return out

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = self._short(words)
        found = [known[w] for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        return counts, ids, ids[:0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        texts = texts.fill_null("").cast(pa.string())
        odd = pc.match_substring_regex(texts, r"\p{M}|<\|").to_numpy(zero_copy_only=False)
        if odd.any():
            rows: list = [None] * len(texts)
            plain_ids, plain_n = self.encode(texts.filter(pa.array(~odd)))
            for i, ids in zip(np.flatnonzero(~odd), np.split(plain_ids, np.cumsum(plain_n)[:-1]), strict=False):
                rows[i] = ids
            for i in np.flatnonzero(odd):
                rows[i] = np.array(self._whole([texts[int(i)].as_py()])[0], np.int32)
            return np.concatenate(rows), np.array([len(r) for r in rows])
        lower = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        words = pc.split_pattern(pc.replace_substring_regex(lower, _LETTERS_AND_MARKS, r"\1 \2 "), " ")
        coded = words.flatten().dictionary_encode()
        which = self.store.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        where, ends = self.store.spread(which)
        bounds = np.asarray(words.offsets) - words.offsets[0].as_py()
        return self.store.ids[where], np.diff(np.concatenate([[0], ends])[bounds])


def encode_documents(docs: DataFrame, cuts: list, model_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(shard, doc_id, tie, width, ids) of every row: ids as little-endian integers of ``width`` bytes, ``tie`` orders equal doc_ids."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(cuts))
    path = model_path or tokenizer_path(MODEL)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        width = 2 if encoder.narrow and end_id < 1 << 16 else 4
        for batch in rebatched(batches):
            ids, n = encoder.encode(batch.column(2))
            ends = np.cumsum(n)
            with_end = np.full(len(ids) + len(n), end_id, f"<u{width}")
            own = np.ones(len(with_end), bool)
            own[ends + np.arange(len(n))] = False
            with_end[own] = ids
            offsets = np.concatenate([[0], np.cumsum(n + 1)]) * width
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(with_end)])
            doc_id = batch.column(0)
            shard = np.zeros(len(n), np.int32)
            if len(shared.value):
                known = doc_id.is_valid().to_numpy(zero_copy_only=False)
                shard[known] = np.searchsorted(shared.value, doc_id.drop_null().to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(shard), doc_id, batch.column(1), pa.array([width] * len(n), pa.int32()), blob.cast(pa.binary())], ["shard", "doc_id", "tie", "width", "ids"])

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(run, f"shard int, doc_id {kind}, tie long, width int, ids binary")


def _put(path: str, blob: bytes) -> None:
    """Write a file of a shared store whole: under a private name, then renamed."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    private = f"{place}.{uuid.uuid4().hex}"
    with store.open_output_stream(private) as out:
        out.write(blob)
    store.move(private, place)


def shard_bounds(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> list:
    """Smallest doc_id of each shard but the first; about as many documents in each."""
    n = byte_buckets(docs, text_bytes() + 1, shard_bytes)
    if n < 2:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n).alias("q")).first()["q"] or []
    return sorted(set(cuts))


def write_shards(docs: DataFrame, folder: str, model_path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the files; returns (shard, path, doc_ids, n_docs, n_tokens), a row per file."""
    rows = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri

    def store(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        nulls = pc.is_null(table.column("doc_id"))
        if pc.any(nulls).as_py():
            table = pa.concat_tables([table.filter(nulls), table.filter(pc.invert(nulls))])
        blobs = table.column("ids").to_pylist()
        width = table.column("width")[0].as_py()
        ids = np.frombuffer(b"".join(blobs), f"<u{width}")
        ends = np.cumsum([len(b) // width for b in blobs])
        path = f"{uri}/shard-{shard:08d}.wvm"
        _put(path, pack(ids, ends))
        return pa.table(
            {
                "shard": pa.array([shard], pa.int32()), "path": [path], "doc_ids": pa.array([table.column("doc_id").to_pylist()], pa.list_(table.schema.field("doc_id").type)),
                "n_docs": pa.array([len(ends)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()),
            }
        )

    encoded = encode_documents(rows, shard_bounds(rows, shard_bytes), model_path, end_id)
    return encoded.groupBy("shard").applyInArrow(store, f"shard int, path string, doc_ids array<{kind}>, n_docs long, n_tokens long")


def read_shards(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that ``index`` (of write_shards) names."""
    spark = index.sparkSession
    kind = dict(index.dtypes)["doc_ids"][len("array<") : -1]
    # A row per file: its ids count, not its documents.
    sizes = sorted(tuple(r) for r in index.select("shard", "n_tokens").toLocalIterator())
    starts, total = [], 0
    for shard, n in sizes:
        starts.append((shard, total))
        total += n
    first = spark.createDataFrame(starts, "shard int, first long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, place = fs.FileSystem.from_uri(row["path"])
                with store.open_input_stream(place) as source:
                    matrix, ends = unpack(source.read())
                raw = memoryview(matrix.ids().astype("<u4").tobytes())
                begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(row["first"] + begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    parts = index.select("shard", "path", "doc_ids").join(F.broadcast(first), "shard").select("path", "doc_ids", "first")
    return parts.repartition(max(1, min(len(starts), 4 * spark.sparkContext.defaultParallelism)), "path").mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write a corpus to shard files in the shared folder and read them back."""
    from firmlens.llm.common import cut_lineage

    folder = scratch_path(docs.sparkSession, "tokens")
    _make_folder(folder)
    return read_shards(cut_lineage(write_shards(docs, folder, shard_bytes=shard_bytes)))


def _make_folder(folder: str) -> None:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    store.create_dir(place, recursive=True)
