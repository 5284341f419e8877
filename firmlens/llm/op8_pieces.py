"""SentencePiece encoding with offsets, and decoding.

A text is normalised through the vocabulary's compiled character map: at each
byte the longest key of its double-array trie is replaced by the key's value
(one code point stays as it is where no key fits), and every output byte keeps
the input byte it came from.  Then white space is escaped and the dummy prefix
added, as the model's settings say.  The library splits the normalised text into
pieces; each piece is projected through the alignment to a span of original
bytes.  No piece spans an escaped space after another character, so each
distinct word is split once in a step.

Results: a null text is empty and has no ids; bytes that no piece covers become
byte pieces that share the span of their character; an empty table gives no
rows; rows are encoded one by one, so ties and repeats do not matter; other
columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import WordStore, flat_text, rebatched, tokenizer_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# A segment: spaces and what follows up to the next space or line break, or a line break and what follows.
_SEGMENT = re.compile(r" +[^ \n]*|\n[^ \n]*")


class CharMap:
    """Longest-prefix replacement by a compiled character map (a double-array trie and its values)."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.values = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(value, bytes of the key) of the longest key at ``at``."""
        units = self.units
        if not units:
            return None
        # A unit: value in the low 31 bits of a leaf; else label in the low byte, bit 8 for "has a leaf", offset above.
        node, found = _offset(units[0]), None
        for n in range(at, len(data)):
            node ^= data[n]
            unit = units[node]
            if unit & 0x800000FF != data[n]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (self.values[start : self.values.index(b"\0", start)], n + 1 - at)
        return found


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 512) >> 6)


class Pieces:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as source:
            model.ParseFromString(source.read())
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        pieces = [p.piece for p in model.pieces]
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        # With an empty map and no squeezing, normalisation is the escape of spaces alone.
        self.plain = not self.map.units and not self.squeeze and self.escape and self.apart and self.prefix
        # Bytes of normalised text and of the original that each piece stands for.
        self.length = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in model.pieces], np.int32)
        self.original = self.length - np.array([2 * p.piece.count(SPACE) for p in model.pieces], np.int32)
        self.part_byte = np.array([p.type == p.BYTE and int(p.piece[1:-1], 16) > 127 for p in model.pieces])
        self.space = self.library.piece_to_id(SPACE)
        self.store = WordStore(self._learn, KEPT_WORDS)

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """Normalised text, and for each of its UTF-8 bytes (and the end) the original byte it stands for."""
        data = text.encode("utf-8", "surrogatepass")
        out, source, at = bytearray(), [], 0
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                first = data[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                found = (data[at : at + n], n)
                aligned = [at + k for k in range(len(found[0]))]
            else:
                aligned = [at] * len(found[0])
            value, n = found
            if self.squeeze and value == b" " and (not out or out[-1:] == b" "):
                at += n
                continue
            out += value
            source += aligned
            at += n
        if self.squeeze:
            while out[-1:] == b" ":
                out.pop()
                source.pop()
        source.append(len(data) if not self.squeeze or not source else source[-1] + 1)
        space = SPACE.encode() if self.escape else b" "
        full, align = bytearray(), []
        if self.prefix and out:
            full += space
            align += [source[0]] * len(space)
        for byte, place in zip(bytes(out), source, strict=False):
            if byte == 32 and self.escape:
                full += space
                align += [place] * len(space)
            else:
                full.append(byte)
                align.append(place)
        return full.decode("utf-8", "surrogatepass"), [*align, source[-1]]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of segments and the original bytes of each: spaces and the word behind them, or a line break and one.

        The library's dummy prefix stands for a segment's first space; a line break has none.
        """
        found = self.library.encode(words, num_threads=1)
        for k, word in enumerate(words):
            if not word:
                found[k] = [self.space]
            elif word[0] == "\n":
                found[k] = found[k][1:]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        # An escaped space has 3 bytes and stands for 1; so do the spaces within a segment.
        size = self.original[ids]
        return counts, ids, size

    def segments(self, text: str) -> list[str]:
        """The text cut where no piece can reach over: before spaces that follow another character and around line breaks.

        Of a segment that starts with a space, that space is left out; the dummy prefix of the library stands for it.
        """
        return [s[1:] if s[0] == " " else s for s in _SEGMENT.findall(" " + text.replace(SPACE, " "))]

    def encode(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """Ids, and the first and the end original byte of each piece."""
        if not text:
            return [], [], []
        if self.plain:
            distinct = list(dict.fromkeys(cut := self.segments(text)))
            places = dict(zip(distinct, self.store.look_up(distinct), strict=True))
            ids = self.store.ids[self.store.spread(np.array([places[s] for s in cut]))[0]].tolist()
        else:
            ids = self.library.encode(text)
        lengths = self.length[ids].tolist()
        normal, align = self.normalise(text)
        ends, at, size = [], 0, len(align) - 1
        for i, n in zip(ids, lengths, strict=True):
            at = min(size, at + n) if i != self.library.unk_id() else _next_character(normal, at)
            ends.append(at)
        starts = [0, *ends[:-1]]
        raw = text.encode("utf-8", "surrogatepass")
        return ids, [_character_start(raw, align[b]) for b in starts], [_character_start(raw, align[e], after=True) for e in ends]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends of all texts, number of ids of each); the same as ``encode`` on every text.

        Texts whose words are single-spaced are cut into words, and each distinct word is split once.  The rest go
        through ``encode``.
        """
        texts = texts.fill_null("").cast(pa.string())
        n_rows = len(texts)
        odd = np.ones(n_rows, bool)
        if self.plain and n_rows:
            # Doubled, leading or trailing spaces, a space beside a line break, and the escape sign need the whole rule.
            odd = pc.match_substring_regex(texts, f"  | \n|^ | $|\n\n|^\n|\n$|\n |{SPACE}").to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy() == 0)
        simple = texts.filter(pa.array(~odd))
        per_row: list = [None] * n_rows
        if len(simple):
            words = pc.split_pattern(pc.replace_substring(simple, "\n", " \n"), " ")
            coded = words.flatten().dictionary_encode()
            where, word_ends = self.store.spread(self.store.look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)])
            bounds = np.asarray(words.offsets) - words.offsets[0].as_py()
            token_bounds = np.concatenate([[0], word_ends])[bounds]
            ids, size = self.store.ids[where], self.store.more[where]
            size[token_bounds[:-1]] -= 1  # the dummy prefix stands for no byte
            running = np.cumsum(size)
            n_tokens = np.diff(token_bounds)
            stops = running - np.repeat(np.concatenate([[0], running])[token_bounds[:-1]], n_tokens)
            starts = stops - size
            if (broken := self.part_byte[ids]).any():
                raw, text_offsets = flat_text(simple)
                at = np.flatnonzero(broken)
                row = np.searchsorted(token_bounds, at, side="right") - 1
                starts[at], stops[at] = _whole_characters(raw, text_offsets[row], np.diff(text_offsets)[row], starts[at], stops[at])
            starts, stops = starts.astype(np.int32), stops.astype(np.int32)
            if not odd.any():
                return ids, starts, stops, n_tokens
            for k, i in enumerate(np.flatnonzero(~odd)):
                span = slice(token_bounds[k], token_bounds[k + 1])
                per_row[i] = (ids[span], starts[span], stops[span])
        for i in np.flatnonzero(odd):
            per_row[i] = tuple(np.array(x, np.int32) for x in self.encode(texts[int(i)].as_py()))
        if not per_row:
            empty = np.zeros(0, np.int32)
            return empty, empty, empty, np.zeros(0, np.int64)
        joined = [np.concatenate([r[k] for r in per_row]) for k in range(3)]
        return *joined, np.array([len(r[0]) for r in per_row])

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


def _next_character(normal: str, at: int) -> int:
    raw = normal.encode("utf-8", "surrogatepass")
    at += 1
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _character_start(raw: bytes, at: int, after: bool = False) -> int:
    """Byte pieces of one character share its span: its first byte, or the byte behind it."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1 if after else -1
    return at


def _whole_characters(raw: np.ndarray, base: np.ndarray, limit: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans widened to whole characters, relative to each text."""
    begin, stop = begin.copy(), stop.copy()
    for _ in range(3):
        inside = (begin > 0) & (begin < limit)
        inside[inside] = raw[(base + begin)[inside]] & 0xC0 == 0x80
        begin[inside] -= 1
        inside = (stop > 0) & (stop < limit)
        inside[inside] = raw[(base + stop)[inside]] & 0xC0 == 0x80
        stop[inside] += 1
    return begin.astype(np.int32), stop.astype(np.int32)


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids, starts, ends) of every row: a piece covers the text's UTF-8 bytes [start, end)."""
    path, kind = model_path or tokenizer_path(MODEL), dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in rebatched(batches):
            ids, starts, ends, n = pieces.encode_batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids, n), _lists(starts, n), _lists(ends, n)], ["doc_id", "ids", "starts", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


# Words whose pieces a task remembers.
KEPT_WORDS = 50_000
# Ids that are decoded at a time; a longer document stands alone.
DECODE_IDS = 250_000
# Bytes of text of one step that encodes and decodes.
STEP_BYTES = 1 << 20


def _decoded(pieces: Pieces, flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """The texts of consecutive lists of ids, some lists at a time."""
    ends = np.cumsum(n)
    out: list[str] = []
    row = 0
    while row < len(n):
        base = int(ends[row] - n[row])
        stop = max(row + 1, int(np.searchsorted(ends, base + DECODE_IDS, side="right")))
        ids, cuts = flat[base : ends[stop - 1]].tolist(), [0, *(ends[row:stop] - base).tolist()]
        out += pieces.decode([ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        row = stop
    return pa.array(out, pa.string())


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """``encoded`` with the decoded text as column ``decoded``; null ids count as none."""
    path = model_path or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = _decoded(pieces, column.flatten().to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in encoded.dtypes)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def encode_and_decode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids, end_byte, decoded) of every row in one pass, so a task needs one Python worker: ``end_byte`` is where the last piece ends."""
    path, kind = model_path or tokenizer_path(MODEL), dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in rebatched(batches, limit=STEP_BYTES):
            ids, _, ends, n = pieces.encode_batch(batch.column(1))
            last = np.zeros(len(n), np.int64)
            full = n > 0
            last[full] = ends[np.cumsum(n)[full] - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids, n), pa.array(last), _decoded(pieces, ids, n)], ["doc_id", "ids", "end_byte", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, end_byte long, decoded string")


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document: number of ids, where the last piece ends, and digests of the ids and of the decoded text."""
    return encode_and_decode(docs, model_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        "end_byte",
    )
