"""Removal of repeated 50-byte passages by suffix sorting.

Every run of ``WIDTH`` bytes of a text (a window) has a minimizer, the least hash
of its short grams; equal windows have equal minimizers.  The work is dealt by
minimizers:

1. a step (some megabytes of documents) reports its distinct minimizers, each with the number
   of its documents that have it, in one packed list per bucket; the task of a bucket adds up and answers,
   flag by flag, which occur in several documents, and which in very many.  A minimizer
   that every document has thus costs one entry per step, and the step itself deals the flags out to its documents;
2. each document cuts the stretches of windows that share a reported minimizer
   (for a very frequent one, also a second minimizer of another order) and sends
   them to the bucket of that minimizer, equal stretches of a step once;
3. each bucket builds a suffix array of its distinct stretches in two stages:
   only suffixes smaller than their successors are sorted, the rest are induced
   by scanning the buckets of first bytes; common prefixes of neighbours of at
   least ``WIDTH`` bytes make groups of equal windows, and in each group every
   window but those of the smallest doc_id marks its bytes;
4. each document drops the bytes that a marked window covers.

A document whose whole text a smaller doc_id has loses all of it and takes no
part in this, so a group of copies costs its texts' digests only.

Results: a null text is empty; matches never cross documents; repeated rows and
rows of one doc_id never remove from one another; a null doc_id neither loses
bytes nor takes any; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import byte_buckets, checked_broadcast, cut_lineage, flat_text, rebatched, text_bytes
from firmlens.llm.words import BYTE_VALUES, mix64

WIDTH = 50
# Bytes of the grams whose least hash is a window's minimizer.
GRAM = 16
# Text bytes for a bucket of minimizers, and for a bucket of stretches.
REPORT_BYTES = 24 << 20
SORT_BYTES = 6 << 20
# From so many documents on, a minimizer's windows are dealt by a second one too.
FREQUENT = 20_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def minimizers(data: np.ndarray, offsets: np.ndarray, width: int, order: int = 0) -> np.ndarray:
    """For each byte the least gram hash of the window that starts there; _NONE where the text ends before the window does."""
    n = len(data)
    out = np.full(n, _NONE)
    if n < width:
        return out
    hashes, span = BYTE_VALUES[data], 1
    base = 0x9E3779B97F4A7C15
    while span < GRAM:
        hashes = hashes[: len(hashes) - span] * np.uint64(base) + hashes[span:]
        base, span = base * base & (1 << 64) - 1, span * 2
    hashes = mix64(hashes ^ np.uint64(order * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(1)
    grams, have = width - GRAM + 1, 1
    while have < grams:
        step = min(have, grams - have)
        hashes = np.minimum(hashes[: len(hashes) - step], hashes[step:])
        have += step
    out[: len(hashes)] = hashes
    for k in range(1, width):
        ends = offsets[1:] - k
        ends = ends[(ends >= 0) & (ends >= offsets[:-1])]
        out[ends] = _NONE
    return out


def _report(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, value) of each document's distinct minimizers, in order."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    change = np.ones(len(values), bool)
    change[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    change &= values != _NONE
    owner, values = owner[change], values[change]
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], values[new]


def _buckets_of(values: np.ndarray, n: int) -> np.ndarray:
    return (values % np.uint64(n)).astype(np.int64)


def _split_rows(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, start, stop) of the runs of equal sorted keys."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate([[0], cuts])
    return list(zip(keys[starts].tolist(), starts.tolist(), [*cuts.tolist(), len(keys)], strict=True))


_SHARED, _HOT = 1, 2


def reports(rows: DataFrame, width: int, n_buckets: int) -> DataFrame:
    """What each step has: for every bucket (``bucket``, ``tags``, ``times``) the 32-bit tags of its distinct minimizers and in how many of its
    documents each is; and one row without a bucket that says which of them each document has (``docs``, ``names``, ``counts``, ``which``).

    Minimizers stand in the order of bucket and value.  A step is named by a digest of its documents, so a task that runs again names it alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            ids, names = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            step = hashlib.blake2b(ids.tobytes() + names.tobytes(), digest_size=16).digest()
            data, offsets = flat_text(batch.column(1))
            owner, values = _report(minimizers(data, offsets, width), np.diff(offsets))
            distinct, which, times = np.unique(values, return_inverse=True, return_counts=True)
            bucket = _buckets_of(distinct, n_buckets)
            order = np.lexsort((distinct, bucket))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            tags, times, bucket = (distinct[order] // np.uint64(n_buckets)).astype("<u4"), times[order].astype("<u4"), bucket[order]
            # A document's own minimizers in the same order.
            which = place[which]
            which = which[np.lexsort((which, owner))].astype("<i4")
            out = [(step, key, tags[a:b].tobytes(), times[a:b].tobytes(), None, None, None, None) for key, a, b in _split_rows(bucket)]
            out.append((step, None, None, None, ids, names, np.bincount(owner, minlength=len(ids)).astype(np.int32), which.tobytes()))
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["step", "bucket", "tags", "times", "docs", "names", "counts", "which"])

    schema = "step binary, bucket int, tags binary, times binary, docs array<long>, names array<long>, counts array<int>, which binary"
    return rows.select("doc_id", "text", "name").mapInArrow(run, schema)


def answers(reported: DataFrame, frequent: int) -> DataFrame:
    """(step, bucket, flags): a byte for every tag of the step's report, whether several or very many documents have it."""

    def run(table: pa.Table) -> pa.Table:
        tags = [np.frombuffer(t, "<u4") for t in table.column("tags").to_pylist()]
        sizes = [len(t) for t in tags]
        _, which = np.unique(np.concatenate(tags), return_inverse=True)
        times = np.concatenate([np.frombuffer(t, "<u4") for t in table.column("times").to_pylist()])
        docs = np.bincount(which, weights=times)[which]
        flags = np.where(docs >= frequent, _SHARED | _HOT, np.where(docs > 1, _SHARED, 0)).astype(np.uint8)
        parts = [f.tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]
        return pa.table({"step": table.column("step"), "bucket": table.column("bucket"), "flags": pa.array(parts, pa.binary())})

    return reported.groupBy("bucket").applyInArrow(run, "step binary, bucket int, flags binary")


def flags_of_documents(reported: DataFrame, answered: DataFrame) -> DataFrame:
    """(doc_id, name, flags) of the documents with a shared minimizer: a byte for each of its minimizers, in the order of bucket and value."""
    # One row per step and bucket; steps that are equal, from repeated rows, have equal answers.
    by_step = answered.groupBy("step").agg(F.sort_array(F.collect_set(F.struct("bucket", "flags")))["flags"].alias("parts"))
    own = reported.where("bucket IS NULL").select("step", "docs", "names", "counts", "which")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, names, counts = (np.asarray(batch.column(c)[i].values, np.int64) for c in ("docs", "names", "counts"))
                which = np.frombuffer(batch.column("which")[i].as_buffer(), "<i4")
                flags = np.frombuffer(b"".join(batch.column("parts")[i].as_py()), np.uint8)[which]
                ends = np.cumsum(counts)
                total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
                rows = np.flatnonzero(total[ends] > total[ends - counts])
                parts = [flags[ends[r] - counts[r] : ends[r]].tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(docs[rows]), pa.array(names[rows]), pa.array(parts, pa.binary())], ["doc_id", "name", "flags"])

    found = own.join(by_step, "step").mapInArrow(run, "doc_id long, name long, flags binary")
    return found.dropDuplicates(["doc_id", "name"])


def stretches(answered: DataFrame, width: int, n_reports: int, n_sorts: int) -> DataFrame:
    """(bucket, docs, starts, lengths, content) of windows with shared minimizers, and in ``done_*`` what the step settled itself.

    Of equal stretches in a step only those of the smallest doc_id are sent; the others are covered as a whole.  What is sent
    is compressed here, as the shuffle's own compression leaves half as much again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in rebatched(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = flat_text(batch.column(1))
            values = minimizers(data, offsets, width)
            lengths_of = np.diff(offsets)
            named_owner, named = _report(values, lengths_of)
            flags = np.empty(len(named), np.uint8)
            flags[np.lexsort((named, _buckets_of(named, n_reports), named_owner))] = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8)
            shared, hot = flags & _SHARED > 0, flags & _HOT > 0
            # Runs of windows of one document with one minimizer, and each run's place among the document's minimizers.
            edge = np.ones(len(data), bool)
            edge[1:] = values[1:] != values[:-1]
            edge[offsets[:-1][lengths_of > 0]] = True
            starts = np.flatnonzero(edge)
            stops = np.append(starts[1:], len(data))
            real = values[starts] != _NONE
            starts, stops = starts[real], stops[real]
            owner, run_values = np.searchsorted(offsets, starts, side="right") - 1, values[starts]
            order = np.lexsort((run_values, owner))
            new = np.ones(len(order), bool)
            new[1:] = (run_values[order][1:] != run_values[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new) - 1
            keep, again = shared[place], shared[place] & hot[place]
            keys = run_values
            if again.any():
                # A very frequent minimizer's windows are cut by their second one.
                second = minimizers(data, offsets, width, order=1)
                at = np.concatenate([np.arange(a, b) for a, b in zip(starts[again], stops[again], strict=True)])
                change = np.ones(len(at), bool)
                change[1:] = (second[at[1:]] != second[at[:-1]]) | (at[1:] != at[:-1] + 1) | np.isin(at[1:], starts)
                cut = at[change]
                until = np.append(at[:-1][change[1:]], at[-1]) + 1
                parent = np.searchsorted(starts, cut, side="right") - 1
                starts, stops = np.concatenate([starts[~again], cut]), np.concatenate([stops[~again], until])
                owner = np.concatenate([owner[~again], owner[parent]])
                keys = np.concatenate([keys[~again], mix64(run_values[parent] ^ mix64(second[cut]))])
                keep = np.concatenate([keep[~again], np.ones(len(cut), bool)])
            starts, lengths, key, docs = starts[keep], (stops - starts)[keep] + width - 1, keys[keep], owner[keep]
            raw = data.tobytes()
            best: dict[bytes, int] = {}
            content = [raw[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            doc_ids = ids[docs]
            for k in np.argsort(doc_ids, kind="stable").tolist():
                best.setdefault(content[k], k)
            leader = np.fromiter((best[c] for c in content), np.int64, len(content))
            settled = doc_ids[leader] < doc_ids
            sent = ~settled
            inside = starts - offsets[docs]
            bucket = _buckets_of(key >> np.uint64(7), n_sorts)
            rows: list[list] = [[] for _ in range(8)]
            order = np.argsort(bucket, kind="stable")
            for b, lo, hi in _split_rows(bucket[order]):
                group = order[lo:hi]
                own, done = group[sent[group]], group[settled[group]]
                items = (b, doc_ids[own], inside[own], lengths[own], packer.compress(b"".join(content[k] for k in own.tolist())), doc_ids[done], inside[done], inside[done] + lengths[done])
                for column, item in zip(rows, items, strict=True):
                    column.append(item)
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["bucket", "docs", "starts", "lengths", "content", "done_docs", "done_starts", "done_ends"])

    schema = "bucket int, docs array<long>, starts array<int>, lengths array<int>, content binary, done_docs array<long>, done_starts array<int>, done_ends array<int>"
    return answered.select("doc_id", "text", "flags").mapInArrow(run, schema)


def _word_at_each(text: np.ndarray, room: int) -> np.ndarray:
    """Eight bytes from each place on as one big-endian number, for ``room`` places behind the end as well, where zeros follow."""
    words = np.zeros(len(text) + room + 8, np.uint64)
    words[: len(text)] = text
    for span in (1, 2, 4):
        words = (words[:-span] << np.uint64(8 * span)) | words[span:]
    return words


def _tied(edges: np.ndarray) -> np.ndarray:
    """Places of sorted rows that equal a neighbour, if ``edges`` says which rows differ from the one before."""
    same = ~edges
    same[:-1] |= ~edges[1:]
    return np.flatnonzero(same)


def suffix_order(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes at least, in two stages.

    ``text`` has bytes of 1 and more, and zeros that end its parts, the last place among them.
    ``words`` are its ``_word_at_each`` with ``depth`` places behind the end, where a caller has them.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # Smaller than the successor: by the first byte that differs from the next one.
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    next_change = np.flatnonzero(differs)
    up = np.ones(len(next_change), bool)
    up[:-1] = text[next_change[:-1]] < text[next_change[:-1] + 1]
    rises = np.repeat(up, np.diff(next_change, prepend=-1)) | (text == 0)
    words = _word_at_each(text, depth) if words is None else words
    # Stage one: sort these directly, eight bytes at a time, ties only.
    small = np.flatnonzero(rises)
    key = words[small]
    order = np.argsort(key, kind="stable")
    small, key = small[order], key[order]
    edges = np.ones(len(small), bool)
    edges[1:] = key[1:] != key[:-1]
    tied = _tied(edges)
    group = np.cumsum(edges)[tied]
    for shift in range(8, depth + 8, 8):
        if not len(tied):
            break
        # A place behind the room that the words have is behind the text as well.
        members = small[tied]
        key = words[np.minimum(members + shift, len(words) - 1)]
        order = np.lexsort((key, group))
        small[tied], key = members[order], key[order]
        edges = np.ones(len(tied), bool)
        edges[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        still = _tied(edges)
        tied, group = tied[still], np.cumsum(edges)[still]
    # Stage two: scan the buckets of first bytes from the least; each suffix leads its predecessor, if that is larger,
    # to the next free place of its bucket.
    first = text[small]
    bounds = np.searchsorted(first, np.arange(257))
    # First bytes of the larger suffixes, 0 for all others; the last place is one of those, so it may stand before the first.
    larger_first = np.where(rises, 0, text).astype(text.dtype)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        batch = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        waiting[byte] = []
        runs = [batch]
        while len(batch):
            # Inside a run of one byte a suffix leads one of the same bucket.
            batch = batch - 1
            batch = np.compress(larger_first[batch] == byte, batch)
            runs.append(batch)
        bucket = np.concatenate([*runs, small[bounds[byte] : bounds[byte + 1]]])
        out.append(bucket)
        led = bucket - 1
        to = larger_first[led]
        ahead = to > byte
        led, to = np.compress(ahead, led), np.compress(ahead, to)
        if len(led):
            order = np.argsort(to, kind="stable")
            led, to = led[order], to[order]
            for target, a, b in _split_rows(to):
                waiting[target].append(led[a:b])
    return np.concatenate(out)


def covered_windows(parts: list[bytes], owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, place) of every window of ``width`` bytes that a part of a smaller owner has too."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    # Zeros stand between the parts; UTF-8 text has no byte of 255, so one more fits.
    text = np.frombuffer(b"\0".join(p.translate(_UP) for p in parts) + b"\0", np.uint8)
    ends = np.cumsum(lengths + 1)
    words = _word_at_each(text, width)
    order = suffix_order(text, width, words)
    part = np.repeat(np.arange(len(parts)), lengths + 1)
    whole = np.repeat(ends, lengths + 1) - np.arange(len(text)) > width
    order = np.compress(whole[order], order)
    same = np.ones(max(0, len(order) - 1), bool)
    left, right = order[:-1], order[1:]
    for shift in [*range(0, width - 7, 8), width - 8]:
        alive = np.flatnonzero(same)
        same[alive] = words[left[alive] + shift] == words[right[alive] + shift]
    starts = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    who = owners[part[order]]
    least = np.repeat(np.minimum.reduceat(who, starts), np.diff(np.append(starts, len(order)))) if len(order) else who
    hit = order[who > least]
    return part[hit], hit - (ends - lengths - 1)[part[hit]]


_UP = bytes([*range(1, 256), 255])


def _packed(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """One row per document: its ranges, merged."""
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    out: list[list] = [[], [], []]
    for doc, a, b in _split_rows(docs):
        s, e = starts[a:b], np.maximum.accumulate(ends[a:b])
        new = np.concatenate([[True], s[1:] > e[:-1]])
        out[0].append(doc)
        out[1].append(s[new])
        out[2].append(np.append(e[:-1][new[1:]], e[-1]))
    return pa.table({"doc_id": pa.array(out[0], pa.int64()), "starts": pa.array(out[1], pa.list_(pa.int32())), "ends": pa.array(out[2], pa.list_(pa.int32()))})


def marked(sent: DataFrame, width: int) -> DataFrame:
    """(doc_id, starts, ends): byte ranges of repeated windows, by the suffix array of each bucket."""

    def run(table: pa.Table) -> pa.Table:
        def column(name: str, kind) -> np.ndarray:
            return np.concatenate([np.asarray(c.flatten()) for c in table.column(name).chunks] or [np.zeros(0)]).astype(kind)

        docs, starts, lengths = column("docs", np.int64), column("starts", np.int64), column("lengths", np.int64)
        unpacker = zstandard.ZstdDecompressor()
        raw = b"".join(unpacker.decompress(c) for c in table.column("content").to_pylist())
        ends = np.cumsum(lengths)
        content = [raw[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        best: dict[bytes, int] = {}
        for k in np.argsort(docs, kind="stable").tolist():
            best.setdefault(content[k], k)
        leader = np.fromiter((best[c] for c in content), np.int64, len(content))
        whole = docs[leader] < docs
        own = np.fromiter(best.values(), np.int64, len(best))
        part, place = covered_windows([content[k] for k in own.tolist()], docs[own], width)
        # A covered window of a stretch is one for every document of the smallest owner that has it.
        equal = np.flatnonzero((leader != np.arange(len(content))) & ~whole)
        by_part = np.argsort(part, kind="stable")
        part, place = part[by_part], place[by_part]
        number = np.full(len(content), -1)
        number[own] = np.arange(len(own))
        their = number[leader[equal]]
        first, n = np.searchsorted(part, their), np.searchsorted(part, their + 1) - np.searchsorted(part, their)
        again = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        rows = np.concatenate([own[part], np.repeat(equal, n)])
        place = np.concatenate([place, place[again]])
        return _packed(
            np.concatenate([docs[whole], docs[rows], column("done_docs", np.int64)]),
            np.concatenate([starts[whole], starts[rows] + place, column("done_starts", np.int64)]),
            np.concatenate([starts[whole] + lengths[whole], starts[rows] + place + width, column("done_ends", np.int64)]),
        )

    return sent.groupBy("bucket").applyInArrow(run, "doc_id long, starts array<int>, ends array<int>")


def _drop(joined: DataFrame, with_text: bool) -> DataFrame:
    """Texts without their marked bytes."""
    kind = dict(joined.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            data, offsets = flat_text(batch.column(1))
            ranges = batch.column(2).to_pylist()
            removed = np.zeros(len(data) + 1, np.int32)
            for i, found in enumerate(ranges):
                for r in found or ():
                    for s, e in zip(r["starts"], r["ends"], strict=True):
                        removed[offsets[i] + s] += 1
                        removed[offsets[i] + e] -= 1
            gone = np.cumsum(removed[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[offsets[:-1][np.diff(offsets) > 0]] = gone[offsets[:-1][np.diff(offsets) > 0]]
            lost, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
            kept = data[~gone].tobytes()
            at = offsets - lost[offsets]
            pieces = [kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(lost[offsets])), pa.array(np.diff(spans[offsets])), pa.array([hashlib.sha256(p).hexdigest() for p in pieces])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(pieces, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return joined.select("doc_id", "text", "ranges").mapInArrow(run, schema)


def copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n) of the documents, of at least ``width`` bytes, whose whole text a smaller doc_id has; texts are told apart by SHA-256."""
    keys = docs.select("doc_id", F.sha2("text", 256).alias("name"), F.octet_length("text").alias("n")).where(F.col("n") >= width)
    firsts = keys.groupBy("name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # Only names of texts that occur twice are joined.
    return keys.join(checked_broadcast(cut_lineage(firsts)), "name").where("doc_id > first").groupBy("doc_id").agg(F.max("n").alias("n"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, frequent: int = FREQUENT, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row."""
    rows = docs.select("doc_id", "text")
    n_reports = byte_buckets(rows, text_bytes(), REPORT_BYTES)
    n_sorts = byte_buckets(rows, text_bytes(), SORT_BYTES, least=4)
    named = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    # A copy of a whole text loses it, and gives others nothing that the first one does not: copies stay out of the sorting.
    whole = cut_lineage(copies(named, width))
    several = named.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    whole = cut_lineage(whole.join(several, "doc_id", "left_anti"))
    first = named.join(checked_broadcast(whole.select("doc_id")), "doc_id", "left_anti")
    first = first.withColumn("name", F.xxhash64("text"))
    reported = cut_lineage(reports(first, width, n_reports))
    answered = answers(reported.where("bucket IS NOT NULL").select("step", "bucket", "tags", "times"), frequent)
    flags = cut_lineage(flags_of_documents(reported, answered))
    # Ids are narrow and may be sent to every task; the flags go by a join that only the texts in question take part in.
    asked = first.join(checked_broadcast(flags.select("doc_id")), "doc_id", "left_semi").join(flags.hint("merge"), ["doc_id", "name"])
    found = marked(stretches(asked, width, n_reports, n_sorts), width)
    ranges = found.groupBy("doc_id").agg(F.collect_list(F.struct("starts", "ends")).alias("ranges"))
    zero = F.array(F.struct(F.array(F.lit(0)).alias("starts"), F.array(F.col("n").cast("int")).alias("ends")))
    ranges = cut_lineage(ranges.unionByName(whole.select("doc_id", zero.alias("ranges"))))
    ids = checked_broadcast(ranges.select("doc_id").distinct())
    touched = rows.join(ids, "doc_id", "left_semi").join(ranges.hint("merge"), "doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    untouched = rows.join(ids, "doc_id", "left_anti").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(text, 256).alias("kept_sha256"), *([text.cast("binary").alias("kept")] if with_text else []),
    )
    return untouched.unionByName(_drop(touched, with_text))
