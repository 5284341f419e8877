"""SimHash fingerprints and their search, with built-in functions alone.

A term is a pair of neighbouring words (lower case, between white space; the last
word also stands alone), its weight how often it occurs.  Each term's 64-bit hash
votes with its weight for the bits it has set and against the others; a
fingerprint bit is set if more than half of the weight is for it.  Votes of two
bits are counted in one long, 32 bits apart, so 32 sums make a fingerprint.

The search cuts fingerprints into ``BLOCKS`` blocks.  Two fingerprints that differ
in at most ``RADIUS`` bits agree in at least ``BLOCKS - RADIUS`` whole blocks, so a
table for every choice of so many blocks, keyed by their bits, has each pair in
at least one; a pair counts in the first table that has it.

Results: a null text is empty; a text without words has fingerprint 0; equal
texts have equal fingerprints; repeated rows are one document of the order and
each gets its row; rows of one doc_id are ordered by text hash, a null doc_id
comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import cut_lineage, running_starts

BITS = 64
BLOCKS, RADIUS = 5, 3


def terms(text: Column) -> Column:
    """Pairs of neighbouring words, the last with nothing."""
    words = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    return F.arrays_zip(words.alias("w"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("n"))


def _votes(hashed: Column) -> list[Column]:
    return [F.sum(F.shiftright(hashed, i).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"v{i}") for i in range(BITS // 2)]


def _bits() -> Column:
    """The fingerprint of the vote sums; the low half of a sum is bit i, the high half bit i + 32."""
    out = F.lit(0).cast("long")
    for i in range(BITS // 2):
        sums = F.col(f"v{i}")
        low, high = sums.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(sums, 32)
        out = out.bitwiseOR(F.when(low * 2 > F.col("weight"), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        top = 1 << (i + 32) if i < 31 else -(1 << 63)
        out = out.bitwiseOR(F.when(high * 2 > F.col("weight"), F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., fingerprint as long) of every key of ``texts``; texts of one key vote together."""
    pairs = texts.select(*key, F.explode_outer(terms(F.col(text))).alias("t"))
    hashed = F.xxhash64("t.w", "t.n")
    counted = pairs.select(*key, F.when(F.col("t").isNotNull(), hashed).alias("term_hash"), F.when(F.col("t").isNotNull(), 1).otherwise(0).cast("long").alias("one"))
    votes = counted.groupBy(*key).agg(F.sum("one").alias("weight"), *_votes(F.coalesce("term_hash", F.lit(0))))
    return votes.select(*key, _bits().alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _masks(blocks: int, radius: int) -> list[int]:
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in range(cuts[k], cuts[k + 1])) for k in range(blocks)]
    masks = [sum(parts[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(frame: DataFrame, masks: list[int], name: str) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)]))
    return frame.withColumn("key", rows).select(*frame.columns, F.col("key.t").alias("table"), F.col("key.bits").alias("bits"))


def search(queries: DataFrame, stored: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, match, distance): all stored fingerprints within ``radius`` bits of each query; both sides distinct longs."""
    masks = _masks(blocks, radius)
    q = _keyed(queries.select(F.col("fingerprint").alias("query")), masks, "query")
    s = _keyed(stored.select(F.col("fingerprint").alias("match")), masks, "match")
    differ = F.col("query").bitwiseXOR(F.col("match"))
    first = F.least(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, k).otherwise(len(masks)) for k, m in enumerate(masks)])
    near = (q["table"] == s["table"]) & (q["bits"] == s["bits"]) & (F.bit_count(differ) <= radius) & (first == q["table"])
    return q.join(s, near).select("query", "match", F.bit_count(differ).alias("distance"))


def in_order(docs: DataFrame) -> DataFrame:
    """(k, h, doc_id, n, copies, place, ...) of distinct documents in ascending doc_id, each with its neighbours' keys and lengths.

    Only ids and lengths are sorted: ranges are numbered in themselves and start after the sum of those before.
    """
    keys = docs.groupBy("k", "h", "doc_id", "n").agg(F.count("*").alias("copies"))
    sorted_ids = keys.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    numbered = cut_lineage(sorted_ids.withColumn("mark", F.monotonically_increasing_id()))
    part = F.shiftright("mark", 33)
    starts = running_starts(numbered.groupBy(part.alias("part")).agg(F.count("*").alias("rows")), "part", "rows")
    # One row per range.
    placed = numbered.withColumn("part", part).join(F.broadcast(starts), "part")
    placed = cut_lineage(placed.select("k", "h", "doc_id", "n", "copies", (F.col("start") + F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))).alias("place")))
    total = placed.count()
    ahead = placed.select(F.col("k").alias("prev_k"), F.col("h").alias("prev_h"), F.col("n").alias("prev_n"), F.pmod(F.col("place") + 1, F.lit(max(1, total))).alias("place"))
    behind = placed.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.pmod(F.col("place") - 1, F.lit(max(1, total))).alias("place"))
    return placed.join(ahead, "place").join(behind, "place")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Per row: length, digest of the edited text, both fingerprints, and likeness to the edited and to the next text; for
    documents whose id is divisible by 100 also ``n_within``, how many documents have a fingerprint within the radius."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"), F.length(text).cast("long").alias("n"))
    rows = rows.withColumn("k", F.xxhash64("doc_id", "h", F.lit(1)))
    order = cut_lineage(in_order(rows.drop("text")))
    mine = rows.select("k", "h", "text").join(order.select("k", "h", "n", "prev_k", "prev_h", "prev_n"), ["k", "h"])
    lent = mine.select(F.col("prev_k").alias("k"), F.col("prev_h").alias("h"), F.expr("substring(text, 1, int(floor(prev_n / 4)))").alias("lent"))
    lent = lent.groupBy("k", "h").agg(F.max("lent").alias("lent"))
    edited = mine.join(lent, ["k", "h"]).select(
        "k", "h", "text", F.expr("concat(substring(text, 1, int(n - floor(n / 4))), lent)").alias("edited")
    )
    both = edited.select("k", "h", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("x"))
    prints = fingerprints(both.select("k", "h", "x.side", "x.text"), ["k", "h", "side"])
    prints = prints.groupBy("k", "h").agg(F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("efp"))
    digests = edited.groupBy("k", "h").agg(F.max(F.sha2("edited", 256)).alias("edited_sha256"))
    found = cut_lineage(prints.join(digests, ["k", "h"]).join(order.select("k", "h", "doc_id", "n", "copies", "next_k", "next_h"), ["k", "h"]))
    following = found.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("fp").alias("next_fp"))
    per_print = cut_lineage(found.groupBy(F.col("fp").alias("fingerprint")).agg(F.sum("copies").alias("documents")))
    asked = found.where(F.col("doc_id") % 100 == 0).select("k", "h", F.col("fp").alias("query"))
    near = search(asked.select(F.col("query").alias("fingerprint")).distinct(), per_print)
    near = near.join(per_print.select(F.col("fingerprint").alias("match"), "documents"), "match").groupBy("query").agg(F.sum("documents").alias("n_within"))
    answered = asked.join(near, "query").select("k", "h", "n_within")
    out = found.join(following, ["next_k", "next_h"]).join(answered, ["k", "h"], "left")
    # A document of several equal rows gets as many.
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within",
    )
