"""Benchmark decontamination by a positional inverted index, with built-in functions alone.

The index stores a posting (term, document, position) for every word of the
corpus that the test items use, written where it was read; no other word is ever
looked up.  Of every window of ``WIDTH`` words of an item the ``RAREST`` terms are
looked up first, by their frequency in the index; a posting minus the term's
place in the item is the place where the item would start in the document, and
only starts on which the rare lists agree go on.  For those, the lists of all
other terms are intersected in the same way; a window occurs where all its
places are met.  Proximity matches count the rare terms that lie within a few
words of their places.

Results: a null text has no words; items without words or without item_id match
nothing, repeated items count once; documents are told apart by doc_id and text,
so repeated rows get equal answers and a null doc_id one of its own; an empty
table on either side matches nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import checked_broadcast, cut_lineage

WIDTH = 13
RAREST = 3
# Words a rare term may be away from its place in a proximity match, and the share of an item's rare terms it takes.
SLOP, NEAR_SHARE = 4, 0.6
# The separators of the word rule.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(text))


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, terms) of distinct items with words; places count from 0."""
    return items.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("terms")).where(F.size("terms") > 0).distinct().withColumn(
        "item", F.xxhash64(F.col("item_id").cast("string"), "terms")
    )


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, row, pos): postings of the words in ``vocabulary`` (term), stored in the shared folder."""
    postings = docs.select(row_key().alias("row"), F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return cut_lineage(postings.join(checked_broadcast(vocabulary), "term").select("term", "row", "pos"))


def item_windows(items: DataFrame, index: DataFrame, width: int = WIDTH, rarest: int = RAREST) -> DataFrame:
    """(item, item_id, n, windows): of each window its first place, its length and the places of its rarest terms.

    Windows with a term that the corpus does not have are left out.
    """
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    places = items.select("item", "item_id", F.posexplode("terms").alias("pos", "term"))
    ranked = places.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    per_item = ranked.groupBy("item", "item_id").agg(F.sort_array(F.collect_list(F.struct("pos", "df", "term"))).alias("places"))
    n = F.size("places")
    length = F.least(F.lit(width), n)

    def window(start: Column) -> Column:
        part = F.slice("places", start + 1, length)
        rare = F.slice(F.sort_array(F.transform(part, lambda p: F.struct(p["df"].alias("df"), p["pos"].alias("pos")))), 1, rarest)
        return F.struct(start.alias("start"), length.alias("length"), rare["pos"].alias("rare"), rare[0]["df"].alias("least"))

    found = per_item.withColumn("windows", F.transform(F.sequence(F.lit(0), n - length), window))
    found = found.withColumn("windows", F.filter("windows", lambda w: w["least"] > 0)).where(F.size("windows") > 0)
    return found.select("item", "item_id", n.alias("n"), "places", "windows")


def rare_hits(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, item, start, place): offset-adjusted postings of the rare terms."""
    rare = windows.select("item", "places", F.explode(F.array_distinct(F.flatten("windows.rare"))).alias("place"))
    rare = cut_lineage(rare.select("item", "place", F.element_at("places", F.col("place") + 1)["term"].alias("term")))
    return index.join(checked_broadcast(rare), "term").select("row", "item", (F.col("pos") - F.col("place")).alias("start"), "place")


def phrases(index: DataFrame, windows: DataFrame, hits: DataFrame) -> DataFrame:
    """(row, item, item_id, start, found): every occurring window, as first place and length, of an item laid at ``start``."""
    agreed = hits.groupBy("row", "item", "start").agg(F.collect_set("place").alias("got"))
    agreed = agreed.join(checked_broadcast(windows.select("item", "windows")), "item")
    agreed = agreed.where(F.exists("windows", lambda w: F.size(F.array_except(w["rare"], F.col("got"))) == 0))
    candidates = cut_lineage(agreed.select("row", "item", "start"))
    wanted = candidates.join(checked_broadcast(windows.select("item", "places")), "item").select("row", "item", "start", F.explode("places").alias("p"))
    wanted = cut_lineage(wanted.select("row", "item", "start", F.col("p.pos").alias("place"), F.col("p.term").alias("term"), (F.col("start") + F.col("p.pos")).alias("pos")))
    own = index.join(checked_broadcast(candidates.select("row").distinct()), "row", "left_semi")
    met = own.join(checked_broadcast(wanted), ["row", "term", "pos"]).groupBy("row", "item", "start").agg(F.collect_set("place").alias("got"))
    laid = met.join(checked_broadcast(windows.select("item", "item_id", "windows")), "item")

    def occurs(w: Column) -> Column:
        return F.size(F.array_except(F.sequence(w["start"], w["start"] + w["length"] - 1), F.col("got"))) == 0

    laid = laid.withColumn("found", F.transform(F.filter("windows", occurs), lambda w: F.struct(w["start"], w["length"])))
    return laid.where(F.size("found") > 0).select("row", "item", "item_id", "start", "found")


def proximity(windows: DataFrame, hits: DataFrame, slop: int = SLOP, share: float = NEAR_SHARE) -> DataFrame:
    """(row, item_id): documents where at least ``share`` of an item's rare terms lie within ``slop`` words of their places.

    Starts are put into overlapping bins of twice the slop, so terms that agree within it share a bin.
    """
    rare = windows.select("item", "item_id", F.size(F.array_distinct(F.flatten("windows.rare"))).alias("n_rare"))
    bin_ = F.floor(F.col("start") / (2 * slop + 1))
    half = F.floor((F.col("start") + slop) / (2 * slop + 1))
    binned = hits.select("row", "item", "place", F.explode(F.array(F.struct(F.lit(0).alias("side"), bin_.alias("bin")), F.struct(F.lit(1).alias("side"), half.alias("bin")))).alias("b"))
    near = binned.groupBy("row", "item", "b").agg(F.count_distinct("place").alias("n")).join(checked_broadcast(rare), "item")
    return near.where(F.col("n") >= F.greatest(F.lit(2.0), share * F.col("n_rare"))).select("row", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: words, words inside occurring windows, items with one, their digest, the verdict, and items near by."""
    return _judged(docs, items, width).drop("row")


def _judged(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """What ``decontaminate`` returns, and the key of the row."""
    counted = docs.select("doc_id", row_key().alias("row"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    tests = cut_lineage(item_words(items))
    index = build_index(docs, cut_lineage(tests.select(F.explode("terms").alias("term")).distinct()))
    windows = cut_lineage(item_windows(tests, index, width))
    hits = cut_lineage(rare_hits(index, windows))
    exact = cut_lineage(phrases(index, windows, hits))
    # Copies of a row have the same places, and sets drop them.
    places = F.flatten(F.transform("found", lambda w: F.sequence(F.col("start") + w["start"], F.col("start") + w["start"] + w["length"] - 1)))
    per_row = exact.withColumn("hit", F.array_distinct(places)).groupBy("row").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"),
    )
    near = proximity(windows, hits).groupBy("row").agg(F.count("*").alias("n_near"))
    found = cut_lineage(per_row.join(near, "row", "full"))
    joined = counted.join(checked_broadcast(found), "row", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        "row", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows that are not contaminated, with all their columns; rows of one doc_id, or of none, are told apart by their texts."""
    away = cut_lineage(_judged(docs, items, width).where("contaminated").select(F.col("row").alias("__away")).distinct())
    return docs.join(checked_broadcast(away), row_key() == F.col("__away"), "left_anti")
