"""Hierarchical weighted hash tree: which shard a document lives in.

The tree has regions, racks and shards; a node's weight is the sum of its shards'.
A document descends: every region draws ``-ln(u) / weight``, where ``u`` is a hash of
(doc_id, node) in (0, 1), and the least draw wins, so regions win in proportion to
their weights; then the racks of that region draw, and of the winner's shards
each.  No other node is asked.  A draw depends on its own node alone: a weight that grows
lets only the nodes on its path win more often, so documents move only into subtrees whose
weight grew (or out of those whose weight fell), and a region none of whose weights
changed neither gives to another such region nor moves anything inside.  A shard that must take rows only
into itself is added as a region of its own (``with_shard``).

Results: a null doc_id hashes like the text ``null``; a null text has size 1
and the checksum of no bytes; repeated rows land in the same shard with slots of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import cut_lineage
from firmlens.session import lookup_join

# Shards of a rack and racks of a region in a tree that is laid out by count alone.
RACK_SHARDS = 2
REGION_RACKS = 2
# Documents that one numbering bucket holds on average, and the least number of buckets of a shard.
BUCKET_ROWS = 50_000
LEAST_BUCKETS = 32


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(n_shards: int) -> list[Shard]:
    """Equal weights, racks and regions filled one after the other."""
    return [Shard(s // (RACK_SHARDS * REGION_RACKS), s // RACK_SHARDS, s) for s in range(n_shards)]


def with_shard(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree and one more shard, in a rack and region of its own: no other node's weight changes, so rows move only into it."""
    region, rack, shard = (max(getattr(leaf, level) for leaf in tree) + 1 for level in ("region", "rack", "shard"))
    return [*tree, Shard(region, rack, shard, weight)]


def draw(doc_id: Column, node: str, weight: float) -> Column:
    """Exponential draw of a document at a node, with the node's weight as rate."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(node))), 1, 13), 16, 10)
    uniform = (hashed.cast("double") + 0.5) / float(16**13)
    return -F.log(uniform) / F.lit(float(weight))


def _winner(doc_id: Column, path: str, weights: dict[int, float]) -> Column:
    """The child with the least draw, the smaller number on a tie; an only child needs no draw."""
    drawn = [F.struct(draw(doc_id, f"{path}/{child}", weight), F.lit(child).alias("child")) for child, weight in sorted(weights.items())]
    return F.lit(next(iter(weights))) if len(drawn) == 1 else F.least(*drawn)["child"]


def _among(parent: Column, choices: dict[int, Column]) -> Column:
    """The choice of the parent that won; only that one is worked out."""
    out = None
    for node, choice in sorted(choices.items()):
        out = F.when(parent == node, choice) if out is None else out.when(parent == node, choice)
    return out


def locate(df: DataFrame, tree: list[Shard], into: str, doc_id: str = "doc_id", region: str = "__region", rack: str = "__rack") -> DataFrame:
    """Add the shard of each row as column ``into``, and its region and rack where they are named."""
    weights: dict[int, dict[int, dict[int, float]]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            weights.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[leaf.shard] = leaf.weight
    key = F.col(doc_id)
    df = df.withColumn(region, _winner(key, "", {g: sum(sum(leaves.values()) for leaves in racks.values()) for g, racks in weights.items()}).cast("int"))
    racks = {g: _winner(key, f"/{g}", {k: sum(leaves.values()) for k, leaves in of.items()}) for g, of in weights.items()}
    df = df.withColumn(rack, _among(F.col(region), racks).cast("int"))
    shards = {k: _winner(key, f"/{g}/{k}", leaves) for g, of in weights.items() for k, leaves in of.items()}
    df = df.withColumn(into, _among(F.col(rack), shards).cast("int"))
    return df.drop("__region", "__rack")


def shard_documents(docs: DataFrame, tree: list[Shard], grown: list[Shard], n_buckets: int | None = None) -> DataFrame:
    """One row per document: size, checksum, shard, slot in the shard, shard in the grown tree.

    Slots follow a hash of doc_id.  A shard is numbered in buckets of that hash,
    each after the sum of the buckets before it, so no shard is sorted in one task.
    """
    rows = docs.select("doc_id", "text")
    if n_buckets is None:
        n_buckets = LEAST_BUCKETS + rows.count() // (BUCKET_ROWS * max(1, len(tree)))
    text = F.coalesce(F.col("text"), F.lit(""))
    spread = F.xxhash64(F.col("doc_id"), F.col("text"))
    base = rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        spread.alias("__hash"),
        F.pmod(spread, F.lit(n_buckets)).alias("__bucket"),
    )
    placed = cut_lineage(locate(locate(base, tree, "shard", region="region", rack="rack"), grown, "grown_shard"))
    counts = placed.groupBy("shard", "__bucket").agg(F.count("*").alias("n"))
    # One row for about BUCKET_ROWS documents, so a shard's buckets are few enough for one running sum.
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(counts.select("shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")))
    order = Window.partitionBy("shard", "__bucket").orderBy("__hash", "doc_id")
    numbered = placed.withColumn("__n", F.row_number().over(order) - 1)
    return lookup_join(numbered, starts, ["shard", "__bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__start") + F.col("__n")).cast("long").alias("slot"), "grown_shard", "region", "rack"
    )
