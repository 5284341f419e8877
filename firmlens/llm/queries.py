"""The queries of the text operators, each with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firmlens.llm import (
    op1_fingerprints, op2_suffix_dedup, op3_language, op4_tokens, op5_toxicity, op6_shards, op7_decontaminate, op8_pieces, op9_near_copies, op10_secrets, op11_url_rules,
    op12_hard_negatives, op13_vector_codes,
)
from firmlens.llm.common import documents, read

N_SHARDS = 8


def op1_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_fingerprints.compare_edits(documents(spark, sf_dir))


def op2_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return op3_language.identify(docs, op3_language.fit(docs))


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_tokens.token_files(documents(spark, sf_dir))


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return op5_toxicity.score(docs, op5_toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = op6_shards.even_tree(N_SHARDS)
    return op6_shards.shard_documents(documents(spark, sf_dir), tree, op6_shards.with_shard(tree))


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_decontaminate.decontaminate(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op8_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pieces.digests(documents(spark, sf_dir))


def op9_circulant_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_near_copies.link(documents(spark, sf_dir), k=2)


def op10_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_secrets.digests(documents(spark, sf_dir))


def op11_rarest_token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_url_rules.judge(read(spark, sf_dir, "pages"))


def op12_anchor_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return op12_hard_negatives.mine(rows, op12_hard_negatives.every_hundredth(), label=op12_hard_negatives.corrected_label())


def op13_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_vector_codes.compress(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash_fingerprints, op2_two_stage_suffixes, op3_ppm_language, op4_wavelet_tokens, op5_compression_toxicity, op6_hash_tree_shards, op7_positional_index,
        op8_offset_pieces, op9_circulant_near_copies, op10_assignment_secrets, op11_rarest_token_rules, op12_anchor_tree_negatives, op13_cover_tree_codes,
    )
}
SQL: dict[str, str] = {
    "op11_rarest_token_rules": op11_url_rules.oracle_sql(),
    "op12_anchor_tree_negatives": op12_hard_negatives.oracle_sql(),
    "op13_cover_tree_codes": op13_vector_codes.oracle_sql(),
}
