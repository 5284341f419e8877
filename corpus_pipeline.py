"""The corpus pipeline: toxic documents go, one of each group of near copies stays, contaminated documents go, secrets are
masked, and the rest becomes token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each result to the
shared folder and reads it again.  All but the last return the columns of ``documents``; the last returns doc_id, the ids,
how many there are, and the text that decoding them gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm import op5_toxicity, op7_decontaminate, op8_pieces, op9_near_copies, op10_secrets
from firmlens.llm.common import cut_lineage, documents, read

# The near-copy rule of the corpus: shingles of five words, a likeness of 0.8 or more.
SHINGLE_WORDS, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_toxicity.reject(docs, op5_toxicity.fit(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_near_copies.deduplicate(docs, SHINGLE_WORDS, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_secrets.redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_pieces.encode_and_decode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("pieces", pieces),
]
# Models, sketches and a tokenizer stand in the stages: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
