"""TF-IDF features of the description columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.stopwords import ENGLISH
from firmlens.session import spread_out

# Words of at least two letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"
# Words that may be as frequent as the last term wanted; with more of them every term is counted.
FREQUENT = 2_000


def words(text: Column) -> Column:
    """Lower-cased words without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*ENGLISH))


def with_bigrams(tokens: Column) -> Column:
    """The words followed by their bigrams."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.concat(tokens, pairs)


def bigrams_among(tokens: Column, known: list[str]) -> Column:
    """The same terms, but only those all of whose words are in ``known``; other words still part their neighbours."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n),
        lambda a, b: F.when(a.isin(*known) & b.isin(*known), F.concat_ws(" ", a, b))
    )
    return F.concat(F.filter(tokens, lambda w: w.isin(*known)), F.array_compact(pairs))


def term_column(df: DataFrame, text: Column, out: str = "terms", known: list[str] | None = None) -> DataFrame:
    tokens = F.col("__words")
    terms = with_bigrams(tokens) if known is None else bigrams_among(tokens, known)
    return df.withColumn("__words", words(text)).withColumn(out, terms).drop("__words")


@dataclass(frozen=True)
class TfIdf:
    """Vocabulary in descending corpus frequency, with its weights."""

    vocabulary: list[str]
    weights: list[float]

    def transform(self, df: DataFrame, text: Column, out: str = "tfidf") -> DataFrame:
        """Adds a sparse, L2-normalised vector."""
        model = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="__terms", outputCol="__tf")
        known = sorted({w for term in self.vocabulary for w in term.split(" ")})
        counted = model.transform(term_column(spread_out(df), text, "__terms", known))
        weighted = ElementwiseProduct(
            scalingVec=Vectors.dense(self.weights), inputCol="__tf", outputCol="__weighted"
        ).transform(counted)
        return Normalizer(p=2.0, inputCol="__weighted", outputCol=out).transform(weighted).drop(
            "__terms", "__tf", "__weighted"
        )

    def explode(self, df: DataFrame, key: str, vector: str = "tfidf") -> DataFrame:
        """Rows (key, term, weight) for the non-zero entries."""
        names = F.array(*[F.lit(t) for t in self.vocabulary])
        return (
            df.select(key, F.posexplode(vector_to_array(F.col(vector))).alias("i", "weight"))
            .where(F.col("weight") > 0)
            .select(key, F.get(names, F.col("i")).alias("term"), "weight")
        )


def frequent_words(texts: DataFrame, max_features: int) -> list[str] | None:
    """Words used at least as often as the last of the ``max_features`` most used ones; None if there are fewer or very many.

    A bigram is used at most as often as either of its words, so no other word can be in one of the most frequent terms.
    """
    uses = texts.select(F.explode(words(F.col("__text"))).alias("w")).groupBy("w").agg(F.count("*").alias("uses"))
    limit = max(FREQUENT, max_features)
    top = uses.orderBy(F.desc("uses"), "w").limit(limit + 1).collect()
    if len(top) < max_features:
        return None
    least = top[max_features - 1]["uses"]
    if len(top) > limit and top[-1]["uses"] >= least:
        return None
    return [r["w"] for r in top if r["uses"] >= least]


def fit_tfidf(df: DataFrame, text: Column, max_features: int = 100) -> TfIdf:
    """The most frequent terms (ties: alphabetical) with weight ln((1+N)/(1+df)) + 1."""
    texts = spread_out(df.select(text.alias("__text")))
    rows = term_column(texts, F.col("__text"), known=frequent_words(texts, max_features))

    def entry(term: Column, uses: int, texts: int) -> Column:
        return F.struct(term.alias("term"), F.lit(uses).alias("uses"), F.lit(texts).alias("texts"))

    # Uses, texts and the number of all texts (under the empty term) from one pass over the words.
    entries = F.concat(
        F.transform("terms", lambda t: entry(t, 1, 0)), F.transform(F.array_distinct("terms"), lambda t: entry(t, 0, 1)),
        F.array(entry(F.lit(""), 0, 1)))
    counts = rows.select(F.explode(F.coalesce(entries, F.array(entry(F.lit(""), 0, 1)))).alias("e")).groupBy("e.term").agg(
        F.sum("e.uses").alias("uses"), F.sum("e.texts").alias("texts"))
    top = counts.orderBy(F.desc(F.col("term") == ""), F.desc("uses"), "term").limit(max_features + 1).collect()
    if len(top) < 2:
        raise ValueError("no terms in the text columns")
    n = top[0]["texts"]
    return TfIdf([r["term"] for r in top[1:]], [math.log((1 + n) / (1 + r["texts"])) + 1 for r in top[1:]])
