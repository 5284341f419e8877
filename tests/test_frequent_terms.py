"""The most frequent terms are found without counting every bigram of the corpus."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from firmlens.operators import text as tx

TEXTS = ["red fox red fox runs", "red fox sleeps near water", "blue fox, the red fox", "water falls; water runs", None, "", "zebra zebra zebra zebra"] * 3


def plain(max_features):
    uses, texts = Counter(), Counter()
    for t in TEXTS:
        found = [w for w in (t or "").replace(",", "").replace(";", "").split() if w not in tx.ENGLISH]
        terms = found + [f"{a} {b}" for a, b in zip(found, found[1:])]
        uses.update(terms)
        texts.update(set(terms))
    top = sorted(uses, key=lambda w: (-uses[w], w))[:max_features]
    return top, [texts[w] for w in top]


@pytest.mark.parametrize("frequent", [2_000, 4])
@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 100])
def test_the_terms_are_those_of_the_full_count(spark, monkeypatch, n, frequent):
    monkeypatch.setattr(tx, "FREQUENT", frequent)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    model = tx.fit_tfidf(rows, F.col("t"), n)
    top, texts = plain(n)
    assert model.vocabulary == top
    import math

    assert model.weights == pytest.approx([math.log((1 + len(TEXTS)) / (1 + k)) + 1 for k in texts])


def test_only_words_that_can_matter_are_kept(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "__text string")
    assert sorted(tx.frequent_words(rows, 2)) == ["fox", "red", "zebra"]  # the last two are used equally often
    tokens = F.array(*[F.lit(w) for w in ("red", "fox", "runs", "fox", "red")])
    kept = spark.range(1).select(tx.bigrams_among(tokens, ["red", "fox"]).alias("k")).first()["k"]
    assert kept == ["red", "fox", "fox", "red", "red fox", "fox red"]
