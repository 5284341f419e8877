"""What op2 sends to its sorting buckets."""

import zstandard
from pyspark.sql import functions as F

from firmlens.llm import op2_suffix_dedup as op2


def test_stretches_travel_compressed_and_are_sorted_as_they_were(spark, monkeypatch):
    sent = []
    plain = op2.marked
    monkeypatch.setattr(op2, "marked", lambda rows, width: (sent.append(rows), plain(rows, width))[1])
    passage = "".join(f"a passage with the number {k} in it; " for k in range(60))
    docs = spark.createDataFrame([(i, f"start {i} {passage} end {i * 7}") for i in range(8)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in op2.remove_repeats(docs, with_text=True).collect()}
    assert found[0]["n_removed"] == 0
    assert all(len(passage) <= found[i]["n_removed"] <= len(passage) + 12 for i in range(1, 8))
    assert all(bytes(found[i]["kept"]).decode().startswith(f"start {i}") for i in range(8))
    rows = sent[0].select("content", F.expr("aggregate(lengths, 0, (a, x) -> a + x)").alias("n")).collect()
    held = [zstandard.ZstdDecompressor().decompress(bytes(r["content"])) for r in rows]
    assert [len(h) for h in held] == [r["n"] for r in rows]
    assert any(r["n"] for r in rows)
