"""Fingerprints, repeated passages, contamination, near copies, components and the pipeline."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from firmlens.llm import common, op1_fingerprints, op2_suffix_dedup, op7_decontaminate, op9_near_copies, queries
from firmlens.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bits(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


# --- fingerprints


def check_fingerprints(got, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by_id = {r.doc_id: r for r in got}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + (after[1] or "")[:quarter]
        r = by_id[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == 1 - bits(r.fingerprint, by_id[after[0]].fingerprint) / 64
        assert r.near_edited == 1 - bits(r.fingerprint, r.edited_fingerprint) / 64


def test_fingerprints_and_search(spark, small_docs, small_dir):
    got = queries.op1_simhash_fingerprints(spark, small_dir).collect()
    check_fingerprints(got, [(r.doc_id, r.text) for r in small_docs.collect()])
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    same = defaultdict(set)
    for r in got:
        same[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())
    for r in got:
        want = sum(bits(r.fingerprint, x.fingerprint) <= op1_fingerprints.RADIUS for x in got) if r.doc_id % 100 == 0 else None
        assert r.n_within == want
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.9


def test_fingerprint_is_the_weighted_vote(spark):
    texts = ["one two two three", "x", "", "A b a B a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r.fingerprint for r in op1_fingerprints.fingerprints(df, ["i"]).collect()}
    for i, text in enumerate(texts):
        w = text.lower().split()
        pairs = Counter(zip(w, [*w[1:], None], strict=False))
        votes = np.zeros(64)
        if pairs:
            hashed = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a string, b string, n int").selectExpr("xxhash64(a, b) h", "n").collect()
            for h, n in hashed:
                votes += n * np.array([1 if (h >> k) & 1 else -1 for k in range(64)])
        assert got[i] & (1 << 64) - 1 == sum(1 << k for k in range(64) if votes[k] > 0)


def test_search_finds_every_pair_in_the_radius(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 30)]
    near = base + [b ^ int(sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False))) for b in base]
    frame = spark.createDataFrame([(x,) for x in set(near)], "fingerprint long")
    got = {(r.query, r.match): r.distance for r in op1_fingerprints.search(frame, frame).collect()}
    m = (1 << 64) - 1
    want = {(a, b): bin((a ^ b) & m).count("1") for a in set(near) for b in set(near) if bin((a ^ b) & m).count("1") <= 3}
    assert got == want and op1_fingerprints.search(frame, frame).count() == len(want)


def test_fingerprints_odd_rows(odd_docs, no_docs, odd_rows):
    got = op1_fingerprints.compare_edits(odd_docs).collect()
    assert len(got) == 15
    check_fingerprints(got, list({r[:2] for r in odd_rows}))
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert op1_fingerprints.compare_edits(no_docs).count() == 0


# --- repeated passages


def brute_repeats(rows, width=50):
    best, texts = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        if i is not None:
            for k in range(len(b) - width + 1):
                w = b[k : k + width]
                best[w] = min(best.get(w, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for k in range(len(b) - width + 1):
                if best[b[k : k + width]] < i:
                    gone[k : k + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_of_the_small_table(spark, small_docs, small_dir):
    want = brute_repeats([(r.doc_id, r.text) for r in small_docs.collect()])
    assert sorted(map(tuple, queries.op2_two_stage_suffixes(spark, small_dir).collect()), key=repr) == want
    # Every document in a step of its own, several buckets, and every shared minimizer dealt anew.
    alone = small_docs.repartition(40)
    assert sorted(map(tuple, op2_suffix_dedup.remove_repeats(alone, frequent=2).collect()), key=repr) == want


def test_repeats_over_many_buckets(small_docs, monkeypatch):
    want = brute_repeats([(r.doc_id, r.text) for r in small_docs.collect()], 30)
    monkeypatch.setattr(op2_suffix_dedup, "REPORT_BYTES", 60_000)
    monkeypatch.setattr(op2_suffix_dedup, "SORT_BYTES", 30_000)
    assert sorted(map(tuple, op2_suffix_dedup.remove_repeats(small_docs.repartition(20), width=30).collect()), key=repr) == want


def test_repeats_odd_rows(spark, odd_docs, no_docs, odd_rows):
    got = op2_suffix_dedup.remove_repeats(odd_docs, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_repeats([r[:2] for r in odd_rows])
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert op2_suffix_dedup.remove_repeats(no_docs).count() == 0
    loops = [(1, "ab" * 200), (2, "a" * 300 + "b" * 60), (3, "b" * 70 + "ab" * 100), (4, "é" * 40), (5, "x" + "é" * 30), (6, "a" * 49)]
    docs = spark.createDataFrame(loops, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, op2_suffix_dedup.remove_repeats(docs).collect()), key=repr) == brute_repeats(loops)


def test_suffix_order_by_induction():
    rng = np.random.default_rng(4)
    for _ in range(40):
        parts = [bytes(rng.choice([1, 2, 2, 3], rng.integers(0, 50)).astype(np.uint8)) for _ in range(6)]
        text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        order, raw = op2_suffix_dedup.suffix_order(text, 16), text.tobytes()
        keys = [raw[i : i + 16].ljust(16, b"\0") for i in order]
        assert sorted(order) == list(range(len(text))) and keys == sorted(keys)


# --- contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(rows, items, width=13):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(UP))
        if i is not None and w:
            for k in range(max(1, len(w) - width + 1)):
                windows[tuple(w[k : k + width])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, ids = WORD.findall((t or "").translate(UP)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    ids |= found
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination_of_the_small_table(spark, small_docs, small_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute_contamination([(r.doc_id, r.text) for r in small_docs.collect()], items)
    got = queries.op7_positional_index(spark, small_dir).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want and any(r[2] for r in want)


def test_contamination_odd_rows(spark, odd_docs, no_docs, odd_rows):
    items = [
        (1, "twice over"), (2, "A PASSAGE of well over fifty bytes that two of the documents share, word for word."), (3, None), (4, "..."), (None, "one"), (10, "one"),
        (10, "one"), (11, "the long word list goes on the long word list goes on the long"), (12, "日本語のテキスト"), (13, "a word the corpus lacks: xylophones"),
    ]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = op7_decontaminate.decontaminate(odd_docs, frame).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == brute_contamination([r[:2] for r in odd_rows], items)
    kept = op7_decontaminate.clean(odd_docs, frame)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in got if not r.contaminated)
    assert op7_decontaminate.decontaminate(no_docs, frame).count() == 0
    none = op7_decontaminate.decontaminate(odd_docs, frame.limit(0)).collect()
    assert len(none) == 15 and not any(r.n_hit or r.contaminated for r in none)


def test_proximity_allows_small_shifts(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    shifted = text.replace("delta", "delta extra words").replace("kappa", "kappa more")
    docs = spark.createDataFrame([(1, shifted), (2, "alpha and a lot of other words " * 5 + "nu")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    rows = {r.doc_id: r for r in op7_decontaminate.decontaminate(docs, items).collect()}
    assert (rows[1].n_hit, rows[1].n_near, rows[2].n_near) == (0, 1, 0)


# --- near copies


def brute_copies(rows, k, percent=80):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for x, s in enumerate(sets):
        if rows[x][0] is not None:
            for g in s:
                holders[g].append(x)
    for x, s in enumerate(sets):
        for y, n in Counter(y for g in s for y in holders[g] if y < x and rows[x][0] is not None).items():
            if 100 * n >= percent * (len(s) + len(sets[y]) - n):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = i if i is None else min(i, least.get(find(x), i))
    return sorted(((i, len(sets[x]), least[find(x)], i is None or least[find(x)] == i) for x, (i, _) in enumerate(rows)), key=repr)


def test_near_copies_of_the_small_table(spark, small_docs, small_dir):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert sorted(map(tuple, queries.op9_circulant_near_copies(spark, small_dir).collect()), key=repr) == brute_copies(rows, 2)


def test_near_copies_chains_and_hubs(spark):
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(120)]
    rows = [(1000 + i, " ".join(base)) for i in range(30)]
    for i in range(120):
        words = list(base)
        for j in rng.choice(120, rng.integers(1, 12), replace=False):
            words[j] = f"x{i}_{j}"
        rows.append((int(rng.integers(0, 900)) * 2 + i * 2000, " ".join(words)))
    drift = list(base[:60])
    for i in range(20):
        drift[(3 * i) % 60] = f"d{i}"
        rows.append((500_000 - i, " ".join(drift)))
    rows = list({r[0]: r for r in rows}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for k in (2, 5):
        assert sorted(map(tuple, op9_near_copies.link(docs, k).collect()), key=repr) == brute_copies(rows, k)


def test_near_copies_odd_rows(odd_docs, no_docs, odd_rows):
    got = op9_near_copies.link(odd_docs, 2).collect()
    assert sorted(map(tuple, got), key=repr) == brute_copies([r[:2] for r in odd_rows], 2)
    kept = op9_near_copies.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and None in ids and {1, 2, 3} <= set(ids)
    assert op9_near_copies.link(no_docs, 2).count() == 0 and op9_near_copies.deduplicate(no_docs).count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, int(x)) for x in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (80, 2))]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- pipeline


def test_pipeline_stages(spark, odd_docs):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = common.documents(spark, folder)
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.cut_lineage(stage(spark, docs, folder))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        rows, own = {r.doc_id: r for r in before.collect()}, set(ids)
        if name == "near_dedup":
            groups = {r[0]: r for r in brute_copies([(i, r.text) for i, r in rows.items()], 5)}
            assert own == {i for i, r in groups.items() if r[3]}
        elif name == "decontamination":
            items = [tuple(r) for r in common.read(spark, folder, "benchmark").select("item_id", "text").collect()]
            assert own == {r[0] for r in brute_contamination([(i, r.text) for i, r in rows.items()], items) if not r[5]}
        elif name in ("secret_scan", "pieces"):
            assert own == rows.keys()
        if name != "pieces":
            assert docs.columns == columns
        else:
            assert all(rows[r.doc_id].text == r.text and r.n_tokens == len(r.ids) for r in docs.collect())
        seen = own
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd_docs, folder).count() <= 15
        assert stage(spark, odd_docs.limit(0), folder).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries() and "pipeline" in entry.queries()


def test_clean_rows_stay_beside_contaminated_ones(spark):
    bad, good = " ".join(f"quiz{chr(97 + i)}" for i in range(20)), "a clean text of a few words"
    docs = spark.createDataFrame([(None, bad), (None, good), (None, None), (7, bad), (7, good), (8, good)], "doc_id long, text string")
    kept = op7_decontaminate.clean(docs, spark.createDataFrame([(1, bad)], "item_id long, text string")).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, [(None, good), (None, None), (7, good), (8, good)]))


def test_low_bits_of_short_signatures_are_not_repeated():
    signature = np.random.default_rng(0).integers(0, 1 << 32, (128, 5), np.uint32)
    bits = np.unpackbits(op9_near_copies.low_bits(signature).view(np.uint8), axis=1)
    assert (bits[:, :128] == (signature & 1).T).all() and not bits[:, 128:].any()
    # Five deviations of the bits there are.
    assert op9_near_copies.most_differing(80, 128) == int(12.8 + 5 * (12.8 * 0.9) ** 0.5) + 1
    assert op9_near_copies.most_differing(80, 1024) == op9_near_copies.most_differing(80) == 86
