"""URL rules, hard negatives and vector codes."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from firmlens.llm import op11_url_rules, op12_hard_negatives, op13_vector_codes, queries
from firmlens.llm.op11_url_rules import METHOD_RULES, SITE_RULES, Rule

CHECKED = sorted(queries.SQL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_gives_the_rows_of_its_sql(spark, small_dir, name):
    got = queries.QUERIES[name](spark, small_dir)
    db = duckdb.connect()
    for table in ("pages", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{table}.parquet'")
    wanted = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))
    assert wanted


# --- URL rules


def brute_place(url):
    if not url or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def brute_rule(rules, host, path):
    def glob(pattern):
        return "(?s:.*)".join(map(re.escape, pattern.split("*")))

    fit = [r for r in rules if (not r.host or re.search(rf"(?:^|\.){glob(r.host)}\Z", host)) and re.match(glob(r.path), path)]
    return min(fit, key=lambda r: (-len(r.name), r.name), default=None)


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://A.Net/", "http://net", "http://net/", "http://xnet/", "http://x.net/en/", "http://example.net/en", "http://example.net/en/1",
    "http://a.b.example.net/en/?q", "http://notexample.net/en/", "https://example.com/de/x#y", "https://example.com/DE/x", "u://x.org/fr/", "u://org/fr/?a://b.net/", "x://y://z.net/",
    "http://cheap-pills.shop.de/x", "http://cheappills.de/", "http://spam-farm.example.net/en/", "http://h.net/\n/two", "http://ünet/", "http://ü.net/é", "//://net/?", "http://net:80/", "http://a@net/",
    "http://" + "a." * 5000 + "net/" + "b/" * 5000,
]


def test_url_rules_odd_rows(spark):
    rows = [(i if i != 3 else None, u, *(["x"] * 8)) for i, u in enumerate(URLS + URLS[-5:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, token string, rules string, verdict string, list string, html string")
    got = op11_url_rules.judge(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.page_id is None or (r.host, r.path) == brute_place(rows[r.page_id][1])
        rule, own = brute_rule(SITE_RULES, r.host, r.path), brute_rule(METHOD_RULES, r.host, r.path)
        assert r.rule == (rule.name if rule else None) and r.method_rule == (own.name if own else None)
        assert r.verdict == (rule.verdict if rule else own.verdict if own else "allow")
    assert op11_url_rules.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in op11_url_rules.judge(pages, (), (), "block").collect()} == {"block"}


def test_many_rules_with_and_without_tokens(spark):
    words = ["aa", "bb", "cc", "d", "x1"]
    rng = np.random.default_rng(3)
    word = lambda: str(rng.choice(words))
    shapes = ["{}.{}", "*{}.{}", "{}*", "", "*.{}", "{}-{}.*"]
    paths = ["", "/", "/{}", "/{}/", "/*/{}/", "/{}*{}/", "*"]
    rules = list({(h, p): Rule(h, p, str(rng.choice(["block", "allow"]))) for h, p in ((str(rng.choice(shapes)).format(word(), word()), str(rng.choice(paths)).format(word(), word())) for _ in range(150)) if h + p}.values())
    urls = [f"s://{'.'.join(word() for _ in range(rng.integers(1, 4)))}{rng.choice(['', '-'])}{word()}.{word()}/{'/'.join(word() for _ in range(rng.integers(0, 4)))}{rng.choice(['', '/'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in op11_url_rules.judge(pages, rules, ()).collect():
        best = brute_rule(rules, *brute_place(urls[r.page_id]))
        assert (r.rule, r.verdict) == ((best.name, best.verdict) if best else (None, "allow")), urls[r.page_id]


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(1, "s://a.net/"), (2, "s://b.net/"), (3, "s://a.org/q/")], "page_id long, url string")
    places = op11_url_rules.with_place(pages)
    rules = op11_url_rules.rule_table(spark, given=[Rule("a.net", "/", "block"), Rule("b.net", "/q/", "block"), Rule("*", "/q", "block"), Rule("NEW.net", "/", "block")])
    filed = {r.rule: r.token for r in op11_url_rules.index_by_rarest(rules, places).collect()}
    # b and q are held by one place each: the smaller token.
    assert filed == {"a.net/": "h:a", "b.net/q/": "h:b", "*/q": op11_url_rules.EVERYWHERE, "new.net/": "h:new"}


# --- vectors

VECTOR_ROWS = "vec_id long, embedding array<float>, label int, id string, v string, g string, rank string, code string, error string, of string, n string"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *([None] * 8)) for r in rows], VECTOR_ROWS).repartition(parts)


def brute_negatives(rows):
    kept = {i: ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
            for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    width = max((len(v) for _, v in kept.values()), default=0)
    kept = {i: (label, np.array(v + [0] * (width - len(v)))) for i, (label, v) in kept.items()}
    out = set()
    for a in (i for i in kept if i % 100 == 0):
        scores = {i: int(kept[a][1] @ kept[i][1]) for i in kept if i != a}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if kept[i][0] == kept[a][0]][:5]:
            window = [i for i in order if kept[i][0] != kept[a][0] and 30 * scores[p] <= 100 * scores[i] <= 90 * scores[p]]
            out |= {(a, p, k + 1, i, scores[p], scores[i]) for k, i in enumerate(window[:10])}
    return out


def odd_vectors(seed=5, n=700):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in (centres[i % 12] + 0.1 * rng.normal(size=8)).astype(np.float32)], int(i % 12 % 4)) for i in range(n)]
    rows = [(i, [0.5, -0.25] * 4, label) if i % 3 == 0 else (i, v, label) for i, v, label in rows]  # a third of all rows is one vector
    return rows + [
        (n, None, 1), (n + 1, [1.0, None] * 4, 1), (n + 2, [float("nan")] * 8, 1), (n + 3, [float("inf")] + [0.0] * 7, 1), (n + 4, [0.0] * 8, None), (n + 5, [], 2), (n + 6, [1.0, 2.0, 3.0], 2),
        (n + 7, [-1e-9] * 8, 3), (None, None, None),
    ]


@pytest.mark.parametrize("group", [2, 512])
def test_hard_negatives_are_those_of_all_scores(spark, group):
    rows = odd_vectors()
    got = op12_hard_negatives.mine(vectors(spark, rows), op12_hard_negatives.every_hundredth(), label=op12_hard_negatives.corrected_label(), group_anchors=group)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_negatives(rows)


def test_hard_negatives_of_few_rows(spark):
    def mined(rows):
        return op12_hard_negatives.mine(vectors(spark, rows, 1), op12_hard_negatives.every_hundredth(), label=op12_hard_negatives.corrected_label()).collect()

    assert mined([]) == [] and mined([(100, [1.0], 1)]) == []
    assert mined([(100, [1.0], 1), (101, [1.0], 1), (102, [1.0], 2)]) == []
    twice = [(100, [1.0], 1), (101, [1.0], 1), (101, [1.0], 1), (102, [0.5], 2), (102, [0.5], 2)]
    assert [tuple(r) for r in mined(twice)] == [(100, 101, 1, 102, 65536, 32768)]
    with pytest.raises(Exception, match="beyond"):
        mined([(100, [1e30], 1), (101, [1.0], 1)])


def test_tree_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    anchors = rng.integers(-300, 300, (60, 6)).astype(float)
    order, parent, edge = op12_hard_negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(60)) and sum(parent < 0) == 1
    gaps = np.sqrt(((anchors[:, None] - anchors[None]) ** 2).sum(axis=2))
    # The weight of a minimum spanning tree, by Kruskal's rule.
    group, total = list(range(60)), 0.0
    for i, j in sorted(((i, j) for i in range(60) for j in range(i)), key=lambda e: gaps[e]):
        if group[i] != group[j]:
            old, total = group[j], total + gaps[i, j]
            group = [group[i] if g == old else g for g in group]
    assert edge.sum() == pytest.approx(total)
    block = op12_hard_negatives.Block(np.arange(500), np.zeros(500, int), rng.integers(-300, 300, (500, 6)).astype(float))
    group = op12_hard_negatives.Group(np.arange(60), np.zeros(60, int), anchors)
    rescored = 0
    for a, rows, scores in group.walk(block, lambda a: (50_000, 90_000)):
        exact = block.points @ anchors[a]
        assert set(np.flatnonzero((exact >= 50_000) & (exact <= 90_000))) <= set(rows) and (exact[rows] == scores).all()
        rescored += len(rows)
    assert rescored < 60 * 500


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(1, max((len(v) for _, v, _ in kept), default=0)) // parts) * parts
    x = np.zeros((len(kept), width), np.int64)
    for k, (_, v, _) in enumerate(kept):
        x[k, : len(v)] = np.floor(1024 * np.float32(v).astype(float))
    x = x.reshape(len(kept), parts, -1)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    book = x[order].transpose(1, 0, 2).copy()

    def nearest():
        return np.stack([((x[:, p, None] - book[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(parts)], axis=1)

    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            for e in set(codes[:, p]):
                book[p, e] = x[codes[:, p] == e, p].sum(axis=0) // (codes[:, p] == e).sum()
    codes = nearest()
    error = [int(sum(((x[k, p] - book[p, codes[k, p]]) ** 2).sum() for p in range(parts))) for k in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(map(str, book.reshape(-1))).encode()).hexdigest()
    return sorted(str((i, "".join(f"{c:02x}" for c in codes[k]), error[k], by_label[label], sha)) for k, (i, _, label) in enumerate(kept))


@pytest.mark.parametrize("rows", [odd_vectors(), odd_vectors(8, 40), odd_vectors()[:1], [(1, [0.5], None), (1, [0.5], None), (None, [0.25, 0.5], 3)]], ids=["many", "few", "one", "repeated"])
def test_vector_codes_are_those_of_plain_rounds(spark, rows, monkeypatch):
    monkeypatch.setattr(op13_vector_codes, "TREE_ROWS", 100)
    got = op13_vector_codes.compress(vectors(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_codes(rows)


def test_vector_codes_of_no_rows(spark):
    got = op13_vector_codes.compress(vectors(spark, []))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("seed", range(4))
def test_cover_tree_invariants(seed):
    rng = np.random.default_rng(seed)
    points = np.unique(rng.integers(-40 * 8**seed, 40 * 8**seed, (300, 1 + seed)), axis=0)
    copies = rng.integers(1, 9, len(points))
    parent, level = op13_vector_codes._nets(points)
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    child = np.flatnonzero(parent >= 0)
    assert len(child) == len(points) - 1 and (level[parent[child]] > level[child]).all()
    assert (gaps[child, parent[child]] <= 2.0 ** (level[child] + 1)).all()
    for at in set(level):
        net = np.flatnonzero(level >= at)
        assert len(net) == 1 or gaps[np.ix_(net, net)][~np.eye(len(net), dtype=bool)].min() >= 2.0**at
    tree, place = op13_vector_codes.CoverTree.over(points, copies)
    assert (tree.points[place] == points).all() and (tree.copies[place] == copies).all()
    entries = points[rng.integers(0, len(points), 20)].astype(float)
    entries[7] = entries[3]
    nearest = op13_vector_codes.squared(points.astype(float), entries).argmin(axis=1)
    assert (tree.codes(entries)[place] == nearest).all()
    counts, sums = tree.sums(entries)
    assert (counts == np.bincount(nearest, copies, 20)).all()
    assert (sums == np.stack([(points[nearest == e] * copies[nearest == e][:, None]).sum(axis=0) for e in range(20)])).all()
    tight = op13_vector_codes.CoverTree.over(np.concatenate([points // 50 + 10_000, points // 50 - 10_000])[:1], np.ones(1, int))[0]
    assert len(tight.assign(entries)[0]) == 1


def test_clear_subtrees_are_not_opened():
    rng = np.random.default_rng(2)
    far = np.array([[0, 0], [50_000, 0], [0, 50_000]])
    points = np.unique(np.concatenate([c + rng.integers(-50, 50, (200, 2)) for c in far]), axis=0)
    tree, _ = op13_vector_codes.CoverTree.over(points, np.ones(len(points), int))
    starts, ends, chosen = tree.assign(far.astype(float))
    assert len(starts) < 20 and (ends - starts).sum() == len(points) and set(chosen) == {0, 1, 2}
