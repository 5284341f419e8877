"""Medoids from several seeds share their scans and give what each seed gives alone; a range's sums are bounded in bytes."""

import numpy as np
import pytest

from firmlens.operators import consensus as cs
from firmlens.operators import separable as sp


def test_all_seeds_at_once_give_what_each_gives_alone(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=2).round(2)] + [float(rng.integers(1, 4))]) for i in range(300)]
    data = spark.createDataFrame(rows, "company_id long, features array<double>").repartition(3).persist()
    weights = np.array([0.2, 0.3])
    joint = cs.kmedoids_by_seed(data, weights, [3], [42, 43])
    calls = []
    former = cs._best_members
    monkeypatch.setattr(cs, "_best_members", lambda *a: calls.append(len(a[1])) or former(*a))
    for seed in (42, 43):
        medoids, cost = cs.kmedoids_gower(data, weights, [3], seed=seed)[3]
        assert np.array_equal(joint[3, seed][0], medoids)
        assert joint[3, seed][1] == pytest.approx(cost, abs=1e-9)
    alone = len(calls)
    calls.clear()
    cs.kmedoids_by_seed(data, weights, [3], [42, 43])
    assert max(calls) == 2 and len(calls) < alone


def test_ranges_are_bounded_by_the_bytes_of_their_sums():
    assert sp._ranges(400_000, 6) == 2
    for width in (6, 104, 1_000):
        partitions = sp._ranges(10_800_000, width)
        assert 10_800_000 / partitions * width * 8 <= sp.RANGE_BYTES * 1.01


def test_sums_over_many_ranges_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sp, "RANGE_BYTES", 8 * 5 * 20)
    rng = np.random.default_rng(5)
    x, codes = rng.integers(0, 9, size=(120, 2)).astype(float), np.stack([rng.integers(0, 2, 120), rng.integers(0, 3, 120)], axis=1)
    base = spark.createDataFrame([(i, x[i].tolist(), codes[i].tolist()) for i in range(120)], "id long, x array<double>, codes array<int>")
    sizes = [np.bincount(codes[:, 0], minlength=2).astype(float), np.bincount(codes[:, 1], minlength=3).astype(float)]
    weights = np.array([0.5, 0.25])
    gaps = (np.abs(x[:, None] - x[None]) * weights).sum(axis=2) / 2
    want = np.concatenate([gaps @ np.eye(2)[codes[:, 0]], gaps @ np.eye(3)[codes[:, 1]]], axis=1)
    got = {r["id"]: r["sums"] for r in sp.cluster_sums(base, weights, sizes).collect()}
    np.testing.assert_allclose(np.array([got[i] for i in range(120)]), want, rtol=1e-9, atol=1e-9)
    own = {r["id"]: r["sums"] for r in sp.cluster_sums(base, weights, sizes, own=True).collect()}
    at = np.stack([codes[:, 0], 2 + codes[:, 1]], axis=1)
    np.testing.assert_allclose(np.array([own[i] for i in range(120)]), np.take_along_axis(want, at, axis=1), rtol=1e-9, atol=1e-9)
