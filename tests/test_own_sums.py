"""Summed distances to the own cluster, in work that does not grow with the number of clusters."""

import tracemalloc

import numpy as np

from firmlens.operators import separable as sp


def test_own_sums_equal_the_columns_of_all_clusters():
    rng = np.random.default_rng(3)
    codes, values = rng.integers(0, 7, 500), np.sort(np.round(rng.exponential(size=500), 2))
    before = rng.random((4, 9)) * 10
    n, s = sp._running(codes, values, 9)
    every = values[:, None] * (2 * (n + before[0]) - before[2]) + before[3] - 2 * (s + before[1])
    assert (sp._own_sums(codes, values, before) == every[np.arange(500), codes]).all()
    assert len(sp._own_sums(codes[:0], values[:0], before)) == 0


def test_own_sums_need_no_table_of_rows_by_clusters():
    rng = np.random.default_rng(4)
    codes, values = rng.integers(0, 500, 50_000), np.sort(rng.random(50_000))
    tracemalloc.start()
    sp._own_sums(codes, values, np.zeros((4, 500)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6  # one such table has 200 MB
