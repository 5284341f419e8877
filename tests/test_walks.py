"""Rows whose reach takes in every leaf of a large tree are led down in pieces of bounded memory."""

import tracemalloc

import numpy as np

from firmlens.operators.splits import SplitTree


def test_a_wide_reach_in_many_dimensions_takes_bounded_memory():
    rng = np.random.default_rng(0)
    sample = rng.normal(size=(1_000, 64))
    tree = SplitTree.over(sample, 1_000, leaf_rows=4)
    assert tree.leaves > 200
    x = rng.normal(size=(2_000, 64))
    tracemalloc.start()
    rows, leaf = tree.within(x, np.full(len(x), 1e3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == len(x) * tree.leaves
    assert np.bincount(rows).min() == tree.leaves and np.bincount(leaf).min() == len(x)
    assert peak < 150 << 20


def test_pieces_find_the_same_leaves(monkeypatch):
    from firmlens.operators import splits

    rng = np.random.default_rng(1)
    tree = SplitTree.over(rng.normal(size=(500, 3)), 500, leaf_rows=10)
    x, reach = rng.normal(size=(300, 3)), rng.uniform(0, 1, 300)
    whole = set(zip(*(a.tolist() for a in tree._walk(x, reach))))
    monkeypatch.setattr(splits, "WALK_BYTES", 1)
    assert set(zip(*(a.tolist() for a in tree.within(x, reach)))) == whole
    assert [len(a) for a in tree.within(x[:0], reach[:0])] == [0, 0]
