"""One Lloyd step of several models: stacked models give what each gives alone, and ties go to the first centre."""

import numpy as np

from firmlens.operators import kmeans as km


def alone(x, centres):
    gaps = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    nearest = gaps.argmin(axis=1)
    best = gaps[np.arange(len(x)), nearest]
    member = np.eye(len(centres))[nearest]
    return np.column_stack([member.sum(axis=0), member.T @ best, member.T @ np.sqrt(best), member.T @ x])


def test_stacked_models_give_the_sums_of_each_model_alone():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2_500, 4))  # more than two pieces, the last one short
    models = [(i, 0, rng.normal(size=(k, 4))) for i, k in enumerate([3, 5, 3, 70, 5, 1])]
    stacks = km._stacked(models)
    assert all(len(factors) <= max(km.STACKED, k) for _, k, _, factors in stacks)
    found, lean = km._members(x, stacks, True), km._members(x, stacks, False)
    for number, _, centres in models:
        want = alone(x, centres)
        np.testing.assert_allclose(found[number], want, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(lean[number][:, [0, 3, 4, 5, 6]], want[:, [0, 3, 4, 5, 6]], rtol=1e-9, atol=1e-9)


def test_a_row_between_equal_centres_counts_once():
    x = np.random.default_rng(1).normal(size=(300, 2))
    twice = np.array([[0.0, 0.0], [0.0, 0.0], [9.0, 9.0]])
    other = np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 3.0]])
    found = km._members(x, km._stacked([(0, 0, twice), (1, 0, other)]), True)
    assert found[0][:, 0].tolist() == [300, 0, 0]
    np.testing.assert_allclose(found[1], alone(x, other), rtol=1e-9, atol=1e-9)
