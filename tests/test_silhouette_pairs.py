"""The exact silhouette works each distance out once, for both of its rows."""

import numpy as np
import pytest

from firmlens.operators import validate as va


def test_one_block_of_distances_serves_both_sides():
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(500, 5)) * 3, rng.normal(size=(417, 5)) * 3
    widths = [3, 4]
    codes = [np.stack([rng.integers(0, w, n) for w in widths], axis=1) for n in (500, 417)]
    there, back = va._meet(va._distances, x, codes[0], y, widths, codes[1])
    gaps = np.linalg.norm(y[:, None] - x[None], axis=2)
    member = [np.concatenate([np.eye(w)[c[:, i]] for i, w in enumerate(widths)], axis=1) for c in codes]
    np.testing.assert_allclose(there, gaps @ member[0], rtol=1e-12)
    np.testing.assert_allclose(back, gaps.T @ member[1], rtol=1e-12)


def test_a_row_is_at_zero_from_itself():
    x = np.random.default_rng(3).normal(size=(40, 3)) + 1e6  # far from zero, where roundings are large
    codes = np.arange(40)[:, None] % 40
    there, back = va._meet(va._distances, x, codes, x[7:20], [40], same=np.arange(7, 20))
    assert back is None and (there[np.arange(13), np.arange(7, 20)] == 0).all()


def test_every_pair_meets_once_in_any_tiling(blobs_of, monkeypatch):
    df, want = blobs_of
    calls = []
    for rows, bytes_ in ((2_048, 128 << 20), (30, 128 << 20), (2_048, 8 * 5 * 40)):
        monkeypatch.setattr(va, "TILE_ROWS", rows)
        monkeypatch.setattr(va, "TILE_BYTES", bytes_)
        tiles, _ = va._tiling(200, 5, 8)
        calls.append(tiles)
        assert va.silhouette(df, "label").score == pytest.approx(want, abs=1e-12)
    assert calls == [1, 7, 5]  # an odd number, so that tiles in a circle meet in pairs


@pytest.fixture(scope="module")
def blobs_of(spark):
    rng = np.random.default_rng(2)
    x, label = rng.normal(size=(200, 2)), rng.integers(0, 3, 200)
    gaps = np.linalg.norm(x[:, None] - x[None], axis=2)
    n = np.bincount(label)
    means = gaps @ np.eye(3)[label] / n
    a = means[np.arange(200), label] * n[label] / (n[label] - 1)
    means[np.arange(200), label] = np.inf
    b = means.min(axis=1)
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(200)]
    return spark.createDataFrame(rows, "company_id long, features array<double>, label int").repartition(3), ((b - a) / np.maximum(a, b)).mean()
