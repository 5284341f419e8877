"""Densities and whiskers against the plain formulas."""

import numpy as np
import pytest

from firmlens.operators import shapes as sh


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = [(0, float(v), None) for v in rng.normal(10, 2, 300)] + [(1, float(v), 3.0) for v in rng.uniform(1, 20, 200)] + [(2, 7.0, 1.0)] * 4 + [(3, None, None)]
    return spark.createDataFrame(rows, "cluster int, a double, b double")


def test_density_equals_the_kernel_sum(frame):
    got = sh.violin_densities(frame, ["a", "b"]).toPandas()
    values = frame.toPandas()
    for c in (0, 1):
        x = values[values["cluster"] == c]["a"].to_numpy()
        mine = got[(got["cluster"] == c) & (got["feature"] == "a")].sort_values("i")
        width = x.std(ddof=1) * len(x) ** -0.2
        at = np.linspace(x.min(), x.max(), sh.POINTS)
        exact = np.exp(-0.5 * ((at[:, None] - x) / width) ** 2).sum(axis=1) / (len(x) * width * np.sqrt(2 * np.pi))
        assert np.allclose(mine["x"], at) and np.abs(mine["density"] - exact).max() < 1e-3 * exact.max()
    flat = got[(got["cluster"] == 2) & (got["feature"] == "a")]
    assert len(flat) == 1 and flat["density"].isna().all() and flat["x"].iloc[0] == 7.0
    assert not len(got[got["cluster"] == 3]) and not len(got[(got["cluster"] == 0) & (got["feature"] == "b")])


def test_whiskers_equal_the_plain_rule(frame):
    got = sh.box_whiskers(frame, ["a"]).toPandas().set_index("cluster")
    values = frame.toPandas()
    for c in (0, 1, 2):
        x = values[values["cluster"] == c]["a"].to_numpy()
        q25, q75 = np.quantile(x, [0.25, 0.75])
        inside = x[(x >= q25 - 1.5 * (q75 - q25)) & (x <= q75 + 1.5 * (q75 - q25))]
        row = got.loc[c]
        assert np.isclose(row["whisker_low"], min(inside.min(), q25)) and np.isclose(row["whisker_high"], max(inside.max(), q75))
        assert row["beyond"] == len(x) - len(inside) and row["n"] == len(x)
    assert 3 not in got.index


def test_empty_tables_and_partitionings(frame):
    for make in (sh.violin_densities, sh.box_whiskers):
        assert make(frame.limit(0), ["a"]).count() == 0
    one, many = (sorted(map(tuple, sh.violin_densities(frame.repartition(n), ["a"]).dropna().collect())) for n in (1, 7))
    assert np.allclose([r[3:] for r in one], [r[3:] for r in many], rtol=1e-12)
