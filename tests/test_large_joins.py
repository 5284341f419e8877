"""Tables that grow with the rows never pass whole through the driver, and blocks in many dimensions are compared exactly."""

import numpy as np
from pyspark.sql import functions as F

from firmlens.operators import density as ds
from firmlens.session import cut_lineage, grown_join, lookup_join
from firmlens.sources.company import company_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_lookup_from_small_files_is_not_broadcast(spark):
    rows = cut_lineage(spark.range(5000).select(F.col("id"), (F.col("id") % 2000).alias("k")))
    lookup = cut_lineage(spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")))
    joined = lookup_join(rows, lookup, ["k"], max_broadcast_rows=1000)
    assert "BroadcastHashJoin" not in plan(joined)
    assert joined.count() == 5000 and joined.where("v <> 3 * k OR v IS NULL").isEmpty()
    both = grown_join(rows, lookup, "k", "left")
    assert "BroadcastHashJoin" not in plan(both)
    assert both.count() == 5000 and both.where("v <> 3 * k OR v IS NULL").isEmpty()


def test_company_table_broadcasts_nations_and_regions_only(spark):
    text = plan(company_table(spark, "/root/testdata/sf0.001"))
    assert text.count("BroadcastHashJoin") == 2


def columnwise(x, y, eps):
    gaps = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        gaps += (x[:, j][:, None] - y[:, j][None]) ** 2
    return gaps <= eps * eps


def test_blocks_in_many_dimensions_compared_as_column_by_column():
    rng = np.random.default_rng(7)
    for offset in (0.0, 1e6):
        x = np.round(rng.normal(size=(300, 16)), 1) + offset
        y = np.concatenate([x[:200], np.round(rng.normal(size=(200, 16)), 1) + offset])
        # Distances that occur, so that many pairs lie exactly on the limit or one rounding beside it.
        for pair in range(5):
            eps = float(np.sqrt(((x[pair] - y[pair + 50]) ** 2).sum()))
            assert (ds._near(x, y, eps) == columnwise(x, y, eps)).all()
    huge = np.full((2, 16), 1e200)
    assert ds._near(huge, huge, 1.0).all()


def test_blocks_in_many_dimensions_by_matrix_products():
    import time

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2048, 64)), rng.normal(size=(2048, 64))
    took = []
    for way in (ds._near, columnwise):
        start = time.perf_counter()
        way(x, y, 0.8)
        took.append(time.perf_counter() - start)
    assert took[0] < took[1] / 2
