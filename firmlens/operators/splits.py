"""Space-splitting trees: where points live, and which leaves lie within reach of them.

A tree cuts the widest axis at the median until a leaf holds about ``leaf_rows``
rows.  The cuts come from a bounded sample; every row is then led down the tree,
so the sample only decides how even the leaves are.  A row is copied to another leaf
only if that leaf's box is within its own reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF_ROWS = 1_024
# Rows that the cuts are taken from, for each leaf and at most.
SAMPLE_PER_LEAF, MAX_SAMPLE = 48, 200_000
# Distances to cuts, one per row, node and dimension, that are held while rows are led to the leaves within their reach.
WALK_BYTES = 16 << 20


@dataclass(frozen=True)
class SplitTree:
    axis: np.ndarray  # per node; -1 is a leaf
    cut: np.ndarray  # left is below the cut, right from it on
    child: np.ndarray  # (nodes x 2)
    leaf: np.ndarray  # number of each leaf, in space order

    @property
    def leaves(self) -> int:
        return int((self.axis < 0).sum())

    @classmethod
    def over(cls, sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS) -> SplitTree:
        axis, cut, child, leaf = [], [], [], []
        numbers = iter(range(len(sample) + 1))

        def grow(points: np.ndarray) -> int:
            at = len(axis)
            axis.append(-1), cut.append(0.0), child.append([-1, -1]), leaf.append(-1)
            spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
            if len(points) < 2 or rows * len(points) / len(sample) <= leaf_rows or not spread.max() > 0:
                leaf[at] = next(numbers)
                return at
            a = int(spread.argmax())
            values = points[:, a]
            middle = np.median(values)
            # Of tied values all go right; a cut at the least value would leave nothing on the left.
            middle = middle if (values < middle).any() else values[values > values.min()].min()
            axis[at], cut[at] = a, float(middle)
            child[at] = [grow(points[values < middle]), grow(points[values >= middle])]
            return at

        grow(np.asarray(sample, float))
        return cls(np.array(axis), np.array(cut), np.array(child), np.array(leaf))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf of each point, its distance to the nearest cut around the leaf)."""
        node, margin, rows = np.zeros(len(x), int), np.full(len(x), np.inf), np.arange(len(x))
        while len(rows):
            inner = self.axis[node[rows]] >= 0
            rows = rows[inner]
            n = node[rows]
            gap = x[rows, self.axis[n]] - self.cut[n]
            margin[rows] = np.minimum(margin[rows], np.abs(gap))
            node[rows] = self.child[n, (gap >= 0).astype(int)]
        return self.leaf[node], margin

    def within(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose box is within each point's reach, its own leaf included.

        A row may reach every leaf, so as many rows are led down at once as fit ``WALK_BYTES`` even then.
        """
        step = max(1, WALK_BYTES // (8 * max(1, x.shape[1]) * self.leaves))
        found = [(lo, self._walk(x[lo:lo + step], reach[lo:lo + step])) for lo in range(0, len(x), step)]
        none = np.zeros(0, int)
        return np.concatenate([none, *[lo + rows for lo, (rows, _) in found]]), np.concatenate([none, *[leaf for _, (_, leaf) in found]])

    def _walk(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        limit = (reach * (1 + 1e-9) + 1e-12) ** 2
        rows, node = np.arange(len(x)), np.zeros(len(x), int)
        off = np.zeros(x.shape)
        found = [], []
        while len(rows):
            at_leaf = self.axis[node] < 0
            found[0].append(rows[at_leaf])
            found[1].append(self.leaf[node[at_leaf]])
            rows, node, off = rows[~at_leaf], node[~at_leaf], off[~at_leaf]
            axis = self.axis[node]
            gap = x[rows, axis] - self.cut[node]
            near = (gap >= 0).astype(int)
            # On the other side of the cut the point is at least the gap away on this axis.
            far = off.copy()
            far[np.arange(len(rows)), axis] = np.maximum(far[np.arange(len(rows)), axis], np.abs(gap))
            reached = (far**2).sum(axis=1) <= limit[rows]
            node, off = np.concatenate([self.child[node, near], self.child[node[reached], 1 - near[reached]]]), np.concatenate([off, far[reached]])
            rows = np.concatenate([rows, rows[reached]])
        return np.concatenate(found[0]), np.concatenate(found[1])


@dataclass(frozen=True)
class Forest:
    """A tree per group; leaves are numbered through."""

    trees: dict[int, SplitTree]
    first: dict[int, int]

    def cells(self, group: Column, features: Column, reach: Column) -> Column:
        """Array of the leaves within reach of each row."""

        @F.pandas_udf("array<int>")
        def within(group: pd.Series, x: pd.Series, reach: pd.Series) -> pd.Series:
            out = np.empty(len(x), object)
            for g, rows in group.groupby(group).groups.items():
                rows = group.index.get_indexer(rows)
                at, leaf = self.trees[g].within(np.stack(x.iloc[rows]), reach.iloc[rows].to_numpy(float))
                order = np.argsort(at, kind="stable")
                for r, part in zip(rows, np.split(leaf[order] + self.first[g], np.cumsum(np.bincount(at, minlength=len(rows)))[:-1]), strict=True):
                    out[r] = part.astype("int32")
            return pd.Series(out)

        return within(group, features, reach)

    def home(self, df: DataFrame, group: str, features: str = "features") -> DataFrame:
        """Adds ``cell`` (the row's leaf) and ``margin`` (distance to the nearest cut around it)."""

        @F.pandas_udf("cell int, margin double")
        def place(group: pd.Series, x: pd.Series) -> pd.DataFrame:
            cell, margin = np.zeros(len(x), "int32"), np.zeros(len(x))
            for g, rows in group.groupby(group).groups.items():
                rows = group.index.get_indexer(rows)
                leaf, margin[rows] = self.trees[g].home(np.stack(x.iloc[rows]))
                cell[rows] = leaf + self.first[g]
            return pd.DataFrame({"cell": cell, "margin": margin})

        return df.withColumn("__place", place(group, features)).select(*df.columns, "__place.cell", "__place.margin")


def forest(df: DataFrame, group: str, features: str = "features", key: str = "id", leaf_rows: int = LEAF_ROWS) -> Forest:
    """Trees over the rows of every group; there are few groups (segments), and each gives a bounded sample picked by hash."""
    sizes = {r[0]: r[1] for r in df.groupBy(group).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    wanted = min(MAX_SAMPLE, max(2_000, SAMPLE_PER_LEAF * -(-total // leaf_rows)))
    picked = df if total <= wanted else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(wanted / total * (1 << 30)))
    points: dict[int, list] = {g: [] for g in sizes}
    for r in picked.orderBy(key).select(group, features).limit(2 * MAX_SAMPLE).toLocalIterator():
        points[r[0]].append(r[1])
    trees, first, at = {}, {}, 0
    for g in sorted(sizes):
        trees[g] = SplitTree.over(np.array(points[g], float) if points[g] else np.zeros((0, 1)), sizes[g], leaf_rows)
        first[g] = at
        at += trees[g].leaves
    return Forest(trees, first)
