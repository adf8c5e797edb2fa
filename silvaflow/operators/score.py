"""Scoring rows where they lie: the forest as arrays in an Arrow UDF, no shuffle and no join.

Only the features go to the workers that score them; all other columns stay as they are. The sum over trees is taken in the
order of the trees, so that a row's prediction does not depend on how the input is partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .descend import Model

#: Nodes of a model that is sent to all workers (about 100 bytes each, and 8 for each class); larger ones are joined.
ARRAY_NODES = 2_000_000


class Arrays:
    """The nodes of a model's trees, as arrays: children by index, thresholds, levels, and what leaves say."""

    def __init__(self, m: Model, n_trees: int | None):
        nodes = m.nodes if n_trees is None else m.nodes.filter(F.col("tree") <= n_trees)
        is_class = m.meta.family == "classification"
        says = F.array(*(F.element_at("class_counts", F.lit(c)) for c in m.classes)) if is_class else F.array("prediction")
        t = nodes.select("tree", "node", "is_leaf", "split_feature", "threshold", "cats_left", "cats_right", "unseen_left", says.alias("says")).toPandas().sort_values(["tree", "node"], ignore_index=True)
        at = {f: j for j, (f, _) in enumerate(m.features)}
        self.numeric = np.array([k == "num" for _, k in m.features], bool)
        where = {k: i for i, k in enumerate(zip(t.tree.tolist(), t.node.tolist(), strict=True))}
        self.roots = [where[(k, 1)] for k in sorted(set(t.tree.tolist()))]
        self.feature = np.array([-1 if leaf else at[f] for leaf, f in zip(t.is_leaf, t.split_feature, strict=True)], np.int32)
        self.threshold = t.threshold.to_numpy(float, na_value=np.nan)
        self.left = np.array([-1 if leaf else where[(k, 2 * n)] for leaf, k, n in zip(t.is_leaf, t.tree, t.node, strict=True)], np.int64)
        self.right = np.array([-1 if leaf else where[(k, 2 * n + 1)] for leaf, k, n in zip(t.is_leaf, t.tree, t.node, strict=True)], np.int64)
        self.levels = {i: (frozenset(a), frozenset(b), bool(u)) for i, (a, b, u) in enumerate(zip(t.cats_left, t.cats_right, t.unseen_left, strict=True)) if a is not None and self.feature[i] >= 0}
        width = len(m.classes) if is_class else 1
        says = np.full((len(t), width), np.nan)
        for i, (leaf, v) in enumerate(zip(t.is_leaf, t.says, strict=True)):
            if leaf:
                v = np.array(v, float)
                says[i] = v / v.sum() if is_class else v
        self.says = says

    def score(self, num: np.ndarray, cat: list, skip: bool) -> np.ndarray:
        """Means over trees (rows x classes or 1), nan where nothing scores a row. num: rows x features, nan is missing."""
        n = len(num)
        missing = np.isnan(num) & self.numeric
        for j in np.flatnonzero(~self.numeric):
            missing[:, j] = [c[j] is None for c in cat]
        total, trees = np.zeros((n, self.says.shape[1])), np.zeros(n, np.int64)
        able = np.ones(n, bool) if skip else ~missing.any(axis=1)
        for root in self.roots:
            at = np.full(n, root, np.int64)
            live = np.flatnonzero(able)
            alive = able.copy()
            while len(live):
                live = live[self.feature[at[live]] >= 0]
                if not len(live):
                    break
                f = self.feature[at[live]]
                lost = missing[live, f]
                alive[live[lost]] = False
                live, f = live[~lost], f[~lost]
                here = at[live]
                with np.errstate(invalid="ignore"):
                    left = num[live, f] <= self.threshold[here]
                for k in np.flatnonzero(~self.numeric[f]).tolist():
                    a, b, unseen = self.levels[int(here[k])]
                    level = cat[live[k]][f[k]]
                    left[k] = level in a or (level not in b and unseen)
                at[live] = np.where(left, self.left[here], self.right[here])
            total[alive] += self.says[at[alive]]
            trees += alive
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(trees[:, None] > 0, total / np.maximum(trees, 1)[:, None], np.nan)


def scored(num: Column, cat: Column, m: Model, na_action: str, n_trees: int | None) -> Column:
    """array<double>: the prediction, or the classes' shares; null where nothing scores the row."""
    arrays, skip, width = Arrays(m, n_trees), na_action == "skip_tree", len(m.features)
    shared = m.nodes.sparkSession.sparkContext.broadcast(arrays)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        a = shared.value
        for num, cat in batches:
            rows = np.array([[np.nan if x is None else x for x in r] for r in num], float).reshape(len(num), width)
            out = a.score(rows, cat.tolist(), skip)
            yield pd.Series([None if np.isnan(r[0]) else r for r in out])

    return score(num, cat)


def fits(m: Model) -> bool:
    return m.n_nodes * max(1, len(m.classes)) <= ARRAY_NODES


def with_scores(df: DataFrame, num: Column, cat: Column, m: Model, na_action: str, n_trees: int | None, name: str) -> DataFrame:
    return df.withColumn(name, scored(num, cat, m, na_action, n_trees))
