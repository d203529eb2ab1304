"""Boosted trees of many sets of rows at once, each set in a task of its own.

Spark ML grows an ensemble by one job per level of every tree: 500 jobs for 100 trees of depth 5, whatever the number of rows. The folds
of a cross-validation are independent, so where a fold's rows fit into a task, Spark deals the rows by key, a task grows the whole ensemble
of its key in numpy, and all rows are scored in one pass.

The trees follow the rules of ``pyspark.ml``'s GBTClassifier and GBTRegressor, so that a fold's figures are those of such a model: at most
``bins`` bins of a feature by counts, variance as impurity, the first of equally good splits, the first tree on the label itself and the
others, weighted by ``rate``, on the negative gradient of the logistic or squared loss. No feature may be missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row

ENSEMBLE = "feature array<int>, threshold array<double>, value array<double>"
EPSILON = np.finfo(float).eps


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds of a feature: between all neighbouring values, or where the running count comes closest to even shares."""
    distinct, counts = np.unique(values, return_counts=True)
    middle, seen = (distinct[:-1] + distinct[1:]) / 2, np.cumsum(counts)
    bins = min(bins, len(values))
    if len(middle) < bins:
        return middle
    stride, chosen = len(values) / bins, []
    for i in range(len(middle)):
        target = stride * (len(chosen) + 1)
        if abs(seen[i] - target) < abs(seen[i + 1] - target):
            chosen.append(i)
    return middle[chosen]


def _variance(count, total, squares):
    return (squares - total * total / np.maximum(count, 1)) / np.maximum(count, 1)


def tree(codes: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A regression tree on binned features, level by level: feature and threshold of the inner nodes, values of the leaves, and the
    leaf of each row. A node that is not split sends all rows to the left."""
    n, width = codes.shape
    bins = max(2, max(len(c) for c in cuts) + 1)
    allowed = np.arange(bins - 1) < np.array([len(c) for c in cuts])[:, None]
    feature, threshold = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
    place, mean, unsplit, impurity = np.zeros(n, np.int64), np.array([y.mean()]), np.array([True]), None
    for _ in range(depth):
        nodes, rows = len(mean), np.flatnonzero(unsplit[place])
        node, target = place[rows] * bins, y[rows]
        weights = (None, target, target * target)
        sums = [np.empty((nodes, width, bins)) for _ in weights]
        for f in range(width):  # one feature after the other: no array of all cells
            cell = node + codes[rows, f]
            for s, w in zip(sums, weights):
                s[:, f] = np.bincount(cell, w, nodes * bins).reshape(nodes, bins).cumsum(1)
        left = [s[..., :-1] for s in sums]
        right = [s[..., -1:] - s[..., :-1] for s in sums]
        below, above = _variance(*left), _variance(*right)
        if impurity is None:
            impurity = _variance(*[s[:, 0, -1] for s in sums])
        whole = np.maximum(left[0] + right[0], 1)
        gain = impurity[:, None, None] - left[0] / whole * below - right[0] / whole * above
        gain = np.where(allowed & (left[0] >= 1) & (right[0] >= 1), gain, -np.inf).reshape(nodes, -1)
        best = gain.argmax(1)
        split = gain[np.arange(nodes), best] > 0
        f, k = np.divmod(best, bins - 1)
        at = (np.arange(nodes), f, k)
        inner = nodes - 1 + np.flatnonzero(split)
        feature[inner] = f[split]
        threshold[inner] = [cuts[a][b] for a, b in zip(f[split], k[split])]
        place = 2 * place + (split[place] & (codes[np.arange(n), f[place]] > k[place]))
        both = lambda a, b: np.stack((a, b), 1).ravel()
        mean = both(np.where(split, left[1][at] / np.maximum(left[0][at], 1), mean), right[1][at] / np.maximum(right[0][at], 1))
        impurity = both(below[at], above[at])
        unsplit = both(split, split) & (np.abs(impurity) >= EPSILON)
    return feature, threshold, mean, place


def ensemble(x: np.ndarray, label: np.ndarray, classes: bool, trees: int, depth: int, rate: float, bins: int) -> tuple[np.ndarray, ...]:
    """Features, thresholds and weighted leaf values of all trees; ``classes``: labels are 0 and 1."""
    cuts = [cut_points(column, bins) for column in x.T]
    codes = np.asfortranarray(np.stack([np.searchsorted(c, column).astype(np.int32) for c, column in zip(cuts, x.T)], 1))
    y = 2 * label - 1 if classes else label
    said, aim, grown = np.zeros(len(y)), y, []
    for k in range(trees):
        feature, threshold, value, leaf = tree(codes, cuts, aim, depth)
        value = value * (rate if k else 1.0)
        said = said + value[leaf]
        with np.errstate(over="ignore"):
            aim = 4 * y / (1 + np.exp(2 * y * said)) if classes else 2 * (y - said)
        grown.append((feature, threshold, value))
    return tuple(np.stack(part) for part in zip(*grown))


def score(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sum of the trees' values for each row."""
    rows, inner, out = np.arange(len(x)), feature.shape[1], np.zeros(len(x))
    for f, cut, v in zip(feature, threshold, value):
        node = np.zeros(len(x), np.int64)
        for _ in range(inner.bit_length()):
            node = 2 * node + 1 + (x[rows, f[node]] > cut[node])
        out += v[node - inner]
    return out


def _matrix(features: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pc.list_flatten(features).to_numpy().reshape(len(features), -1)


def fit(rows: DataFrame, keys: int, classes: bool, trees: int, depth: int, rate: float, bins: int) -> DataFrame:
    """One ensemble for each key of (key int, label double, features array); a key's rows must fit into a task. ``keys``: how many there are."""

    def grow(key, table):
        parts = ensemble(_matrix(table.column("features")), table.column("label").to_numpy(), classes, trees, depth, rate, bins)
        kinds = (pa.int32(), pa.float64(), pa.float64())
        arrays = [pa.array([p.ravel()], pa.list_(kind)) for p, kind in zip(parts, kinds)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *arrays], names=["key", "feature", "threshold", "value"])

    dealt = rows.select("key", "label", "features").repartition(4 * keys, "key")  # a fixed number: small partitions are not united
    return dealt.groupBy("key").applyInArrow(grow, f"key int, {ENSEMBLE}")


def scored(rows: DataFrame, ensembles: list[Row], trees: int) -> DataFrame:
    """(key, label, margin) of (key, label, features): each row by the ensemble of its key."""
    known = {e["key"]: [np.array(e[c]).reshape(trees, -1) for c in ("feature", "threshold", "value")] for e in ensembles}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, x = batch.column("key").to_numpy(), _matrix(batch.column("features"))
            margin = np.zeros(len(key))
            for k in np.unique(key):
                margin[key == k] = score(x[key == k], *known[k])
            yield pa.record_batch([batch.column("key"), batch.column("label"), pa.array(margin)], names=["key", "label", "margin"])

    return rows.select("key", "label", "features").mapInArrow(run, "key int, label double, margin double")
