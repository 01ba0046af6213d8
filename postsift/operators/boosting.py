"""Gradient boosted trees for all classes of a softmax at once, on binned features.

Each feature is cut once into at most `BINS` bins by quantiles of its values; zero has a border on
either side, so that the many zeros of term vectors are one bin that needs no entries. A round grows
one tree per class on the gradients of the softmax, leaf by leaf: the open leaf with the largest gain is split
until `num_leaves`, `max_depth` or `min_child_samples` stops it. Split gains use L1 and L2 terms, rows are
bagged anew every `bagging_freq` rounds and columns drawn per tree, both by hashes of seed and number,
so that a model does not depend on how rows are dealt.

Gradients are rounded to multiples of 2^-30, so sums of histograms are exact in any order. A training table up
to `TASK_BYTES` of binned rows is boosted inside a task, each task
one trial with all its folds. A larger one stays dealt over its partitions: each step sums the histograms of all
open leaves of all classes by a shuffle, and only the best split of each leaf comes to the driver. Both
ways run the same growth and give the same trees.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift import fixed_values as fv
from postsift.sources.staging import pin

DEFAULTS = {
    "num_leaves": 31, "max_depth": 5, "learning_rate": 0.1, "n_estimators": 100, "min_child_samples": 20,
    "reg_alpha": 0.0, "reg_lambda": 0.0, "subsample": 1.0, "bagging_freq": 1, "colsample_bytree": 1.0,
}
BINS = 64
TASK_BYTES = 256 << 20
#: Rows of a block, and features whose histograms one group sums, of a table that stays dealt.
BLOCK_ROWS = 20_000
CHUNK = 512
#: Entries summed at a time, and bytes of histograms that a growing tree keeps.
SLICE = 1 << 20
KEPT_BYTES = 256 << 20
LEAST_HESSIAN = 1e-3
_GRID = float(1 << 30)


# --- vectors and bins -------------------------------------------------------------------


def entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of all non-zero entries of a column of ML vectors, sparse or dense."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    kind = vectors.field("type").to_numpy(zero_copy_only=False)
    rows, columns, values = [], [], []
    for i, (sparse, index, value) in enumerate(zip(kind == 0, vectors.field("indices"), vectors.field("values"))):
        v = np.asarray(value.values.to_numpy(zero_copy_only=False), float)
        j = np.asarray(index.values.to_numpy(zero_copy_only=False), np.int64) if sparse else np.arange(len(v))
        keep = v != 0
        rows.append(np.full(int(keep.sum()), i))
        columns.append(j[keep])
        values.append(v[keep])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns]), np.concatenate([np.empty(0), *values])


@dataclass
class Bins:
    """Borders of the features that have any, as one array; a value is in the bin of the first border not below it."""

    columns: np.ndarray  # feature numbers, ascending
    first: np.ndarray  # offsets of the borders of each feature
    borders: np.ndarray

    @property
    def offsets(self) -> np.ndarray:
        """Number of the first bin of each feature; one bin more than borders."""
        return self.first + np.arange(len(self.first))

    def zero(self) -> np.ndarray:
        return self.offsets[:-1] + np.array(
            [np.searchsorted(self.borders[a:b], 0.0) for a, b in zip(self.first, self.first[1:])], np.int64
        )

    def of(self, columns: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin numbers, and which entries have one; the others' features do not vary."""
        at = np.minimum(np.searchsorted(self.columns, columns), max(0, len(self.columns) - 1))
        known = self.columns[at] == columns if len(self.columns) else np.zeros(len(columns), bool)
        at, values = at[known], values[known]
        low, high = self.first[at], self.first[at + 1]
        end = high.copy()
        while (low < high).any():  # a binary search in the borders of each entry's feature
            middle = (low + high) // 2
            inside = low < high
            below = inside & (self.borders[np.minimum(middle, len(self.borders) - 1)] < values)
            low = np.where(below, middle + 1, low)
            high = np.where(inside & ~below, middle, high)
        assert (low <= end).all()
        return low + at, known


def find_bins(df: DataFrame, features: str = "features", bins: int = BINS) -> Bins:
    """Borders from quantiles of each feature's non-zero values, found by one aggregation per feature."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, columns, values = entries(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(columns, pa.int64()), pa.array(values, pa.float64())], names=["f", "v"])

    shares = [(i + 1) / (bins - 2) for i in range(bins - 3)]
    found = df.select(features).mapInArrow(explode, "f long, v double").groupBy("f").agg(
        F.percentile_approx("v", shares, 10_000).alias("q"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    columns, first, borders = [], [0], []
    for r in sorted(found.collect(), key=lambda r: r.f):  # features x bins numbers
        own = {q for q in r.q if q < r.high}
        own |= {0.0} if r.high > 0 else set()
        own |= {float(np.nextafter(0.0, -1.0))} if r.low < 0 else set()
        columns.append(r.f)
        borders += sorted(own)
        first.append(len(borders))
    return Bins(np.array(columns, np.int64), np.array(first, np.int64), np.array(borders, float))


def bin_rows(df: DataFrame, bins: Bins, label: str, key: str, features: str, fold: str | None) -> DataFrame:
    """key, label, fold, bins: the numbers of a row's non-zero bins, as bytes."""
    held = F.col(fold).cast("int") if fold else F.lit(-1)
    rows = df.select(F.xxhash64(key).alias("key"), F.col(label).cast("int").alias("label"), held.alias("fold"), F.col(features).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, column, value = entries(batch.column(3))
            number, known = bins.of(column, value)
            ends = np.searchsorted(row[known], np.arange(batch.num_rows + 1))
            packed = [number[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(packed, pa.binary())], names=["key", "label", "fold", "bins"]
            )

    return rows.mapInArrow(run, "key long, label int, fold int, bins binary")


class Block:
    """Binned rows: bin numbers of row i are flat[start[i]:start[i + 1]]."""

    def __init__(self, keys, labels, folds, start, flat, offsets, zero) -> None:
        self.keys, self.labels, self.folds, self.start, self.flat = keys, labels, folds, start, flat
        self.offsets, self.zero = offsets, zero
        self.owner = self.edges = None

    @classmethod
    def of(cls, table: pa.Table, bins: Bins) -> "Block":
        table = table.combine_chunks().sort_by("key")
        sizes, flat = packed_numbers(table.column("bins"), np.int32)
        start = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        numbers = [np.asarray(table.column(c).to_numpy(), np.int64) for c in ("key", "label", "fold")]
        return cls(*numbers, start, flat, bins.offsets, bins.zero())

    def by_bin(self) -> "Block":
        """Adds the rows of each bin: owner[edges[b]:edges[b + 1]]. Worth it where many trees are grown."""
        rows = np.repeat(np.arange(len(self.keys), dtype=np.int32), np.diff(self.start))
        self.owner = rows[np.argsort(self.flat, kind="stable")]
        self.edges = np.concatenate(([0], np.cumsum(np.bincount(self.flat, minlength=self.offsets[-1]))))
        return self

    def histogram(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums of the three columns of `weights` over `rows`, by bin."""
        size = (self.start[rows + 1] - self.start[rows]).sum()
        many = self.owner is not None and 3 * size > len(self.flat)
        out = self._sums_by_bin(rows, weights) if many else self._sums_by_row(rows, weights)
        if len(self.zero):
            rest = weights[rows].sum(axis=0)[:, None] - np.add.reduceat(out, self.offsets[:-1], axis=1)
            out[:, self.zero] += rest
        return out

    def _sums_by_row(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((3, self.offsets[-1]))
        n = self.start[rows + 1] - self.start[rows]
        for part in _slices(np.cumsum(n)):
            mine = rows[part]
            flat = np.concatenate([np.empty(0, np.int32), *[self.flat[self.start[i] : self.start[i + 1]] for i in mine]])
            for j in range(3):
                out[j] += np.bincount(flat, np.repeat(weights[mine, j], n[part]), len(out[j]))
        return out

    def _sums_by_bin(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out, held = np.zeros((3, self.offsets[-1])), np.zeros((3, len(self.keys)))
        held[:, rows] = weights[rows].T
        used = np.flatnonzero(np.diff(self.edges))
        for part in _slices(self.edges[used + 1]):
            mine = used[part]
            low = self.edges[mine[0]]
            owner, first = self.owner[low : self.edges[mine[-1] + 1]].astype(np.int64), self.edges[mine] - low
            for j in range(3):
                out[j, mine] = np.add.reduceat(held[j].take(owner), first)
        return out

    def bin_of(self, rows: np.ndarray, feature: int) -> np.ndarray:
        """The bin of a feature in each row."""
        low, high = self.offsets[feature], self.offsets[feature + 1]
        out = np.full(len(self.keys), self.zero[feature])
        if self.owner is not None:
            edges = self.edges[low : high + 1]
            out[self.owner[edges[0] : edges[-1]]] = np.repeat(np.arange(low, high), np.diff(edges))
        else:
            at = np.flatnonzero((self.flat >= low) & (self.flat < high))
            out[np.searchsorted(self.start, at, "right") - 1] = self.flat[at]
        return out[rows]


def packed_numbers(column: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each value of a binary column without nulls holds, and all of them."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    size = np.dtype(kind).itemsize
    sizes = [np.asarray(pc.binary_length(c), np.int64) // size for c in chunks]
    # Values lie one behind the other, from the first offset on.
    data = [np.frombuffer(c.buffers()[2], np.uint8) if len(c) and c.buffers()[2] else np.empty(0, np.uint8) for c in chunks]
    first = [np.frombuffer(c.buffers()[1], np.int32)[c.offset] if len(c) else 0 for c in chunks]
    parts = [d[a : a + n.sum() * size].view(kind) for d, a, n in zip(data, first, sizes)]
    return np.concatenate([np.empty(0, np.int64), *sizes]), np.concatenate([np.empty(0, kind), *parts])


def _slices(ends: np.ndarray) -> Iterator[slice]:
    """Slices of things that end at `ends`, of about SLICE entries each, one thing at least."""
    at = 0
    while at < len(ends):
        begin = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + SLICE, "right")))
        yield slice(at, to)
        at = to


# --- one tree ---------------------------------------------------------------------------


def _score(g, h, alpha: float, lam: float):
    return np.maximum(np.abs(g) - alpha, 0.0) ** 2 / (h + lam)


def leaf_value(total: np.ndarray, p: Mapping[str, Any]) -> float:
    """The step of a leaf with the sums (gradient, hessian, rows)."""
    g, h = total[0] / _GRID, total[1] / _GRID
    return float(-np.sign(g) * max(abs(g) - p["reg_alpha"], 0.0) / (h + p["reg_lambda"]) * p["learning_rate"]) if h + p["reg_lambda"] > 0 else 0.0


def places(offsets: np.ndarray, usable: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk of features: its first bin, its end, the bins that may be the last on the left, all but the last of each
    usable feature, their features, and first bins; both kinds of bins count from the chunk's first."""
    out = []
    for i in range(0, len(usable), CHUNK):
        own = offsets[i : i + CHUNK + 1]
        last = np.zeros(own[-1] - own[0], bool)
        last[own[1:] - own[0] - 1] = True
        at = np.flatnonzero(~last & np.repeat(usable[i : i + CHUNK], np.diff(own)))
        feature = np.searchsorted(own, at + own[0], "right") - 1
        if len(at):
            out.append((int(own[0]), int(own[-1]), at, feature + i, own[feature] - own[0]))
    return out


def best_split(hist: np.ndarray, cuts: list, total: np.ndarray, p: Mapping[str, Any]):
    """(gain, feature, last bin on the left, sums of the left side) of the best split, or None."""
    best = None
    least, a, lam = p["min_child_samples"], p["reg_alpha"], p["reg_lambda"]
    whole = _score(total[0] / _GRID, total[1] / _GRID, a, lam)
    for low, high, at, feature, first in cuts:
        own = hist[:, low:high]
        sums = np.zeros((3, high - low + 1))
        np.cumsum(own, axis=1, out=sums[:, 1:])
        n = sums[2, at + 1] - sums[2, first]
        able = np.flatnonzero((n >= least) & (total[2] - n >= least))
        if not len(able):
            continue
        left = sums[:, at[able] + 1] - sums[:, first[able]]
        right = total[:, None] - left
        g, h = left[0] / _GRID, left[1] / _GRID
        r, s = right[0] / _GRID, right[1] / _GRID
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = _score(g, h, a, lam) + _score(r, s, a, lam)
        gain[(h < LEAST_HESSIAN) | (s < LEAST_HESSIAN)] = -np.inf
        gain -= whole
        i = int(np.argmax(gain))
        if gain[i] > (best[0] if best else 1e-12):
            best = (float(gain[i]), int(feature[able[i]]), int(at[able[i]]) + low, left[:, i])
    return best


class Tree:
    """A tree that grows leaf by leaf. Node i goes left if its feature's bin is at most `bin[i]`; -1 is a leaf."""

    def __init__(self, total: np.ndarray, p: Mapping[str, Any]) -> None:
        self.p, self.feature, self.bin, self.left, self.right = p, [-1], [-1], [-1], [-1]
        self.total, self.depth = [total], [0]
        self.open: dict[int, tuple] = {}
        self.wanted = [0]

    def offer(self, leaf: int, split) -> None:
        if split:
            self.open[leaf] = split

    def grow(self) -> int | None:
        """Splits the best open leaf and returns it; `wanted` are then the leaves whose best split is not known."""
        leaves = (len(self.feature) + 1) // 2
        if not self.open or leaves >= self.p["num_leaves"]:
            self.wanted = []
            return None
        node = max(self.open, key=lambda i: (self.open[i][0], -i))
        _, self.feature[node], self.bin[node], left = self.open.pop(node)
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for total in (left, self.total[node] - left):
            self.feature.append(-1)
            self.bin.append(-1)
            self.left.append(-1)
            self.right.append(-1)
            self.total.append(total)
            self.depth.append(self.depth[node] + 1)
        deep = self.p["max_depth"] > 0 and self.depth[-1] >= self.p["max_depth"]
        self.wanted = [] if deep else [i for i in (self.left[node], self.right[node]) if self.total[i][2] >= 2 * self.p["min_child_samples"]]
        return node

    def values(self) -> np.ndarray:
        return np.array([leaf_value(t, self.p) for t in self.total])

    def arrays(self) -> list[list]:
        return [self.feature, self.bin, self.left, self.right, self.values().tolist()]

    def turned(self) -> "Tree":
        """The tree of the opposite gradients."""
        other = Tree(self.total[0], self.p)
        other.feature, other.bin, other.left, other.right = self.feature, self.bin, self.left, self.right
        other.total = [t * (-1, 1, 1) for t in self.total]
        return other


def leaves_of(tree: Sequence[Sequence], block: Block, rows: np.ndarray) -> np.ndarray:
    """The leaf of each row, for the first four arrays of a tree."""
    feature, cut, left, right = (np.asarray(tree[i]) for i in range(4))
    at = np.zeros(len(rows), np.int64)
    todo = np.arange(len(rows)) if feature[0] >= 0 else np.empty(0, np.int64)
    while len(todo):
        for node in np.unique(at[todo]):
            mine = todo[at[todo] == node]
            go = block.bin_of(rows[mine], feature[node]) <= cut[node]
            at[mine] = np.where(go, left[node], right[node])
        todo = todo[feature[at[todo]] >= 0]
    return at


# --- rounds -----------------------------------------------------------------------------


def _mixed(keys: np.ndarray, *numbers: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that follow from keys and numbers."""
    x = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in (*numbers, 1):
            x = (x ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
    return x / 2.0**64


def bag(keys: np.ndarray, p: Mapping[str, Any], rounds: int, seed: int) -> np.ndarray:
    """Which rows a round trains on."""
    if p["subsample"] >= 1.0 or p["bagging_freq"] < 1:
        return np.ones(len(keys), bool)
    return _mixed(keys, seed, rounds // p["bagging_freq"]) < p["subsample"]


def columns_of(n: int, p: Mapping[str, Any], rounds: int, cls: int, seed: int) -> np.ndarray:
    """Which features a tree may use."""
    out = np.zeros(n, bool)
    out[np.argsort(_mixed(np.arange(n), seed + 1, rounds, cls))[: max(1, round(n * p["colsample_bytree"]))]] = True
    return out if p["colsample_bytree"] < 1.0 else np.ones(n, bool)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(scores: np.ndarray, labels: np.ndarray, cls: int) -> np.ndarray:
    """(gradient, hessian, 1) per row for the trees of a class, on the grid of exact sums."""
    prob = softmax(scores)[:, cls]
    k = scores.shape[1]
    g = prob - (labels == cls)
    h = k / (k - 1) * prob * (1 - prob) if k > 1 else prob * (1 - prob)
    return np.stack([np.round(g * _GRID), np.round(h * _GRID), np.ones(len(g))], axis=1)


def prior(counts: np.ndarray) -> np.ndarray:
    """Scores before the first tree: logarithms of the class shares."""
    return np.log(np.maximum(counts / max(1, counts.sum()), 1e-15))


def log_loss(scores: np.ndarray, labels: np.ndarray) -> float:
    prob = softmax(scores)[np.arange(len(labels)), labels]
    return float(-np.log(np.clip(prob, 1e-15, 1.0)).mean()) if len(labels) else 0.0


def _opposite(a: np.ndarray, b: np.ndarray) -> bool:
    return np.array_equal(a[:, 0], -b[:, 0]) and np.array_equal(a[:, 1:], b[:, 1:])


def _one_tree(block: Block, weights: np.ndarray, usable: np.ndarray, p: Mapping[str, Any]) -> tuple[Tree, np.ndarray]:
    """A tree on one block, and the leaf of each row. A child's histogram is its parent's less its sibling's, where the
    parent's was kept: of the open leaves, up to KEPT_BYTES, those with the most rows have theirs kept."""
    rows = {0: np.arange(len(weights))}
    tree = Tree(weights.sum(axis=0), p)
    hists, cuts = {0: block.histogram(rows[0], weights)}, places(block.offsets, usable)
    most = max(2, KEPT_BYTES // max(1, hists[0].nbytes))
    tree.offer(0, best_split(hists[0], cuts, tree.total[0], p))
    while (node := tree.grow()) is not None:
        own = rows.pop(node)
        parent = hists.pop(node, None)
        go = block.bin_of(own, tree.feature[node]) <= tree.bin[node]
        sides = {tree.left[node]: own[go], tree.right[node]: own[~go]}
        rows.update(sides)
        if tree.wanted:
            small, large = sorted(sides, key=lambda i: len(sides[i]))
            found = {}
            if small in tree.wanted or parent is not None:
                found[small] = block.histogram(sides[small], weights)
            if large in tree.wanted:
                found[large] = block.histogram(sides[large], weights) if parent is None else np.subtract(parent, found[small], out=parent)
            for leaf in tree.wanted:
                tree.offer(leaf, best_split(found[leaf], cuts, tree.total[leaf], p))
                if leaf in tree.open:
                    hists[leaf] = found[leaf]
            while len(hists) > most:
                del hists[min(hists, key=lambda i: len(rows[i]))]
    at = np.empty(len(weights), np.int64)
    for leaf, own in rows.items():
        at[own] = leaf
    return tree, at


def boost(
    block: Block, k: int, params: Mapping[str, Any], seed: int = fv.SEED, folds: int = 0, patience: int = fv.BOOST_PATIENCE,
    medians: Sequence[float] = (),
) -> tuple[list[list[list]], np.ndarray, list[float]]:
    """(trees by round and class, scores before them, mean held-out loss by round) on one block.

    With `folds`, a model per fold is grown in step; rounds end when the mean loss has had no new least
    value for `patience` rounds, or is above the `medians` of earlier trials. Trees are returned when there
    is one model only, up to the round of least loss."""
    p = {**DEFAULTS, **params}
    labels, n = block.by_bin().labels, len(block.labels)
    held = [block.folds == i for i in range(folds)] or [np.zeros(n, bool)]
    n_features = len(block.zero)
    begin = [prior(np.bincount(labels[~h], minlength=k)) for h in held]
    scores = [np.tile(b, (n, 1)) for b in begin]
    trees, curve = [], []
    for r in range(int(p["n_estimators"])):
        bagged = bag(block.keys, p, r, seed)
        grown = []
        for f, out in enumerate(held):
            used = (bagged & ~out).astype(float)[:, None]
            step = np.empty((n, k))
            past = None
            for c in range(k):
                weights, usable = gradients(scores[f], labels, c) * used, columns_of(n_features, p, r, c, seed)
                if past and _opposite(weights, past[0]) and np.array_equal(usable, past[1]):  # as two classes have
                    tree = tree.turned()
                else:
                    tree, at = _one_tree(block, weights, usable, p)
                past = weights, usable
                step[:, c] = tree.values()[at]
                if folds < 2:
                    grown.append(tree.arrays())
            scores[f] = scores[f] + step
        trees.append(grown)
        if not folds:
            if all(t[0][0] < 0 for t in grown) and (p["subsample"] >= 1.0 or p["bagging_freq"] < 1):  # no leaf can be split any more
                break
            continue
        curve.append(float(np.mean([log_loss(scores[f][h], labels[h]) for f, h in enumerate(held)])))
        best = int(np.argmin(curve))
        if r - best >= patience or (r < len(medians) and r + 1 >= patience and curve[best] > medians[r]):
            break
    kept = trees[: int(np.argmin(curve)) + 1] if folds else trees
    return kept if folds < 2 else [], begin[0], curve


# --- a table that stays dealt over its partitions -----------------------------------------


def boost_dealt(rows: DataFrame, bins: Bins, k: int, params: Mapping[str, Any], seed: int = fv.SEED) -> tuple[list[list[list]], np.ndarray]:
    """The trees that `boost` grows, with histograms summed by a shuffle."""
    begin, rounds = rounds_dealt(rows, bins, k, params, seed)
    return list(rounds), begin


def curve_dealt(
    rows: DataFrame, bins: Bins, k: int, params: Mapping[str, Any], seed: int = fv.SEED, folds: int = fv.FOLDS,
    patience: int = fv.BOOST_PATIENCE, medians: Sequence[float] = (),
) -> list[float]:
    """The curve that `boost` gives with `folds`, for rows that stay dealt; held-out losses are summed some rounds at a time."""
    n = int({**DEFAULTS, **params}["n_estimators"])
    grown, held, curve = [], [], []
    for f in range(folds):
        begin, rounds = rounds_dealt(rows.filter(F.col("fold") != f), bins, k, params, seed, whole=True)
        grown.append(rounds)
        held.append(DealtBlocks.of(rows.filter(F.col("fold") == f), bins, k, begin))
    while len(curve) < n:
        steps = [list(itertools.islice(g, min(SCORED_ROUNDS, n - len(curve)))) for g in grown]
        for losses in zip(*[h.losses(step) for h, step in zip(held, steps)]):
            curve.append(float(np.mean(losses)))
            r, best = len(curve) - 1, int(np.argmin(curve))
            if r - best >= patience or (r < len(medians) and r + 1 >= patience and curve[best] > medians[r]):
                return curve
        held = [h.after(step) for h, step in zip(held, steps)]
    return curve


_BLOCK = "block int, rows long, keys binary, labels binary, start binary, flat binary"


@dataclass
class DealtBlocks:
    """Blocks of binned rows as records of a written table, later with their scores."""

    state: DataFrame
    offsets: np.ndarray
    zero: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, bins: Bins, k: int, begin: np.ndarray | None = None) -> "DealtBlocks":
        def pack(table: pa.Table) -> pa.Table:
            b = Block.of(table, bins)
            data = [x.tobytes() for x in (b.keys, b.labels, b.start, b.flat)]
            return pa.table({"block": table.column("block").slice(0, 1), "rows": pa.array([len(b.keys)], pa.int64()),
                             **{c: pa.array([d], pa.binary()) for c, d in zip(("keys", "labels", "start", "flat"), data)}})

        n_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
        dealt = rows.withColumn("block", F.pmod("key", F.lit(n_blocks)).cast("int"))
        blocks = pin(dealt.groupBy("block").applyInArrow(pack, _BLOCK), "blocks")
        if begin is None:
            counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
            begin = prior(np.array([counts.get(c, 0) for c in range(k)], float))
        return cls(blocks, bins.offsets, bins.zero(), begin)

    def open_block(self, r: Mapping[str, Any]) -> Block:
        keys, labels, start = (np.frombuffer(r[c], np.int64) for c in ("keys", "labels", "start"))
        return Block(keys, labels, None, start, np.frombuffer(r["flat"], np.int32), self.offsets, self.zero)

    def scores_by_round(self, r: Mapping[str, Any], block: Block, past: list) -> Iterator[np.ndarray]:
        """Scores as written, then after each of the rounds `past`."""
        out = np.frombuffer(r["scores"]).reshape(-1, len(self.begin)).copy() if r.get("scores") else np.tile(self.begin, (len(block.keys), 1))
        every = np.arange(len(block.keys))
        yield out
        for grown in past:
            out = out + np.stack([np.asarray(t[4])[leaves_of(t, block, every)] for t in grown], axis=1)
            yield out

    def scores_of(self, r: Mapping[str, Any], block: Block, past: list) -> np.ndarray:
        *_, out = self.scores_by_round(r, block, past)
        return out

    def worker(self) -> "DealtBlocks":
        """What a task needs."""
        return DealtBlocks(None, self.offsets, self.zero, self.begin)

    def losses(self, past: list) -> list[float]:
        """The mean log loss after each of the rounds `past`."""
        own = self.worker()

        def run(batches):
            for batch in batches:
                for rec in batch.to_pylist():
                    block = own.open_block(rec)
                    _, *later = own.scores_by_round(rec, block, past)
                    sums = [log_loss(s, block.labels) * len(block.labels) for s in later]
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.float64()), pa.array([len(block.labels)] * len(sums), pa.int64())], names=["r", "loss", "n"])

        found = self.state.mapInArrow(run, "r int, loss double, n long").groupBy("r").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
        sums = {x.r: x.loss / max(1, x.n) for x in found.collect()}
        return [sums.get(r, 0.0) for r in range(len(past))]

    def after(self, past: list) -> "DealtBlocks":
        """The same blocks with the scores after the rounds `past`, written, so that tasks replay few trees."""
        own = self.worker()

        def run(batches):
            for batch in batches:
                for rec in batch.to_pylist():
                    rec["scores"] = own.scores_of(rec, own.open_block(rec), past).tobytes()
                    yield pa.RecordBatch.from_pylist([rec], schema=schema)

        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in f"{_BLOCK}, scores binary".split(", ")])
        return DealtBlocks(pin(self.state.mapInArrow(run, f"{_BLOCK}, scores binary"), "scores"), self.offsets, self.zero, self.begin)


def rounds_dealt(
    rows: DataFrame, bins: Bins, k: int, params: Mapping[str, Any], seed: int = fv.SEED, whole: bool = False,
) -> tuple[np.ndarray, Iterator[list[list]]]:
    """(scores before the trees, the trees of round after round).

    Blocks of rows are pinned, and their scores after some rounds; every step sends the histograms of the
    wanted leaves of all classes, by chunks of features, and brings back the best split of each leaf. The
    rounds end when no leaf can be split any more, unless the `whole` number is asked for."""
    p = {**DEFAULTS, **params}
    dealt = DealtBlocks.of(rows, bins, k)
    offsets, zero = dealt.offsets, dealt.zero
    n_features = len(zero)
    own = dealt.worker()
    open_block, scores_of = own.open_block, own.scores_of

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def totals(r: int, past: list) -> Callable:
        def run(batches):
            for rec in records(batches):
                block = open_block(rec)
                scores, used = scores_of(rec, block, past), bag(block.keys, p, r, seed)[:, None]
                sums = np.stack([(gradients(scores, block.labels, c) * used).sum(axis=0) for c in range(k)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), *(pa.array(s) for s in sums.T)], names=["cls", "g", "h", "n"])

        return run

    def histograms(r: int, past: list, growing: list, wanted: list) -> Callable:
        chunks = [(a, min(n_features, a + CHUNK)) for a in range(0, n_features, CHUNK)]

        def run(batches):
            for rec in records(batches):
                block = open_block(rec)
                scores, used = scores_of(rec, block, past), bag(block.keys, p, r, seed)[:, None]
                every = np.arange(len(block.keys))
                at = {c: leaves_of(growing[c], block, every) for c in {c for c, _ in wanted}}
                for c, leaf in wanted:
                    hist = block.histogram(np.flatnonzero(at[c] == leaf), gradients(scores, block.labels, c) * used)
                    for i, (a, b) in enumerate(chunks):
                        part = np.ascontiguousarray(hist[:, offsets[a] : offsets[b]])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x], pa.int32()) for x in (c, leaf, i)] + [pa.array([part.tobytes()], pa.binary())],
                            names=["cls", "leaf", "chunk", "hist"],
                        )

        return run

    def judge(r: int, sums: dict) -> Callable:
        def run(table: pa.Table) -> pa.Table:
            c, leaf, i = (table.column(x)[0].as_py() for x in ("cls", "leaf", "chunk"))
            a, b = i * CHUNK, min(n_features, (i + 1) * CHUNK)
            hist = sum(np.frombuffer(x).reshape(3, -1) for x in table.column("hist").to_pylist())
            usable = columns_of(n_features, p, r, c, seed)[a:b]
            found = best_split(hist, places(offsets[a : b + 1] - offsets[a], usable), sums[c, leaf], p)
            rows = [(c, leaf, found[0], found[1] + a, found[2] + int(offsets[a]), *found[3].tolist())] if found else []
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), *[pa.float64()] * 3)
            names = ["cls", "leaf", "gain", "feature", "bin", "g", "h", "n"]
            return pa.table({n: pa.array([x[j] for x in rows], t) for j, (n, t) in enumerate(zip(names, kinds))})

        return run

    def grow() -> Iterator[list[list]]:
        now, past = dealt, []
        for r in range(int(p["n_estimators"])):
            state = now.state
            first = {x.cls: np.array([x.g, x.h, x.n]) for x in state.mapInArrow(totals(r, past), "cls int, g double, h double, n double")
                     .groupBy("cls").agg(*[F.sum(c).alias(c) for c in "ghn"]).collect()}
            growing = [Tree(first[c], p) for c in range(k)]
            while wanted := [(c, leaf) for c, t in enumerate(growing) for leaf in t.wanted]:
                shapes = [t.arrays()[:4] for t in growing]
                sums = {(c, leaf): growing[c].total[leaf] for c, leaf in wanted}
                found = state.mapInArrow(histograms(r, past, shapes, wanted), "cls int, leaf int, chunk int, hist binary")
                found = found.groupBy("cls", "leaf", "chunk").applyInArrow(
                    judge(r, sums), "cls int, leaf int, gain double, feature long, bin long, g double, h double, n double"
                ).collect()  # a row per leaf and chunk of features
                best: dict = {}
                for x in sorted(found, key=lambda x: (-x.gain, x.bin)):
                    best.setdefault((x.cls, x.leaf), (x.gain, x.feature, x.bin, np.array([x.g, x.h, x.n])))
                for c, leaf in wanted:
                    growing[c].offer(leaf, best.get((c, leaf)))
                for c, t in enumerate(growing):
                    t.wanted = []
                    while t.grow() is not None and not t.wanted:
                        pass
            grown = [t.arrays() for t in growing]
            past = [*past, grown]
            yield grown
            if not whole and all(t[0][0] < 0 for t in grown) and (p["subsample"] >= 1.0 or p["bagging_freq"] < 1):
                break
            if len(past) == SCORED_ROUNDS:
                now, past = now.after(past), []

    return dealt.begin, grow()


#: Rounds after which scores are written.
SCORED_ROUNDS = 8


# --- models -----------------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees by round and class on raw values: a row goes left if its value is at most the border."""

    trees: list[list[list]]  # [feature, border, left, right, value] per round and class
    begin: list[float]
    features: str = "features"

    @classmethod
    def of(cls, trees: list[list[list]], begin: np.ndarray, bins: Bins, features: str) -> "Boosted":
        offsets = bins.offsets

        def raw(t: list) -> list:
            inner = [f >= 0 for f in t[0]]
            cut = [float(bins.borders[b - offsets[f] + bins.first[f]]) if i else 0.0 for f, b, i in zip(t[0], t[1], inner)]
            return [[int(bins.columns[f]) if i else -1 for f, i in zip(t[0], inner)], cut, list(t[2]), list(t[3]), list(t[4])]

        return cls([[raw(t) for t in grown] for grown in trees], [float(b) for b in begin], features)

    def by_round(self, vectors: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, round, scores after it) of a column of vectors, some rows at a time; round -1 is before all."""
        used = np.unique([f for grown in self.trees for t in grown for f in t[0] if f >= 0]).astype(np.int64)
        arrays = [[(np.searchsorted(used, np.maximum(t[0], 0)), np.array(t[0]) >= 0, *(np.array(x) for x in t[1:])) for t in grown] for grown in self.trees]
        step = max(1, 4_000_000 // max(1, len(used)))
        for lo in range(0, len(vectors), step):
            part = vectors.slice(lo, step)
            row, column, value = entries(part)
            mine = np.isin(column, used)
            dense = np.zeros((len(part), max(1, len(used))))
            dense[row[mine], np.searchsorted(used, column[mine])] = value[mine]
            out = np.tile(np.array(self.begin), (len(part), 1))
            yield lo, -1, out
            for r, grown in enumerate(arrays):
                for c, (feature, inner, cut, left, right, leaf) in enumerate(grown):
                    at = np.zeros(len(part), np.int64)
                    todo = np.arange(len(part)) if inner[0] else np.empty(0, np.int64)
                    while len(todo):
                        node = at[todo]
                        at[todo] = np.where(dense[todo, feature[node]] <= cut[node], left[node], right[node])
                        todo = todo[inner[at[todo]]]
                    out[:, c] += leaf[at]
                yield lo, r, out

    def probabilities(self, vectors: pa.Array) -> np.ndarray:
        out = np.empty((len(vectors), len(self.begin)))
        for lo, r, scores in self.by_round(vectors):
            if r == len(self.trees) - 1:
                out[lo : lo + len(scores)] = scores
        return softmax(out)

    def until_least_loss(self, held: DataFrame, label: str = "label", patience: int = fv.BOOST_PATIENCE) -> "Boosted":
        """The rounds up to the least loss on held-out rows before `patience` rounds without a new one."""

        def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
                sums = np.zeros(len(self.trees))
                for lo, r, scores in self.by_round(batch.column(1)):
                    if r >= 0:
                        sums[r] += log_loss(scores, labels[lo : lo + len(scores)]) * len(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["r", "loss"])

        found = held.select(F.col(label).cast("int"), self.features).mapInArrow(losses, "r int, loss double").groupBy("r").agg(F.sum("loss").alias("loss"))
        curve = [x.loss for x in sorted(found.collect(), key=lambda x: x.r)]
        best = 0
        for i, loss in enumerate(curve):
            if loss < curve[best]:
                best = i
            elif i - best >= patience:
                break
        return Boosted(self.trees[: best + 1], self.begin, self.features)

    def scores(self, df: DataFrame, out: str = "p") -> DataFrame:
        """`df` with the class probabilities, tree by tree over Arrow batches of vectors."""

        @F.arrow_udf("array<double>")
        def score(vectors: pa.Array) -> pa.Array:
            p = self.probabilities(vectors)
            return pa.array(p.tolist(), pa.list_(pa.float64()))

        return df.withColumn(out, score(F.col(self.features)))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        rows = [(r, c, json.dumps(t)) for r, grown in enumerate(self.trees) for c, t in enumerate(grown)]
        spark.createDataFrame(rows, "round int, cls int, tree string").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        meta = json.dumps({"begin": self.begin, "features": self.features, "rounds": len(self.trees)})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> "Boosted":
        spark = SparkSession.active()
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        rows = sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: (r["round"], r["cls"]))
        trees = [[json.loads(r["tree"]) for r in rows if r["round"] == i] for i in range(meta["rounds"])]
        return cls(trees, meta["begin"], meta["features"])


def fit(
    df: DataFrame, params: Mapping[str, Any] | None = None, n_classes: int = 2, features: str = "features",
    label: str = "label", key: str = "post_id", seed: int = fv.SEED, valid: str | None = None, task_bytes: int | None = None,
) -> Boosted:
    """Boosted trees for all classes, `n_estimators` rounds; `key` decides only the bags.

    Rows with a true `valid` are held out, and the rounds up to their least loss are kept."""
    params = params or {}
    bins = find_bins(df, features)
    held = F.when(F.col(valid), 0).otherwise(-1) if valid else F.lit(-1)
    rows = pin(bin_rows(df.withColumn("_held", held), bins, label, key, features, "_held"), "binned")
    if _bytes(rows) > (TASK_BYTES if task_bytes is None else task_bytes):
        trees, begin = boost_dealt(rows.filter("fold < 0"), bins, n_classes, params, seed)
        model = Boosted.of(trees, begin, bins, features)
        return model.until_least_loss(df.filter(valid), label) if valid else model

    def run(table: pa.Table) -> pa.Table:
        trees, begin, _ = boost(Block.of(table, bins), n_classes, params, seed, 1 if valid else 0)
        return pa.table({"model": pa.array([json.dumps([trees, begin.tolist()])], pa.string())})

    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "model string").first()
    trees, begin = json.loads(found["model"]) if found else ([], prior(np.ones(n_classes)).tolist())
    return Boosted.of(trees, np.array(begin), bins, features)


def _bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.length("bins") + 24)).first()[0] or 0
