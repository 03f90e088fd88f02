"""Random forests over many rows: a tree is grown in one task, and trees meet only as rows of a table.

Spark's own trainer keeps all nodes of all trees on the driver and sends one histogram of all bins per node, however few
rows the node has. Here the rows are cut into bins once and stored as a compact matrix (a byte per row and feature; of a
wide sparse set, three bytes per stored value). Every task reads that matrix and grows some of the trees level by
level; grown trees are written as rows. The driver holds the importance per feature and nothing that grows with rows
or nodes. Scoring reads the stored trees in the tasks, a file at a time.

The rules are those of Spark's trainer: at most 32 bins a feature, cut in the same places (by all rows, where Spark takes
a sample of 10,000), a Poisson bootstrap per tree, a random subset of features per node, gini gain over weighted classes, and siblings that
predict the same class merged. A tree depends on the seed, its number and the stored matrix, not on the number of tasks.

Matrix and trees are read with `pyarrow.fs` from the folder of spark.checkpoint.dir, which must be a store it knows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark import constants as C
from cohortspark.operators.linear import csr
from cohortspark.session import discard, scratch_path, stored

#: Bins a feature has; features up to which rows are stored dense.
BINS, DENSE = 32, 1024
#: Values a task summarises at once, points a summary of a feature has at most.
AT_ONCE, POINTS = 1 << 21, 256
#: Histogram cells, stored entries and matrix cells that a task has in hand at once.
CELLS, ENTRIES, BLOCK = 1 << 21, 1 << 19, 1 << 24
#: Stored values up to which a task also keeps a sparse matrix by columns.
BY_COLUMNS = 1 << 26

SUMMARY = "feature int, points binary, counts binary"
CUTS = "feature int, cuts binary"
MATRIX = "n int, label binary, lengths binary, feature binary, bin binary"
TREE = "tree int, feature binary, cut binary, child binary, probability binary, used binary, importance binary"


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The Parquet files of a stored table, in the order of its partitions."""
    fs, root = pafs.FileSystem.from_uri(path)
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet")]
    return fs, sorted(found)


def _stored_rows(path: str, columns: Sequence[str] | None = None) -> Iterator[dict]:
    fs, names = _files(path)
    for name in names:
        with fs.open_input_file(name) as handle:
            file = pq.ParquetFile(handle)
            for batch in file.iter_batches(batch_size=8, columns=columns):
                yield from batch.to_pylist()


def _binary(rows: Sequence[Sequence], schema: str, names: Sequence[str]) -> pa.RecordBatch:
    kinds = [pa.int32() if f.split()[1] == "int" else pa.binary() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in names]
    arrays = [pa.array([v.tobytes() if isinstance(v, np.ndarray) else v for v in c], k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


# --- cuts -------------------------------------------------------------------


def _thinned(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most `POINTS` of the rising values, the counts of what is left out going to the next one kept."""
    if len(values) <= POINTS:
        return values, counts
    total = np.cumsum(counts)
    bucket = np.minimum(((total - counts) * (POINTS / total[-1])).astype(np.int64), POINTS - 1)
    last = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True])
    return values[last], np.diff(np.r_[0.0, total[last]])


def summary(index: np.ndarray, value: np.ndarray, weight: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(feature, rising distinct values, weight of each) of stored entries."""
    order = np.lexsort((value, index))
    index, value = index[order], value[order]
    first = np.flatnonzero(np.r_[True, (index[1:] != index[:-1]) | (value[1:] != value[:-1])])
    counts, index, value = np.add.reduceat(weight[order], first), index[first], value[first]
    start = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    return [(int(index[a]), *_thinned(value[a:b], counts[a:b])) for a, b in zip(start, np.r_[start[1:], len(index)])]


def cuts_of(values: np.ndarray, counts: np.ndarray, total: float, bins: int = BINS) -> np.ndarray:
    """Thresholds of a feature from its rising distinct values: all midpoints if these are few, else about even shares of the weight.

    `total` includes the rows with the value 0, which the values leave out.
    """
    zeros = total - counts.sum()
    if zeros > 1e-9 * total:
        at = np.searchsorted(values, 0.0)
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, zeros)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < bins:
        return middle
    upto, chosen, stride = np.cumsum(counts).tolist(), [], total / bins
    target = stride
    for i, middle_of in enumerate(middle.tolist()):
        if target >= total:
            break
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            chosen.append(middle_of)
            target += stride
    return np.array(chosen[: bins - 1])


def _stored_cuts(data: DataFrame, weights: np.ndarray, total: float, tasks: int) -> DataFrame:
    """(feature, cuts) of every feature that has another value than 0; the rows are weighted by class."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows, index, value = csr(batch, "x")
            other = value != 0
            held.append((index[other], value[other], weights[batch.column(1).to_numpy()][rows[other]]))
            size += len(held[-1][0])
            if size > AT_ONCE:
                yield _binary(summary(*map(np.concatenate, zip(*held))), SUMMARY, _names(SUMMARY))
                held, size = [], 0
        if size:
            yield _binary(summary(*map(np.concatenate, zip(*held))), SUMMARY, _names(SUMMARY))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(feature: int, parts: list[tuple[bytes, bytes]]) -> tuple:
            values = np.concatenate([np.frombuffer(p) for p, _ in parts])
            counts = np.concatenate([np.frombuffer(c) for _, c in parts])
            distinct, where = np.unique(values, return_inverse=True)
            return feature, cuts_of(distinct, np.bincount(where, counts), total)

        current, parts = None, []
        for batch in batches:
            done = []
            for feature, *part in zip(*(c.to_pylist() for c in batch.columns)):
                if feature != current and parts:
                    done.append(cut(current, parts))
                    parts = []
                current = feature
                parts.append(part)
            yield _binary(done, CUTS, _names(CUTS))
        if parts:
            yield _binary([cut(current, parts)], CUTS, _names(CUTS))

    summed = data.mapInArrow(summaries, SUMMARY).repartition(tasks, "feature").sortWithinPartitions("feature")
    return stored(summed.mapInArrow(merge, CUTS), "forest-cuts")


@dataclass
class _Cuts:
    """Thresholds by feature, padded with infinity; a value x is in the bin of the first threshold that is no less."""

    table: np.ndarray
    zero: np.ndarray

    @classmethod
    def read(cls, path: str, dim: int) -> "_Cuts":
        table = np.full((dim, BINS - 1), np.inf)
        for row in _stored_rows(path):
            cuts = np.frombuffer(row["cuts"])
            table[row["feature"], : len(cuts)] = cuts
        return cls(table, (table < 0).sum(axis=1).astype(np.uint8))

    def bins(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = np.zeros(len(index), np.int64)
        step = BINS // 2
        while step:
            at += step * (self.table[index, at + step - 1] < value)
            step //= 2
        return at.astype(np.uint8)

    def dense(self, n: int, rows: np.ndarray, index: np.ndarray, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.zero, (n, 1))
        out[rows, index] = bins
        return out


def _features(df: DataFrame, features: str) -> Column:
    """The vectors as structs; a missing one ends the job, as in Spark's trainer."""
    missing = F.raise_error(F.lit("vectors must not be NULL"))
    return F.when(F.col(features).isNotNull(), F.unwrap_udt(features)).otherwise(missing)


def vector_width(df: DataFrame, features: str) -> int:
    """The width of the first vector, 0 without any."""
    found = df.select(F.unwrap_udt(features).alias("x")).where("x IS NOT NULL").select(F.coalesce("x.size", F.size("x.values"))).first()
    return found[0] if found else 0


def _index_type(dim: int) -> type:
    return np.uint16 if dim <= 1 << 16 else np.int32


def _stored_matrix(data: DataFrame, cuts_path: str, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _Cuts.read(cuts_path, dim)
        for batch in batches:
            n, label = batch.num_rows, batch.column(1).to_numpy().astype(np.uint8)
            rows, index, value = csr(batch, "x")
            bins = cuts.bins(index, value)
            if dim <= DENSE:
                none = np.empty(0, np.uint8)
                yield _binary([(n, label, none, none, cuts.dense(n, rows, index, bins))], MATRIX, _names(MATRIX))
            else:
                other = bins != cuts.zero[index]
                lengths = np.bincount(rows[other], minlength=n).astype(np.int32)
                yield _binary([(n, label, lengths, index[other].astype(_index_type(dim)), bins[other])], MATRIX, _names(MATRIX))

    return stored(data.mapInArrow(run, MATRIX), "forest-matrix")


# --- one tree ---------------------------------------------------------------


class _Dense:
    """Rows with a bin for every feature."""

    def __init__(self, label: np.ndarray, bins: np.ndarray):
        self.n, self.dim, self.label, self.bins = len(label), bins.shape[1], label, bins

    def cells(self, rows, node, drawn, subset, total) -> Iterator[tuple]:
        """Blocks of (pair of node and place in its subset, bin, counts by class), rising, and how to find a row's bin."""
        nodes, k = subset.shape
        step = max(1, CELLS // (k * BINS * 2))
        for a in range(0, nodes, step):
            b = min(nodes, a + step)
            low, high = np.searchsorted(node, (a, b))
            part, own = rows[low:high], node[low:high]
            base, weight = ((own - a) * (BINS * 2)) + self.label[part], drawn[part].astype(np.float64)
            counts = np.empty((b - a, k, BINS, 2), np.int64)
            for j in range(k):
                at = base + self.bins[part, subset[own, j]].astype(np.int64) * 2
                counts[:, j] = np.bincount(at, weight, (b - a) * BINS * 2).reshape(b - a, BINS, 2)
            flat = counts.reshape(-1, 2)
            full = np.flatnonzero(flat.any(axis=1))
            yield a * k + full // BINS, full % BINS, flat[full], None

    def bins_of(self, rows, node, feature, pair, found) -> np.ndarray:
        return self.bins[rows, feature[node]]


class _Sparse:
    """Rows with a bin for every feature that is not in the bin of 0."""

    def __init__(self, label: np.ndarray, lengths: np.ndarray, feature: np.ndarray, bins: np.ndarray, zero: np.ndarray):
        self.n, self.dim, self.label, self.zero = len(label), len(zero), label, zero
        self.start = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
        self.feature, self.bins = feature, bins
        self.columns = None
        if len(feature) <= BY_COLUMNS:
            order = np.argsort(feature, kind="stable")
            owner = np.repeat(np.arange(self.n, dtype=np.int32), lengths)[order]
            self.columns = np.r_[0, np.cumsum(np.bincount(feature, minlength=self.dim))], owner, bins[order]
        self.slot = None

    @staticmethod
    def _ranges(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Blocks of ranges of about `ENTRIES` places: from, to, lengths, places."""
        lengths = end - start
        upto = np.cumsum(lengths)
        a = 0
        while a < len(start):
            before = upto[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(upto, before + ENTRIES, "right")))
            n = lengths[a:b]
            yield a, b, n, np.repeat(start[a:b] - (upto[a:b] - n - before), n) + np.arange(n.sum())
            a = b

    def _by_rows(self, rows, node, subset):
        nodes, k = subset.shape
        pairs, bins, found = [], [], []
        if self.slot is None:
            self.slot = np.full((max(1, BLOCK // self.dim), self.dim), -1, np.int16)
        for low in range(0, nodes, len(self.slot)):
            high = min(nodes, low + len(self.slot))
            first, last = np.searchsorted(node, (low, high))
            some, own, inside = rows[first:last], node[first:last], np.arange(high - low)[:, None]
            self.slot[inside, subset[low:high]] = np.arange(k, dtype=np.int16)
            for a, b, n, at in self._ranges(self.start[some], self.start[some + 1]):
                place = self.slot.ravel()[np.repeat((own[a:b] - low) * self.dim, n) + self.feature[at]]
                kept = np.flatnonzero(place >= 0)
                which = np.searchsorted(np.cumsum(n), kept, "right")
                pairs.append(own[a:b][which] * k + place[kept])
                bins.append(self.bins[at[kept]])
                found.append(some[a:b][which])
            self.slot[inside, subset[low:high]] = -1
        return pairs, bins, found

    def _by_columns(self, rows, node, subset):
        nodes, k = subset.shape
        start, owner, column_bins = self.columns
        at_node = np.full(self.n, -1, np.int32)
        at_node[rows] = node
        flat = subset.ravel()
        pairs, bins, found = [], [], []
        for a, b, n, at in self._ranges(start[flat], start[flat + 1]):
            pair, row = np.repeat(np.arange(a, b), n), owner[at]
            kept = np.flatnonzero(at_node[row] == pair // k)
            pairs.append(pair[kept])
            bins.append(column_bins[at[kept]])
            found.append(row[kept])
        return pairs, bins, found

    def cells(self, rows, node, drawn, subset, total) -> Iterator[tuple]:
        k = subset.shape[1]
        across = False
        if self.columns is not None:
            start = self.columns[0]
            across = (start[subset + 1] - start[subset]).sum() < (self.start[rows + 1] - self.start[rows]).sum()
        parts = (self._by_columns if across else self._by_rows)(rows, node, subset)
        pair, bins, found = (np.concatenate(p) for p in parts)
        if not len(pair):
            return
        key, where = np.unique(pair * BINS + bins, return_inverse=True)
        counts = np.bincount(where * 2 + self.label[found], drawn[found].astype(np.float64), len(key) * 2).astype(np.int64).reshape(-1, 2)
        owner = key // BINS
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rest = total[owner[first] // k] - np.add.reduceat(counts, first)
        zero = owner[first] * BINS + self.zero[subset.ravel()[owner[first]]]
        some = rest.any(axis=1)
        key, counts = np.r_[key, zero[some]], np.r_[counts, rest[some]]
        order = np.argsort(key)
        key = key[order]
        yield key // BINS, key % BINS, counts[order], (pair, bins, found)

    def bins_of(self, rows, node, feature, pair, found) -> np.ndarray:
        """The bin of every row for the feature its node is split by; `pair` is that of node and feature."""
        at = np.zeros(self.n, np.uint8)
        at[rows] = self.zero[feature[node]]
        pairs, bins, of = found
        chosen = pairs == pair[pairs // self.k]
        at[of[chosen]] = bins[chosen]
        return at[rows]


def _gini(counts: np.ndarray) -> np.ndarray:
    share = counts / counts.sum(axis=1, keepdims=True)
    return 1.0 - (share * share).sum(axis=1)


def best_splits(pair: np.ndarray, bins: np.ndarray, counts: np.ndarray, total: np.ndarray, k: int, weights: np.ndarray) -> tuple:
    """(node, pair, bin, gain) of the best split of every node that gains by one; ties go to the first pair and bin."""
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    left = np.cumsum(counts, axis=0)
    left -= np.repeat(left[first] - counts[first], np.diff(np.r_[first, len(pair)]), axis=0)
    whole = total[pair // k]
    right = whole - left
    open_ = np.flatnonzero(right.any(axis=1))
    pair, bins, left, right, whole = pair[open_], bins[open_], left[open_] * weights, right[open_] * weights, whole[open_] * weights
    share = left.sum(axis=1) / whole.sum(axis=1)
    gain = _gini(whole) - share * _gini(left) - (1.0 - share) * _gini(right)
    node = pair // k
    if not len(node):
        return node, pair, bins, gain
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    most = np.repeat(np.maximum.reduceat(gain, start), np.diff(np.r_[start, len(node)]))
    best = np.flatnonzero((gain == most) & (gain > 0))
    best = best[np.r_[True, node[best][1:] != node[best][:-1]]] if len(best) else best
    return node[best], pair[best], bins[best], gain[best]


def subsets(rng: np.random.Generator, nodes: int, dim: int, k: int) -> np.ndarray:
    """For every node k of the features, each set as likely as any other."""
    if dim <= DENSE:
        return np.argpartition(rng.random((nodes, dim)), k - 1, axis=1)[:, :k] if k < dim else np.tile(np.arange(dim), (nodes, 1))
    spare = k + 8 * math.ceil(k * k / dim) + 16
    drawn = rng.integers(0, dim, (nodes, spare))
    order = np.argsort(drawn, axis=1, kind="stable")
    value = np.take_along_axis(drawn, order, 1)
    again = np.zeros_like(drawn, dtype=bool)
    np.put_along_axis(again, order[:, 1:], value[:, 1:] == value[:, :-1], 1)
    fresh = np.argsort(again, axis=1, kind="stable")[:, :k]  # first draws first, in their order
    out = np.take_along_axis(drawn, fresh, 1)
    for i in np.flatnonzero(np.take_along_axis(again, fresh, 1).any(axis=1)):
        out[i] = rng.permutation(dim)[:k]
    return out


def grow(data, weights: np.ndarray, seed: int, tree: int, max_depth: int) -> tuple[np.ndarray, ...]:
    """(feature or -1, bin, left child, probability) by node, then the features used and what each gains.

    The right child is the node after the left one.
    """
    rng = np.random.default_rng([seed, tree])
    k = math.ceil(math.sqrt(data.dim))
    data.k = k
    drawn = rng.poisson(1.0, data.n).astype(np.int32)
    rows = np.flatnonzero(drawn)
    total = np.bincount(data.label[rows], drawn[rows], 2).astype(np.int64)[None]
    node, trying = np.zeros(len(rows), np.int64), np.arange(1)[total.all(axis=1)]
    if not len(trying):
        rows, node = rows[:0], node[:0]
    levels, depth = [], 0
    while True:
        level = {"feature": np.full(len(total), -1, np.int32), "cut": np.zeros(len(total), np.uint8)}
        level |= {"child": np.zeros(len(total), np.int32), "counts": total, "gain": np.zeros(len(total))}
        levels.append(level)
        if depth == max_depth or not len(trying):
            break
        subset, own = subsets(rng, len(trying), data.dim, k), total[trying]
        blocks, found = [], None
        for pair, bins, counts, entries in data.cells(rows, node, drawn, subset, own):
            blocks.append(best_splits(pair, bins, counts, own, k, weights))
            found = entries
        if not blocks or not sum(len(b[0]) for b in blocks):
            break
        at, pair, cut, gain = (np.concatenate(part) for part in zip(*blocks))
        split = np.full(len(trying), -1)
        split[at] = np.arange(len(at))
        feature, by_node = np.zeros(len(trying), np.int64), np.full(len(trying), -1, np.int64)
        feature[at], by_node[at] = subset.ravel()[pair], pair
        level["feature"][trying[at]], level["cut"][trying[at]] = feature[at], cut
        level["child"][trying[at]], level["gain"][trying[at]] = 2 * np.arange(len(at)), gain
        going = split[node] >= 0
        own_bins = data.bins_of(rows, node, feature, by_node, found)
        rows, node, own_bins = rows[going], node[going], own_bins[going]
        child = 2 * split[node] + (own_bins > cut[split[node]])
        total = np.bincount(child * 2 + data.label[rows], drawn[rows], 4 * len(at)).astype(np.int64).reshape(-1, 2)
        trying = np.flatnonzero(total.all(axis=1))
        number = np.full(len(total), -1)
        number[trying] = np.arange(len(trying))
        node = number[child]
        mixed = np.flatnonzero(node >= 0)
        mixed = mixed[np.argsort(node[mixed], kind="stable")]
        rows, node = rows[mixed], node[mixed]
        depth += 1
    return _pruned(levels, weights, data.dim)


def _pruned(levels: list[dict[str, np.ndarray]], weights: np.ndarray, dim: int) -> tuple[np.ndarray, ...]:
    """The nodes of all levels behind each other, siblings that predict the same class merged."""
    sizes = [len(level["feature"]) for level in levels]
    for level in levels:
        level["class"] = (level["counts"] * weights).argmax(axis=1)
    for level, below in zip(levels[-2::-1], levels[:0:-1]):
        inner = np.flatnonzero(level["feature"] >= 0)
        left = level["child"][inner]
        leaves = (below["feature"][left] < 0) & (below["feature"][left + 1] < 0)
        same = inner[leaves & (below["class"][left] == below["class"][left + 1])]
        level["feature"][same] = -1
    alive = [np.ones(1, bool)]
    for level, size in zip(levels, sizes[1:]):
        reached = np.zeros(size, bool)
        left = level["child"][alive[-1] & (level["feature"] >= 0)]
        reached[left] = reached[left + 1] = True
        alive.append(reached)
    place = np.cumsum(np.concatenate(alive)) - 1
    first = np.r_[0, np.cumsum(sizes)]
    for i, level in enumerate(levels[:-1]):
        inner = level["feature"] >= 0
        level["child"][inner] = place[first[i + 1] + level["child"][inner]]
    kept = np.concatenate(alive)
    feature, cut, child, counts, gain = (np.concatenate([level[c] for level in levels])[kept] for c in ("feature", "cut", "child", "counts", "gain"))
    weighted = counts * weights
    inner = feature >= 0
    importance = np.bincount(feature[inner], gain[inner] * weighted[inner].sum(axis=1), dim)
    used = np.flatnonzero(importance).astype(np.int32)
    size = weighted.sum(axis=1)
    probability = np.divide(weighted[:, 1], size, out=np.zeros(len(size)), where=size > 0)  # a bootstrap may be empty
    return feature, cut, child, probability, used, importance[used] / max(importance.sum(), 1e-300)


def _read_matrix(path: str, cuts_path: str, dim: int) -> _Dense | _Sparse:
    label, lengths, feature, bins = [], [], [], []
    for row in _stored_rows(path):
        label.append(np.frombuffer(row["label"], np.uint8))
        lengths.append(np.frombuffer(row["lengths"], np.int32))
        feature.append(np.frombuffer(row["feature"], _index_type(dim)))
        bins.append(np.frombuffer(row["bin"], np.uint8))
    label, bins = np.concatenate(label), np.concatenate(bins)
    if dim <= DENSE:
        return _Dense(label, bins.reshape(len(label), dim))
    return _Sparse(label, np.concatenate(lengths), np.concatenate(feature), bins, _Cuts.read(cuts_path, dim).zero)


# --- the forest --------------------------------------------------------------


@dataclass(frozen=True)
class StoredForest:
    """Trees as rows of a table below `path`, beside the cuts of their features."""

    path: str
    numFeatures: int
    num_trees: int
    featureImportances: np.ndarray

    def transform(self, df: DataFrame, features: str = "features", probability: str = "probability") -> DataFrame:
        """Replace the features by the mean probability of the trees."""
        path, dim, trees = self.path, self.numFeatures, self.num_trees
        kept = [c for c in df.columns if c != features]

        def scored(batches: list[pa.RecordBatch], cuts: _Cuts) -> Iterator[pa.RecordBatch]:
            bins = [cuts.dense(b.num_rows, rows, index, cuts.bins(index, value)) for b in batches for rows, index, value in [csr(b, "_unwrapped")]]
            sums = walked(np.concatenate(bins), _stored_rows(f"{path}/trees", ["feature", "cut", "child", "probability"])) / trees
            for batch in batches:
                arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(sums[: batch.num_rows])]
                sums = sums[batch.num_rows :]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, probability])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts, held, rows = _Cuts.read(f"{path}/cuts", dim), [], 0
            for whole in batches:
                for at in range(0, whole.num_rows, max(1, BLOCK // dim)):
                    held.append(whole.slice(at, max(1, BLOCK // dim)))
                    rows += held[-1].num_rows
                    if rows * dim >= BLOCK:
                        yield from scored(held, cuts)
                        held, rows = [], 0
            if rows:
                yield from scored(held, cuts)

        schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(probability, T.DoubleType())])
        return df.select(*kept, _features(df, features).alias("_unwrapped")).mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        for part in ("trees", "cuts"):
            spark.read.parquet(f"{self.path}/{part}").write.mode("overwrite").parquet(f"{path}/{part}")
        rows = [(i, float(v)) for i, v in enumerate(self.featureImportances)] + [(-1, float(self.num_trees))]
        spark.createDataFrame(rows, "feature int, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/importance")

    @classmethod
    def load(cls, path: str) -> "StoredForest":
        rows = {r.feature: r.value for r in SparkSession.getActiveSession().read.parquet(f"{path}/importance").collect()}
        trees = int(rows.pop(-1))
        return cls(path, len(rows), trees, np.array([rows[i] for i in range(len(rows))]))


def walked(bins: np.ndarray, trees: Iterator[Mapping]) -> np.ndarray:
    """Per row of bins the sum of the probabilities of the leaves it comes to."""
    sums = np.zeros(len(bins))
    for tree in trees:
        feature, cut = np.frombuffer(tree["feature"], np.int32), np.frombuffer(tree["cut"], np.uint8)
        child, probability = np.frombuffer(tree["child"], np.int32), np.frombuffer(tree["probability"])
        at, going = np.zeros(len(bins), np.int32), np.arange(len(bins))
        while len(going):
            node = at[going]
            inner = feature[node] >= 0
            going, node = going[inner], node[inner]
            at[going] = child[node] + (bins[going, feature[node]] > cut[node])
        sums += probability[at]
    return sums


def fit_stored_forest(
    train: DataFrame,
    weights: Mapping[int, float],
    n_rows: int,
    label: str = "label",
    features: str = "features",
    num_trees: int = 300,
    max_depth: int = 30,
    seed: int = C.SEED,
) -> StoredForest:
    """A forest over rows with labels 0 and 1, weighted by class."""
    if not set(weights) <= {0, 1}:
        raise ValueError(f"{label} must be 0 or 1")
    spark = train.sparkSession
    context, path = spark.sparkContext, scratch_path(spark, "forest")
    tasks = context.defaultParallelism
    dim = vector_width(train, features)
    data = train.select(_features(train, features).alias("x"), F.col(label).cast("int").alias("y"))
    by_class = np.array([float(weights.get(c, 1.0)) for c in (0, 1)])
    cuts = _stored_cuts(data, by_class, float(n_rows), tasks)  # balanced weights add up to the number of rows
    cuts_path = cuts._stored_at
    matrix = _stored_matrix(data, cuts_path, dim)
    matrix_path = matrix._stored_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                rows = rows or _read_matrix(matrix_path, cuts_path, dim)
                yield _binary([(tree, *grow(rows, by_class, seed, tree, max_depth))], TREE, _names(TREE))

    # several tasks a core, so that a slow one is not waited for; each reads the matrix once
    numbers = spark.range(0, num_trees, 1, min(num_trees, 3 * tasks)).select(F.col("id").cast("int").alias("tree"))
    numbers.mapInArrow(run, TREE).write.parquet(f"{path}/trees")
    cuts.write.parquet(f"{path}/cuts")
    discard(matrix, cuts)
    importance = _importance(spark.read.parquet(f"{path}/trees").select("used", "importance"), dim)
    return StoredForest(path, dim, num_trees, importance)


def _importance(trees: DataFrame, dim: int) -> np.ndarray:
    """Every tree's gains add up to one, and so do those of the forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(dim)
        for batch in batches:
            for used, gains in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[np.frombuffer(used, np.int32)] += np.frombuffer(gains)
        at = np.flatnonzero(sums).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["feature", "gain"])

    out = np.zeros(dim)
    for row in trees.mapInArrow(run, "feature int, gain double").groupBy("feature").agg(F.sum("gain").alias("gain")).collect():  # one a feature
        out[row.feature] = row.gain
    return out / max(out.sum(), 1e-300)
