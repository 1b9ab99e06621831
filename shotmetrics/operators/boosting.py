"""Second-order histogram boosting of logistic loss, with histograms merged over Spark tasks.

Features are cut into at most `bins` bins once (edges from approximate
quantiles of all rows). Rows with equal bins stand at the same node of every
tree and have the same margin, so they are held as one cell with its labels
and the row hashes under each; a round adds a cell's drawn rows at once. The
rows are dealt by range of (bins, label, row), so a cell lies in one task
unless it is larger than a task's share, and are written to the shared
checkpoint folder.

Trees grow level by level: gradient and curvature are added per (node,
feature, bin) over the rows at the nodes being split, as fixed-point
integers, so the totals do not depend on how rows are dealt or in which order
they are added; only the smaller child of a split is counted and its sibling
is the parent minus it. With many cells every level is one Spark job: tasks
add their cells and a grouped sum merges them, and margins are written every
CHECKPOINT_EVERY trees. With at most LOCAL_FIT_CELLS cells, whatever the
number of rows, all tasks count the drawn rows of each cell, label and round,
and one task grows the trees over these counts: both ways add the same
integers, so they give the same trees.

A split maximises GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l) with both children
holding a curvature sum of at least `min_child_weight`; a leaf adds
-rate * G / (H + l) to the margin. Rows of a round are drawn by a hash of
(seed, round, row), the features of a tree by a hash of (seed, round,
feature), so a draw is the same on any machine. What reaches the driver per
level is bounded by nodes x features x bins, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .lineage import checkpointed, written

# Gradients and curvatures are summed as integers in units of 2^-SCALE_BITS.
SCALE_BITS = 24
# Fits of at most so many cells grow all trees in one task: a job per level would cost more than the work.
LOCAL_FIT_CELLS = 100_000
# Rows a task turns into cells at a time, and rounds whose drawn rows are counted into one record.
TASK_ROWS = 500_000
COUNTED_ROUNDS = 25
# When levels are jobs over all tasks, margins are written out after so many trees.
CHECKPOINT_EVERY = 10
# Rows whose trees are walked together: their bins and nodes stay in the processor's cache.
WALKED_ROWS = 4096
# Scores a task keeps, by the bins of the row; further ones are computed each time.
KEPT_SCORES = 1 << 20


def _draw(*parts) -> float:
    """A number in [0, 1) from a hash of the parts, equal on every machine."""
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13


def bin_edges(rows: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """Sorted distinct cut values per column from approximate quantiles; one job over all columns."""
    probs = [i / bins for i in range(1, bins)]
    return [sorted(set(q)) for q in rows.approxQuantile(columns, probs, 1e-3)]


def binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin of each value: the number of cut values at or below it; NaN goes to bin 0."""
    out = np.zeros(values.shape, dtype=np.int32)
    for f, cuts in enumerate(edges):
        column = np.nan_to_num(values[:, f], nan=-np.inf)
        out[:, f] = np.searchsorted(np.asarray(cuts, dtype=np.float64), column, side="right")
    return out


class Tree:
    """A tree in heap order: node i has children 2i+1 and 2i+2; feature -1 marks a leaf."""

    def __init__(self, depth: int) -> None:
        size = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full(size, -1, dtype=np.int64)
        self.threshold = np.zeros(size, dtype=np.int64)
        self.value = np.zeros(size, dtype=np.float64)

    def below(self, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The nodes one level down; a leaf stays."""
        f = self.feature[node]
        left = bins[np.arange(len(bins)), np.maximum(f, 0)] <= self.threshold[node]
        return np.where(f >= 0, np.where(left, 2 * node + 1, 2 * node + 2), node)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        node = np.zeros(len(bins), dtype=np.int64)
        for _ in range(levels):
            node = self.below(bins, node)
        return node

    def completed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, thresholds and values of the same tree with every leaf at the last level: an early leaf goes left all the way."""
        feature, threshold, value = np.maximum(self.feature, 0), self.threshold.copy(), self.value.copy()
        for node in range(2**self.depth - 1):
            if self.feature[node] < 0:
                threshold[node] = np.iinfo(np.int64).max
                value[2 * node + 1] = value[node]
        return feature, threshold, value

    def as_dict(self) -> dict:
        used = np.flatnonzero((self.feature >= 0) | (self.value != 0))
        return {
            "nodes": used.tolist(),
            "feature": self.feature[used].tolist(),
            "threshold": self.threshold[used].tolist(),
            "value": self.value[used].tolist(),
        }

    @classmethod
    def from_dict(cls, d: dict, depth: int) -> Tree:
        t = cls(depth)
        idx = np.asarray(d["nodes"], dtype=np.int64)
        t.feature[idx], t.threshold[idx], t.value[idx] = d["feature"], d["threshold"], d["value"]
        return t


def margins(bins: np.ndarray, trees: list[Tree], depth: int, base: float) -> np.ndarray:
    """The base and the trees' values added in their order, a few thousand rows at a time."""
    out = np.full(len(bins), base)
    full = [t.completed() for t in trees]
    n_features = bins.shape[1]
    for at in range(0, len(bins), WALKED_ROWS):
        part = out[at : at + WALKED_ROWS]
        flat = np.ascontiguousarray(bins[at : at + WALKED_ROWS]).ravel()
        starts = np.arange(len(part)) * n_features
        for feature, threshold, value in full:
            node = np.zeros(len(part), dtype=np.int64)
            for _ in range(depth):
                right = flat.take(starts + feature.take(node)) > threshold.take(node)
                node = 2 * node + 1 + right
            part += value.take(node)
    return out


class Scorer:
    """Probabilities of batches of rows; rows with equal bins have one score, computed once and kept.

    The bins of a row are one number, exact as long as all combinations fit a
    long; with more, every row is walked.
    """

    def __init__(self, edges: list[list[float]], trees: list[Tree], depth: int, base: float) -> None:
        self.edges, self.trees, self.depth, self.base = edges, trees, depth, base
        sizes = [len(cuts) + 1 for cuts in edges]
        self.steps = np.array([math.prod(sizes[f + 1 :]) for f in range(len(sizes))]) if edges and math.prod(sizes) < 1 << 63 else None
        self.codes, self.scores = np.empty(0, np.int64), np.empty(0)

    def walked(self, bins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-margins(bins, self.trees, self.depth, self.base)))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.edges)
        if self.steps is None:
            return self.walked(bins)
        distinct, first, back = np.unique(bins.astype(np.int64) @ self.steps, return_index=True, return_inverse=True)
        at = np.searchsorted(self.codes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == distinct[inside]
        scores = np.empty(len(distinct))
        scores[known] = self.scores[at[known]]
        scores[~known] = self.walked(bins[first[~known]])
        if len(self.codes) + np.count_nonzero(~known) <= KEPT_SCORES:
            self.codes = np.insert(self.codes, at[~known], distinct[~known])
            self.scores = np.insert(self.scores, at[~known], scores[~known])
        return scores[back]


def row_draw(rid: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """A 32-bit number per row and round from a multiplicative hash of (seed, round, row)."""
    salt = np.uint64((seed * 1_000_003 + round_) * 0x9E3779B97F4A7C15 % 2**64)
    with np.errstate(over="ignore"):
        mixed = (rid.astype(np.int64).view(np.uint64) ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)).astype(np.int64)


def bin_type(n_bins: int) -> np.dtype:
    """The least unsigned type that holds a bin."""
    return np.min_scalar_type(n_bins - 1)


class Cells:
    """Rows with equal bins as one cell; the rows of a cell with equal label are a group.

    `bins` and `margin` are of the cells, `cell`, `label` and `rows` (their
    number) of the groups. `rid` holds the hashes of the rows, group by group.
    """

    def __init__(self, bins: np.ndarray, cell: np.ndarray, label: np.ndarray, rows: np.ndarray, rid: np.ndarray, margin: np.ndarray) -> None:
        self.bins, self.cell, self.label, self.rows, self.rid, self.margin = bins, cell, label, rows, rid, margin
        self.group = np.repeat(np.arange(len(rows)), rows)

    @classmethod
    def of_rows(cls, packed: pa.Array, dtype: np.dtype, y: np.ndarray, rid: np.ndarray, base: float) -> Cells:
        """Cells of rows whose bins are given as bytes."""
        cells, code = distinct_cells(packed, dtype)
        labels, kind = np.unique(y, return_inverse=True)
        found, group = np.unique(code * len(labels) + kind, return_inverse=True)
        order = np.argsort(group, kind="stable")
        cell, label = found // len(labels), labels[found % len(labels)]
        return cls(cells, cell, label, np.bincount(group, minlength=len(found)), rid[order], np.full(len(cells), base))

    def drawn(self, seed: int, round_: int, row_share: float) -> np.ndarray:
        """Rows of each group that the round draws; each row is drawn on its own."""
        out = np.flatnonzero(row_draw(self.rid, seed, round_) >= int(row_share * 2**32))
        return self.rows - np.bincount(self.group[out], minlength=len(self.rows))


def distinct_cells(packed: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bins [cells, features] among equally long bytes, and each one's place among them."""
    coded = packed.dictionary_encode()
    found = coded.dictionary.to_pylist()
    return np.frombuffer(b"".join(found), dtype).reshape(len(found), -1), coded.indices.to_numpy().astype(np.int64)


def packed_bins(bins: np.ndarray) -> pa.Array:
    """One run of bytes a row."""
    return pa.Array.from_buffers(pa.binary(bins.shape[1] * bins.itemsize), len(bins), [None, pa.py_buffer(np.ascontiguousarray(bins))])


def addends(values: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole numbers as doubles and the bits to shift their sums by; in parts where a double could not hold a sum."""
    if np.abs(values).sum() < 2**53:
        return [(values.astype(np.float64), 0)]
    high = [(part, shift + SCALE_BITS) for part, shift in addends(values >> SCALE_BITS)]
    return [*high, *addends(values & (2**SCALE_BITS - 1))]


def exact_bincount(index: np.ndarray, parts: list[tuple[np.ndarray, int]], size: int) -> np.ndarray:
    """Sums of the numbers by index."""
    return sum(np.bincount(index, weights=part, minlength=size).astype(np.int64) << shift for part, shift in parts)


def local_sums(cells: Cells, drawn: np.ndarray) -> np.ndarray:
    """Integer sums [3 (g, h, rows), cells] over the drawn rows: those of a row, times the rows that share them."""
    p = 1.0 / (1.0 + np.exp(-cells.margin))
    g = np.rint((p[cells.cell] - cells.label) * 2**SCALE_BITS).astype(np.int64)
    n = exact_bincount(cells.cell, addends(drawn), len(p))
    h = np.rint(p * (1 - p) * 2**SCALE_BITS).astype(np.int64)
    return np.stack([exact_bincount(cells.cell, addends(drawn * g), len(p)), n * h, n])


def local_histograms(bins: np.ndarray, node: np.ndarray, sums: np.ndarray, nodes: int, wanted: list[int], n_bins: int) -> np.ndarray:
    """Integer sums [3 (g, h, rows), wanted nodes, features, bins] over the cells at the wanted of so many nodes."""
    n_features = bins.shape[1]
    total = np.zeros((3, len(wanted), n_features, n_bins), dtype=np.int64)
    lookup = np.full(nodes, -1, dtype=np.int64)
    lookup[wanted] = np.arange(len(wanted))
    slot = lookup[node]
    keep = np.flatnonzero((slot >= 0) & (sums[2] > 0))
    if len(keep):
        at, parts = slot[keep] * n_bins, [addends(row) for row in sums[:, keep]]
        for f, column in enumerate(np.ascontiguousarray(bins[keep].T)):
            index = at + column
            for k in range(3):
                total[k, :, f] = exact_bincount(index, parts[k], len(wanted) * n_bins).reshape(-1, n_bins)
    return total


def best_split(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, lam: float, min_child_weight: float):
    """(gain, feature, threshold) of the best split of one node's histograms [features x bins], or None.

    Ties go to the smaller feature, then the smaller threshold.
    """
    G, H = g[0].sum(), h[0].sum()
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gr, hr = G - gl, H - hl
    gain = gl**2 / (hl + lam) + gr**2 / (hr + lam) - G**2 / (H + lam)
    ok = (hl >= min_child_weight) & (hr >= min_child_weight) & allowed[:, None]
    gain = np.where(ok, gain, -np.inf)
    if gain.size == 0 or not np.isfinite(gain.max()) or gain.max() <= 0:
        return None
    f, t = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[f, t]), int(f), int(t)


def grow(merged_histograms, n_features: int, n_bins: int, allowed: np.ndarray, depth: int, rate: float, lam: float,
         min_child_weight: float) -> Tree:
    """One tree, level by level; merged_histograms(tree, level, wanted) gives the integer sums of all rows.

    Only the smaller child of each split is asked for; the other is the
    parent minus it. The children of the last level are leaves whose sums
    come from their parent's split.
    """
    scale = float(2**SCALE_BITS)
    tree = Tree(depth)
    parents: dict[int, tuple] = {}
    wanted, derived = [0], {}
    for level in range(depth):
        found = merged_histograms(tree, level, wanted)
        hist = {node: tuple(found[:, i]) for i, node in enumerate(wanted)}
        for node, (parent, sibling) in derived.items():
            hist[node] = tuple(a - b for a, b in zip(parents[parent], hist[sibling], strict=True))
        wanted, derived, parents = [], {}, {}
        for node in sorted(hist):
            g, h, n = hist[node]
            split = best_split(g / scale, h / scale, allowed, lam, min_child_weight)
            if split is None:
                tree.value[node] = -rate * (g[0].sum() / scale) / (h[0].sum() / scale + lam)
                continue
            _, f, t = split
            tree.feature[node], tree.threshold[node] = f, t
            left, right = 2 * node + 1, 2 * node + 2
            n_left = n[f, : t + 1].sum()
            small, big = (left, right) if n_left <= n[f].sum() - n_left else (right, left)
            wanted.append(small)
            derived[big] = (node, small)
            parents[node] = (g, h, n)
        if not wanted:
            break
        if level == depth - 1:
            for node, (g, h, _) in parents.items():
                f, t = tree.feature[node], tree.threshold[node]
                gl, hl = g[f, : t + 1].sum() / scale, h[f, : t + 1].sum() / scale
                G, H = g[f].sum() / scale, h[f].sum() / scale
                tree.value[2 * node + 1] = -rate * gl / (hl + lam)
                tree.value[2 * node + 2] = -rate * (G - gl) / (H - hl + lam)
    return tree


def columns_of_round(n_features: int, share: float, seed: int, round_: int) -> np.ndarray:
    """The features a tree may split on: the round(share * n) of least hash of (seed, round, feature)."""
    take = max(1, int(round(share * n_features)))
    order = sorted(range(n_features), key=lambda f: _draw(seed, "column", round_, f))
    allowed = np.zeros(n_features, dtype=bool)
    allowed[order[:take]] = True
    return allowed


def boost(bins: np.ndarray, y: np.ndarray, rid: np.ndarray, base: float, merge, n_bins: int, rounds: int, depth: int,
          rate: float, lam: float, min_child_weight: float, row_share: float, column_share: float, seed: int) -> list[Tree]:
    """All rounds over this task's rows; merge(local sums) returns the sums over all tasks."""
    bins = bins.astype(bin_type(n_bins))
    cells = Cells.of_rows(packed_bins(bins), bins.dtype, y, rid, base)
    drawn = (cells.drawn(seed, r, row_share) for r in range(rounds))
    return boost_cells(cells, drawn, merge, n_bins, depth, rate, lam, min_child_weight, column_share, seed)


def boost_cells(cells: Cells, drawn: Iterator[np.ndarray], merge: Callable, n_bins: int, depth: int, rate: float, lam: float,
                min_child_weight: float, column_share: float, seed: int) -> list[Tree]:
    """A round for each of the given drawn rows by group; merge(local sums) returns the sums over all tasks."""
    bins, n_features = cells.bins, cells.bins.shape[1]
    trees = []
    for r, rows in enumerate(drawn):
        allowed = columns_of_round(n_features, column_share, seed, r)
        sums = local_sums(cells, rows)
        node = np.zeros(len(bins), dtype=np.int64)

        def merged(tree, level, wanted, sums=sums):
            nonlocal node
            node = tree.below(bins, node) if level else node
            return merge(local_histograms(bins, node, sums, len(tree.feature), wanted, n_bins))

        tree = grow(merged, n_features, n_bins, allowed, depth, rate, lam, min_child_weight)
        cells.margin = cells.margin + tree.value[tree.below(bins, node)]
        trees.append(tree)
    return trees


class HistogramBoostModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Scores `features` into `probability` ([1 - p, p]) with the stored trees; saved as JSON in a param."""

    spec = Param(Params._dummy(), "spec", "trees and bin edges as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, spec: str = "{}") -> None:
        super().__init__()
        self._setDefault(spec="{}")
        self._set(spec=spec)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spec = json.loads(self.getOrDefault(self.spec))
        edges, depth, base = spec["edges"], spec["depth"], spec["base"]
        trees = [Tree.from_dict(t, depth) for t in spec["trees"]]

        @arrow_udf("double")
        def p_make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            score = Scorer(edges, trees, depth, base)
            for x in batches:
                values = x.flatten().to_numpy(zero_copy_only=False)
                yield pa.array(score(values.reshape(len(x), -1)) if len(x) else [], pa.float64())

        p = p_make(vector_to_array("features"))
        return dataset.withColumn("probability", array_to_vector(F.array(1 - p, p)))


def fit(
    frame: DataFrame,
    rounds: int,
    depth: int,
    rate: float,
    lam: float = 1.0,
    min_child_weight: float = 2.0,
    row_share: float = 0.9,
    column_share: float = 0.9,
    bins: int = 64,
    seed: int = 42,
    parts: int | None = None,
    key: str | None = None,
    local_rows: int = LOCAL_FIT_CELLS,
) -> HistogramBoostModel:
    """Trees on (features, label), and `key` if given, a column naming each row.

    All rows are fitted. A row's draws follow a hash of its key (else of its
    features and label), so the trees do not depend on how the input is split
    into tasks. The base margin is the log-odds of the mean label. An empty
    frame gives a model of the base rate 0.5 without trees. At most
    `local_rows` cells are grown in one task.
    """
    spark = frame.sparkSession
    first = frame.select("features").first()
    n_features = len(first[0]) if first else 0
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if n_features == 0:
        spec = {"edges": [], "depth": depth, "base": 0.0, "trees": []}
        return HistogramBoostModel(json.dumps(spec))
    rid = F.xxhash64(F.col(key)) if key else F.xxhash64(vector_to_array("features"), F.col("label"))
    columns = [f"x{i}" for i in range(n_features)]
    x = frame.select(rid.alias("rid"), F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
    rows = written(x.select("rid", "label", *[F.col("x")[i].alias(c) for i, c in enumerate(columns)]))
    edges = bin_edges(rows, columns, bins)
    n_bins = max(len(e) for e in edges) + 1
    stats = rows.agg(F.avg("label").alias("rate"), F.count(F.lit(1)).alias("n")).first()
    rate_ = min(max(stats["rate"], 1e-6), 1 - 1e-6)
    base = float(np.log(rate_ / (1 - rate_)))
    coded = written(rows.mapInArrow(_with_bins(columns, edges, bin_type(n_bins)), "rid long, label double, bins binary"))
    dealt = coded.repartitionByRange(max(parts, -(-stats["n"] // TASK_ROWS)), "bins", "label", "rid")
    state = checkpointed(dealt.mapInArrow(_as_cells(bin_type(n_bins), base), _CELLS))
    settings = (n_features, n_bins, rounds, depth, rate, lam, min_child_weight, row_share, column_share, seed)
    if state.agg(F.sum("n_cells")).first()[0] <= local_rows:
        trees = _boost_in_one_task(state, base, settings)
    else:
        trees = _boost_over_tasks(state, settings)
    spec = {"edges": edges, "depth": depth, "base": base, "trees": [t.as_dict() for t in trees]}
    return HistogramBoostModel(json.dumps(spec))


def _with_bins(columns: list[str], edges: list[list[float]], dtype: np.dtype):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in columns])
                packed = packed_bins(binned(values, edges).astype(dtype)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch["rid"], batch["label"], packed], names=["rid", "label", "bins"])

    return add


# Cells of some rows as one record: the arrays' bytes.
_CELLS = "chunk long, n_cells long, bins binary, cell binary, label binary, rows binary, rid binary, margin binary"


def _as_record(chunk: int, cells: Cells) -> pa.RecordBatch:
    arrays = {k: [np.ascontiguousarray(getattr(cells, k)).tobytes()] for k in ("bins", "cell", "label", "rows", "rid", "margin")}
    return pa.RecordBatch.from_pydict({"chunk": [chunk], "n_cells": [len(cells.bins)], **arrays})


def _as_cells(dtype: np.dtype, base: float):
    """Collapses the rows of a task, so many at a time."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, n = TaskContext.get().partitionId() << 32, [], 0

        def record() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            packed, y, rid = (table[c].chunk(0) for c in ("bins", "label", "rid"))
            return _as_record(chunk, Cells.of_rows(packed, dtype, y.to_numpy(zero_copy_only=False), rid.to_numpy(), base))

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 2 * TASK_ROWS:
                yield record()
                chunk, held, n = chunk + 1, [], 0
        if n:
            yield record()

    return collapse


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch[name][i].as_py() for name in batch.schema.names}


def _cells_of(record: dict, n_features: int, dtype: np.dtype) -> Cells:
    long = [np.frombuffer(record[k], np.int64) for k in ("cell", "rows", "rid")]
    label, margin = (np.frombuffer(record[k], np.float64) for k in ("label", "margin"))
    return Cells(np.frombuffer(record["bins"], dtype).reshape(-1, n_features), long[0], label, long[1], long[2], margin)


def _boost_in_one_task(state: DataFrame, base: float, settings: tuple) -> list[Tree]:
    """All tasks count the drawn rows of their groups by round; one task grows the trees over the cells.

    It reads the counts in order of the rounds and holds COUNTED_ROUNDS of
    them. A cell that was dealt to several tasks becomes one again.
    """
    n_features, n_bins, rounds, depth, rate, lam, min_child_weight, row_share, column_share, seed = settings
    dtype = bin_type(n_bins)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in _records(batches):
            cells = _cells_of(record, n_features, dtype)
            yield pa.RecordBatch.from_pydict({"start": [-1], "chunk": [record["chunk"]], **{k: [record[k]] for k in ("bins", "cell", "label")}, "drawn": [b""]})
            for start in range(0, rounds, COUNTED_ROUNDS):
                drawn = [cells.drawn(seed, r, row_share).astype(np.uint32) for r in range(start, min(rounds, start + COUNTED_ROUNDS))]
                yield pa.RecordBatch.from_pydict({"start": [start], "chunk": [record["chunk"]], **{k: [b""] for k in ("bins", "cell", "label")}, "drawn": [np.stack(drawn).tobytes()]})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = itertools.groupby(_records(batches), key=lambda record: record["start"])
        _, heads = next(blocks, (None, ()))
        heads = list(heads)
        if not heads:
            return
        sizes = [len(h["label"]) // 8 for h in heads]
        n_cells = [len(h["bins"]) // (n_features * dtype.itemsize) for h in heads]
        every = np.frombuffer(b"".join(h["bins"] for h in heads), dtype).reshape(-1, n_features)
        bins, code = distinct_cells(packed_bins(every).cast(pa.binary()), dtype)
        offsets = np.repeat(np.cumsum([0, *n_cells[:-1]]), sizes)
        cell = code[np.frombuffer(b"".join(h["cell"] for h in heads), np.int64) + offsets]
        label = np.frombuffer(b"".join(h["label"] for h in heads), np.float64)
        none = np.zeros(0, np.int64)
        cells = Cells(bins, cell, label, none, none, np.full(len(bins), base))

        def drawn() -> Iterator[np.ndarray]:
            for _, block in blocks:
                parts = [np.frombuffer(b["drawn"], np.uint32).reshape(-1, size) for b, size in zip(block, sizes, strict=True)]
                yield from np.concatenate(parts, axis=1).astype(np.int64)

        trees = boost_cells(cells, drawn(), lambda local: local, n_bins, depth, rate, lam, min_child_weight, column_share, seed)
        yield pa.RecordBatch.from_pydict({"trees": [json.dumps([t.as_dict() for t in trees])]})

    counts = state.mapInArrow(count, "start long, chunk long, bins binary, cell binary, label binary, drawn binary")
    found = counts.repartition(1).sortWithinPartitions("start", "chunk").mapInArrow(train, "trees string").collect()
    return [Tree.from_dict(t, depth) for t in json.loads(found[0].trees)] if found else []


def _boost_over_tasks(state: DataFrame, settings: tuple) -> list[Tree]:
    """Every level a job over all tasks; margins are written after every CHECKPOINT_EVERY trees.

    Between writes each job adds the trees not yet written to the margins it reads.
    """
    n_features, n_bins, rounds, depth, rate, lam, min_child_weight, row_share, column_share, seed = settings
    dtype = bin_type(n_bins)
    trees: list[Tree] = []
    pending: list[Tree] = []
    for r in range(rounds):
        allowed = columns_of_round(n_features, column_share, seed, r)

        def merged(tree, level, wanted, r=r, pending=list(pending), state=state):
            def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = None
                for record in _records(batches):
                    cells = _with_trees(_cells_of(record, n_features, dtype), pending)
                    sums = local_sums(cells, cells.drawn(seed, r, row_share))
                    local = local_histograms(cells.bins, tree.nodes(cells.bins, level), sums, len(tree.feature), wanted, n_bins)
                    total = local if total is None else total + local
                if total is not None:
                    slot, f, b = np.nonzero(total[2])
                    g, h, n = total[:, slot, f, b]
                    yield pa.RecordBatch.from_pydict({"slot": slot, "feature": f, "bin": b, "g": g, "h": h, "n": n})

            sums = state.mapInArrow(count, "slot long, feature long, bin long, g long, h long, n long").groupBy(
                "slot", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
            table = sums.toArrow()
            out = np.zeros((3, len(wanted), n_features, n_bins), dtype=np.int64)
            at = tuple(table[c].to_numpy() for c in ("slot", "feature", "bin"))
            for k, name in enumerate(("g", "h", "n")):
                out[k][at] = table[name].to_numpy()
            return out

        tree = grow(merged, n_features, n_bins, allowed, depth, rate, lam, min_child_weight)
        trees.append(tree)
        pending.append(tree)
        if len(pending) == CHECKPOINT_EVERY:
            state, pending = checkpointed(state.mapInArrow(_written_trees(pending, n_features, dtype), _CELLS)), []
    return trees


def _with_trees(cells: Cells, trees: list[Tree]) -> Cells:
    """The margins with the trees added one by one, as one task does."""
    for tree in trees:
        cells.margin = cells.margin + tree.value[tree.nodes(cells.bins, tree.depth)]
    return cells


def _written_trees(trees: list[Tree], n_features: int, dtype: np.dtype):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in _records(batches):
            yield _as_record(record["chunk"], _with_trees(_cells_of(record, n_features, dtype), trees))

    return add
