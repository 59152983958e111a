"""Random forest by histograms, for two-class rows.

The trees grow together, level by level, over the row blocks that boosting
uses (features cut into byte codes once), and a level of all trees is one job:
every partition counts rows and positives of its blocks per (tree, open node,
drawn feature, bin), the counts of a tree are added up in one task, which also
picks its splits, and the driver sees the splits only. A partition holds a
bounded number of rows, so its counts and its share of the shuffle are bounded too.

As in Spark ML's forest: rows are drawn with replacement (a Poisson count with
mean 1 for each row and tree), each node looks at ceil(sqrt(features)) drawn
features, splits by the gain in Gini impurity that leave ``min_rows`` drawn rows
on both sides, and two leaves with one prediction become one. All draws are hashes
of (seed, tree, row) or (seed, tree, node), counts are whole numbers: partitions do not matter.

The result is a Spark ML ``RandomForestClassificationModel`` (written in its
stored form and loaded), so scoring, importances and storage are Spark's own.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession

from tarmac.operators import boosting
from tarmac.session import work_dir

POSITIVE = 1 << 26         # a positive row counts 1 + POSITIVE: rows and positives of a block in one sum
TASKS = 24                 # a level has at least so many tasks, the trees of few partitions being dealt out
# Rows drawn per 16-bit number: counts of a Poisson distribution with mean 1.
DRAWN = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]) * 65536, np.arange(65536), side="right").astype(np.uint8)


@dataclass(frozen=True)
class Forest:
    trees: int = 200
    depth: int = 10
    min_rows: int = 5
    bins: int = 64
    seed: int = 42


@dataclass
class Trees:
    """Nodes of all trees, a row for each, in heap order (the children of i
    are 2 i + 1 and 2 i + 2). ``feature`` -1 marks a leaf; codes up to ``cut``
    go left. ``rows`` and ``positives`` count drawn rows."""
    feature: np.ndarray
    cut: np.ndarray
    rows: np.ndarray
    positives: np.ndarray

    @staticmethod
    def empty(n: int, depth: int) -> Trees:
        shape = (n, (2 << depth) - 1)
        return Trees(np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape, np.int64), np.zeros(shape, np.int64))


@dataclass
class Level:
    """What a job needs: the trees so far and the open nodes of each, all at
    one depth."""
    spec: Forest
    widths: list[int]
    feature: np.ndarray
    cut: np.ndarray
    nodes: dict[int, np.ndarray]
    depth: int

    def slots(self, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features drawn for each open node of a tree, the place of their
        first slot, and their widths: [nodes, features] each."""
        d = len(self.widths)
        rng = np.random.default_rng([self.spec.seed, tree, self.depth])
        drawn = np.argsort(rng.random((1 << self.depth, d)), axis=1)[:, :math.ceil(math.sqrt(d))]
        drawn = np.sort(drawn[self.nodes[tree] - (1 << self.depth) + 1], axis=1)
        widths = np.array(self.widths)[drawn]
        return drawn, (np.cumsum(widths) - widths.ravel()).reshape(widths.shape), widths


# ---------------------------------------------------------------- counting
def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def row_keys(marks: np.ndarray, before: int = 0) -> np.ndarray:
    """A hash for each row; rows of one mark, which stand together, are
    numbered, so each is drawn by itself. ``before``: rows of the first mark in
    earlier blocks of the partition."""
    first = np.r_[True, marks[1:] != marks[:-1]] if len(marks) else np.zeros(0, bool)
    at = np.arange(len(marks))
    start = np.maximum.accumulate(np.where(first, at, 0))
    number = (at - start + np.where(start == 0, before, 0)).astype(np.uint32)
    low, high = (marks & np.uint64(0xFFFFFFFF)).astype(np.uint32), (marks >> np.uint64(32)).astype(np.uint32)
    return _mixed(_mixed(low ^ number * np.uint32(0x9E3779B1)) ^ high)


def drawn_counts(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    salt = np.random.default_rng([seed, tree, 1 << 20]).integers(0, 1 << 32, dtype=np.uint32)
    return DRAWN[_mixed(keys ^ salt) >> np.uint32(16)]


def tree_counts(codes: np.ndarray, y: np.ndarray, keys: np.ndarray, level: Level, tree: int, slots: tuple | None = None) -> np.ndarray:
    """int64 for each slot of a tree's open nodes: rows + POSITIVE * positives."""
    drawn, base, widths = slots or level.slots(tree)
    feature, cut, n = level.feature[tree].astype(np.intp), level.cut[tree], codes.shape[1]
    flat, start = codes.ravel(), level.feature[tree].astype(np.intp) * codes.shape[1]
    times = drawn_counts(keys, level.spec.seed, tree)
    rows = np.flatnonzero(times)
    node = np.zeros(len(rows), np.intp)
    for _ in range(level.depth):                            # rows of finished leaves drop out on the way
        left = feature.take(node) >= 0
        if not left.all():
            rows, node = rows[left], node[left]
        right = flat.take(start.take(node) + rows) > cut.take(node)
        node *= 2
        node += 1
        node += right
    number = np.full(len(feature), -1, np.intp)
    number[level.nodes[tree]] = np.arange(len(level.nodes[tree]))
    place = number.take(node)
    inside = place >= 0
    if not inside.all():
        rows, place = rows[inside], place[inside]
    weight = times[rows] * (1.0 + POSITIVE * y[rows].astype(np.float64))
    size = int(widths.sum())
    out = np.zeros(size)
    for j in range(drawn.shape[1]):
        code = flat.take((drawn[:, j] * n).take(place) + rows)
        out += np.bincount(base[:, j].take(place) + code, weight, size)
    return out.astype(np.int64)


def _counted(part, told, share: int, shares: int):
    """(tree, counts) of a partition's blocks, for every ``shares``-th open tree."""
    level, blocks, last, before = told.value, [], None, 0
    for codes, y, marks in part:
        before = before if marks[0] == last else 0
        blocks.append((codes, y, row_keys(marks, before)))
        ends = int((marks == marks[-1]).sum())              # rows of a mark stand together
        last, before = marks[-1], ends + before if ends == len(marks) else ends
    for tree in sorted(level.nodes)[share::shares] if blocks else []:
        slots = level.slots(tree)
        yield tree, sum(tree_counts(*b, level, tree, slots) for b in blocks)


def _chosen(part, told):
    """(tree, best splits) from the counts of whole trees."""
    level, total = told.value, {}
    for tree, counts in part:
        both = total.setdefault(tree, np.zeros((2, len(counts)), np.int64))
        both[0] += counts & (POSITIVE - 1)
        both[1] += counts >> 26
    for tree, (rows, positives) in total.items():
        yield tree, best_splits(rows, positives, level, tree)


def best_splits(rows: np.ndarray, positives: np.ndarray, level: Level, tree: int) -> tuple[np.ndarray, ...]:
    """(feature, cut, rows, positives, left rows, left positives) for each open
    node; feature -1 where nothing gains. Ties: the first feature, then the lowest cut."""
    drawn, base, widths = level.slots(tree)
    nodes, m = drawn.shape
    starts, size = base.ravel(), widths.ravel()
    seg = np.repeat(np.arange(nodes * m), size)             # (node, feature) of each slot

    def sums(c):
        run = np.cumsum(c)
        before = (run - c)[starts]
        return run - before[seg], np.add.reduceat(c, starts)[::m]

    (ln, n), (lp, p) = sums(rows), sums(positives)
    node = seg // m
    rn, rp = n[node] - ln, p[node] - lp
    with np.errstate(divide="ignore", invalid="ignore"):    # gain times rows / 2: a side's Gini impurity is 2 p (n - p) / n²
        score = p[node] * (n - p)[node] / n[node] - lp * (ln - lp) / ln - rp * (rn - rp) / rn
    score = np.where((ln >= level.spec.min_rows) & (rn >= level.spec.min_rows), score, 0.0)
    first = starts[::m]
    best = np.maximum.reduceat(score, first)
    at = np.arange(len(score))
    hit = np.minimum.reduceat(np.where(score >= best[node] * (1 - 1e-12), at, len(score)), first)
    gains = best > 1e-9
    return (np.where(gains, drawn.ravel()[seg[hit]], -1).astype(np.int16), np.where(gains, hit - starts[seg[hit]], 0).astype(np.uint8),
            n, p, ln[hit], lp[hit])


# ---------------------------------------------------------------- growing
def fit(rows: boosting.Binned, spec: Forest) -> Trees:
    """Grow all trees, one job for each level."""
    sc = rows.blocks.context
    trees = Trees.empty(spec.trees, spec.depth)
    nodes = {t: np.zeros(1, np.int64) for t in range(spec.trees)}
    parts = rows.blocks.getNumPartitions()
    shares = max(1, math.ceil(TASKS / parts))
    for depth in range(spec.depth):
        told = sc.broadcast(Level(spec, [len(c) + 1 for c in rows.cuts], trees.feature, trees.cut, nodes, depth))
        counts = sc.union([rows.blocks.mapPartitions(partial(_counted, told=told, share=i, shares=shares)) for i in range(shares)])
        splits = counts.partitionBy(min(len(nodes), max(TASKS, parts)), int).mapPartitions(partial(_chosen, told=told)).collect()
        told.unpersist()
        following = {}
        for t, (feature, cut, n, p, ln, lp) in splits:      # a few numbers for each node
            at = nodes[t]
            trees.rows[t, at], trees.positives[t, at] = n, p
            split = feature >= 0
            at = at[split]
            trees.feature[t, at], trees.cut[t, at] = feature[split], cut[split]
            n, p, ln, lp = n[split], p[split], ln[split], lp[split]
            for child, cn, cp in ((2 * at + 1, ln, lp), (2 * at + 2, n - ln, p - lp)):
                trees.rows[t, child], trees.positives[t, child] = cn, cp
            both, cn, cp = np.r_[2 * at + 1, 2 * at + 2], np.r_[ln, n - ln], np.r_[lp, p - lp]
            more = np.sort(both[(cn >= 2 * spec.min_rows) & (cp > 0) & (cp < cn)])      # others cannot gain
            if len(more):
                following[t] = more
        nodes = following
        if not nodes:
            break
    return trees


# ---------------------------------------------------------------- Spark ML form
def _gini(n: int, p: int) -> float:
    return 2.0 * p * (n - p) / (n * n) if n else 0.0


def node_rows(trees: Trees, cuts: list[list[float]]) -> list[tuple]:
    """Stored rows of every node, in pre-order; two leaves with one prediction are one."""
    out = []
    for t in range(len(trees.feature)):
        feature, cut, rows, positives = (a[t].tolist() for a in (trees.feature, trees.cut, trees.rows, trees.positives))

        def pruned(i: int) -> bool:
            """Makes a node a leaf if its sides are leaves with one prediction; says if it is one."""
            if feature[i] >= 0:
                a, b = pruned(2 * i + 1), pruned(2 * i + 2)
                if a and b and (2 * positives[2 * i + 1] > rows[2 * i + 1]) == (2 * positives[2 * i + 2] > rows[2 * i + 2]):
                    feature[i] = -1
            return feature[i] < 0

        nodes: list[tuple] = []

        def add(i: int) -> int:
            at, n, p = len(nodes), rows[i], positives[i]
            nodes.append(())
            same = (float(2 * p > n), _gini(n, p), [float(n - p), float(p)], n)
            if feature[i] < 0:
                nodes[at] = (at, *same, -1.0, -1, -1, (-1, [], -1))
                return at
            a, b = add(2 * i + 1), add(2 * i + 2)
            gain = _gini(n, p) - sum(rows[c] * _gini(rows[c], positives[c]) for c in (2 * i + 1, 2 * i + 2)) / n
            nodes[at] = (at, *same, gain, a, b, (feature[i], [cuts[feature[i]][cut[i]]], -1))
            return at

        pruned(0)
        add(0)
        out += [(t, n) for n in nodes]
    return out


def to_spark_model(spark: SparkSession, trees: Trees, cuts: list[list[float]], spec: Forest, prefix: str, uid: str) -> RandomForestClassificationModel:
    """A RandomForestClassificationModel with these trees, and columns named
    after ``prefix``: its stored form is written and loaded."""
    params = {"maxDepth": spec.depth, "minInstancesPerNode": spec.min_rows, "impurity": "gini", "maxBins": spec.bins}
    tree_meta = {"class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", "timestamp": 0,
                 "sparkVersion": spark.version, "paramMap": params, "defaultParamMap": {}, "numFeatures": len(cuts), "numClasses": 2}
    meta = {"class": "org.apache.spark.ml.classification.RandomForestClassificationModel", "timestamp": 0, "sparkVersion": spark.version,
            "uid": uid, "defaultParamMap": {},
            "paramMap": params | {"numTrees": spec.trees, "featureSubsetStrategy": "sqrt", "seed": spec.seed, "featuresCol": "features",
                                  "labelCol": "label", "predictionCol": f"{prefix}_prediction",
                                  "probabilityCol": f"{prefix}_probability", "rawPredictionCol": f"{prefix}_raw"},
            "numFeatures": len(cuts), "numClasses": 2, "numTrees": spec.trees}
    path = work_dir(spark, "forest")
    boosting.write_model(spark, path, node_rows(trees, cuts), [(k, json.dumps(tree_meta | {"uid": f"dtc_{uid}_{k}"}), 1.0) for k in range(spec.trees)], meta)
    return RandomForestClassificationModel.load(path)


class HistogramForest:
    """Estimator in the manner of Spark ML: ``fit`` gives a RandomForestClassificationModel."""

    def __init__(self, spec: Forest, prefix: str, id_col: str | None = None):
        self.spec, self.prefix, self.id_col, self.bins = spec, prefix, id_col, spec.bins

    def fit(self, rows: DataFrame) -> RandomForestClassificationModel:
        binned = boosting.bin_rows(rows, self.bins, id_col=self.id_col)
        try:
            return self.fit_binned(binned)
        finally:
            binned.blocks.unpersist()

    def fit_binned(self, rows: boosting.Binned) -> RandomForestClassificationModel:
        return to_spark_model(rows.spark, fit(rows, self.spec), rows.cuts, self.spec, self.prefix, f"RandomForestClassifier_{self.prefix}")
