"""Gradient boosting by histograms, for two-class rows.

Features are cut into at most ``bins`` byte codes once. Each tree grows level
by level, and a level is one distributed job: every partition adds up the
gradients of its rows per (node, feature, bin), partial sums are merged as a
tree, and the driver, which sees sums only, picks the splits. Only the
smaller child of a split is summed; its sibling is the parent minus it. Rows
keep their margin, to which the first job after a tree adds that tree's values.
The rows drawn for a tree are kept with their gradients while it grows, and
find their node by walking it. Features with few bins are summed together, over
the pairs (or more) of their bins, and the sums of each are added up from these.

Gradients are summed as whole numbers (UNIT to one), so sums do not depend on
the order in which partitions are merged and a repeated run grows the same
trees.

Two growths share this:

* ``LEVEL_WISE`` splits every node that gains, to a depth; a hash of the row
  draws each tree's rows.
* ``LEAF_WISE`` splits the leaf with the largest gain next, to a number of
  leaves. A node's gain does not depend on that order, so levels are summed as
  above and the order is followed afterwards, on the sums. Rows are drawn one-sided: all
  with a large gradient, a share of the others weighted up.

The result is a Spark ML ``GBTClassificationModel`` (written in its stored
form and loaded), so scoring, importances and storage are Spark's own.

A level is a job of a few dozen milliseconds and there are hundreds of them
one after the other: they run on the RDD of row blocks, without a query plan
for each. Rows that fit one partition (PARTITION_ROWS) need no merging, so its
task asks itself for the sums, by the same code and with the same trees.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.ranking import prefix_sums
from tarmac.session import checkpoint_root, work_dir

UNIT = 1 << 24             # gradients are whole numbers of 1 / UNIT
PARTITION_ROWS = 1_000_000 # rows of a partition, a rule of the row count alone: the task of a level over 200,000 takes 60 ms and more, their sums some 6
BLOCK_ROWS = 200_000       # rows of a block; arrays of one stay near the caches
CHECKPOINT = 50            # trees after which the stored margins leave the lineage
FEW = 128                  # partitions whose sums the driver adds itself
TOGETHER = 1024            # slots of features summed together, for one node
STRATA = 32                # steps of the gradient's size, for the one-sided sample
BLOCK_SCHEMA = "codes binary, labels binary, marks binary"
BLOCK_ARROW = pa.schema([("codes", pa.binary()), ("labels", pa.binary()), ("marks", pa.binary())])


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``leaves`` None: level-wise. ``row_share``: rows drawn
    for each tree; or, one-sided, ``top_share`` of the rows by gradient and
    ``rest_share`` of the others."""
    rounds: int = 300
    depth: int = 6
    step: float = 0.05
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    feature_share: float = 0.8
    row_share: float = 1.0
    leaves: int | None = None
    top_share: float = 1.0
    rest_share: float = 0.0
    bins: int = 64
    seed: int = 42

    @property
    def one_sided(self) -> bool:
        return self.top_share < 1.0


LEVEL_WISE = Growth(row_share=0.8)
LEAF_WISE = Growth(leaves=31, l2=0.0, min_hessian=1e-3, min_rows=20, top_share=0.2, rest_share=0.2, seed=43)


@dataclass
class Tree:
    """Nodes in heap order: the children of i are 2 i + 1 and 2 i + 2.
    ``feature`` -1 marks a leaf; codes up to ``cut`` go left."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64))

    def walk(self, codes: np.ndarray) -> np.ndarray:
        """Node of each row; ``codes`` has a row of bytes for each feature."""
        n, here = codes.shape[1], np.arange(len(self.feature))
        inner = self.feature >= 0
        below = np.where(inner, 2 * here + 1, here)
        start, cut = np.maximum(self.feature, 0) * n, np.where(inner, self.cut, 255).astype(np.uint8)     # no code is above 255
        node, every, flat = np.zeros(n, np.intp), np.arange(n), codes.reshape(-1)
        for _ in range(int(here[inner].max(initial=-1) + 1).bit_length()):
            right = flat.take(start.take(node) + every) > cut.take(node)
            node = below.take(node)
            node += right
        return node


# ---------------------------------------------------------------- binning
def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Per feature the distinct values at ranks ceil(i n / bins), the largest
    value left out: a code is the number of cuts below the value. Missing
    values have no rank.

    Values are counted first (combined before the shuffle) and the counts
    added up in order by ``prefix_sums``, so the ranks are exact and no task
    merges the sketches of all partitions."""
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])
    path = work_dir(rows.sparkSession, "values")
    rows.select(F.explode(pairs).alias("k")).where("k.v IS NOT NULL").groupBy("k.f", "k.v").agg(F.count(F.lit(1)).alias("n")) \
        .write.parquet(path)
    counts = rows.sparkSession.read.parquet(path)           # a row for each distinct value of a feature
    size = {r["f"]: (int(r["n"]), r["top"]) for r in counts.groupBy("f").agg(F.sum("n").alias("n"), F.max("v").alias("top")).collect()}
    out: list[list[float]] = [[] for _ in features]
    if size:
        whole, top = (F.element_at(F.create_map(*[F.lit(x) for f, r in size.items() for x in (f, r[k])]), F.col("f")) for k in (0, 1))
        passed = F.floor(F.col("cum_n") * bins / whole) > F.floor((F.col("cum_n") - F.col("n")) * bins / whole)
        for r in prefix_sums(counts, "v", ["n"], partition=["f"]).where(passed & (F.col("v") < top)).select("f", "v").collect():
            out[r["f"]].append(float(r["v"]))               # fewer than bins rows of a feature
    return [sorted(c) for c in out]


def code(c, cuts: list[float]):
    """Number of cuts below a value, as a column (binary search by Spark)."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]) if cuts else F.array().cast("array<double>"), lambda x: x < c))


@dataclass
class Binned:
    """Rows cut into codes: an RDD of (codes, labels, marks) blocks, several of them in a partition."""
    spark: SparkSession
    n: int
    positives: int
    cuts: list[list[float]]
    blocks: RDD


def bin_rows(rows: DataFrame, bins: int, features_col: str = "features", label_col: str = "label", id_col: str | None = None) -> Binned:
    """(features vector, label 0/1) rows as blocks, kept until they are
    unpersisted; all models of trees may read the same ones."""
    mark = F.xxhash64(F.col(id_col)) if id_col else F.xxhash64(vector_to_array(features_col))
    d = len(rows.select(features_col).first()[0])
    wide = rows.select(F.col(label_col).cast("int").alias("label"), mark.alias("mark"), vector_to_array(features_col).alias("x"))
    counts = wide.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    cuts = cut_points(wide.select(*[F.col("x")[i].alias(f"f{i}") for i in range(d)]), [f"f{i}" for i in range(d)], bins)
    blocks = _blocks(wide, cuts, int(counts["n"])).persist(StorageLevel.MEMORY_AND_DISK)
    return Binned(rows.sparkSession, int(counts["n"]), int(counts["p"]), cuts, blocks)


def _blocks(rows: DataFrame, cuts: list[list[float]], n_rows: int):
    """RDD of (codes, labels, marks) blocks; ``rows``: mark, label, x."""
    parts = max(1, math.ceil(n_rows / PARTITION_ROWS))
    edges = [np.array(c) for c in cuts]
    placed = rows.repartition(parts, "mark").sortWithinPartitions("mark", "label", "x")

    def pack(batches):
        """A row of bytes for every BLOCK_ROWS rows of the partition, from Arrow batches."""
        codes, y, marks = [], [], []

        def packed():
            row = pa.RecordBatch.from_pydict({"codes": [np.concatenate(codes, axis=1).tobytes()], "labels": [np.concatenate(y).tobytes()],
                                              "marks": [np.concatenate(marks).tobytes()]}, schema=BLOCK_ARROW)
            for c in (codes, y, marks):
                c.clear()
            return row

        for b in batches:
            v = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(edges))
            codes.append(np.stack([np.searchsorted(e, v[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8))
            y.append(b.column("label").to_numpy(zero_copy_only=False).astype(np.uint8))
            marks.append(b.column("mark").to_numpy(zero_copy_only=False).astype(np.int64))
            if sum(map(len, y)) >= BLOCK_ROWS:
                yield packed()
        if sum(map(len, y)):
            yield packed()

    def block(r):
        y = np.frombuffer(r["labels"], np.uint8)
        return np.frombuffer(r["codes"], np.uint8).reshape(len(edges), len(y)), y, np.frombuffer(r["marks"], np.int64).view(np.uint64)

    return placed.mapInArrow(pack, BLOCK_SCHEMA).rdd.map(block)


def _share(marks: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each row and salt."""
    h = (marks ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _stratum(g: np.ndarray) -> np.ndarray:
    return np.minimum((np.abs(g) * STRATA).astype(np.int64), STRATA - 1)


class Drawn(NamedTuple):
    """The rows of a block that count for a tree, with gradient and curvature in units."""
    codes: np.ndarray
    place: np.ndarray | None
    gradient: np.ndarray
    curvature: np.ndarray


@dataclass
class Ask:
    """What a job needs: trees not yet in the margins, the tree that grows,
    the nodes to sum, features, and which rows count."""
    base: float
    done: list[Tree]
    tree: Tree
    nodes: list[int]
    features: list[int]
    offsets: np.ndarray
    width: int
    salt: int
    growth: Growth
    least: int = -1                                         # one-sided: strata from here on count fully; -1: the root's survey

    def margins(self, codes: np.ndarray, margin: np.ndarray) -> np.ndarray:
        out = margin.copy()
        for t in self.done:
            out += t.value[t.walk(codes)]
        return out

    @property
    def survey(self) -> bool:
        return self.growth.one_sided and self.least < 0

    def draw(self, block) -> Drawn:
        """The rows that count for this tree. One-sided, ``place`` is 0 for rows
        that count fully and 1 for drawn others; in the survey it is the
        stratum, and once more, STRATA higher, for the drawn ones."""
        codes, y, marks, margin = block
        p = 1.0 / (1.0 + np.exp(-(self.base + self.margins(codes, margin))))
        g = p - y
        place = None
        if self.survey:
            stratum = _stratum(g)
            twice = np.flatnonzero(_share(marks, self.salt) < self.growth.rest_share)
            at = np.concatenate([np.arange(len(y)), twice])
            place = np.concatenate([stratum, STRATA + stratum[twice]])
        elif self.growth.one_sided:
            full = _stratum(g) >= self.least
            at = np.flatnonzero(full | (_share(marks, self.salt) < self.growth.rest_share))
            place = np.where(full[at], 0, 1).astype(np.uint8)
        else:
            at = np.flatnonzero(_share(marks, self.salt) < self.growth.row_share)
        g, h = (np.rint(w * UNIT).astype(np.int32).take(at) for w in (g, p * (1 - p)))
        return Drawn(codes.take(at, axis=1), place, g, h)

    def sums(self, block) -> np.ndarray:
        """int64[sets, width, 3]: gradient, curvature and rows per slot, of a
        block or of the rows drawn from it. Sets are the asked nodes; one-sided,
        each once for rows that count fully and once for drawn others; in the root's survey
        they are strata instead."""
        codes, place, g, h = block if isinstance(block, Drawn) else self.draw(block)
        if self.survey:
            sets = 2 * STRATA
        else:
            number = np.full(len(self.tree.feature), -1, np.intp)
            number[self.nodes] = np.arange(len(self.nodes))
            mine = number.take(self.tree.walk(codes))
            keep = np.flatnonzero(mine >= 0)
            if len(keep) < len(mine):
                codes, g, h, mine = codes.take(keep, axis=1), g.take(keep), h.take(keep), mine.take(keep)
                place = None if place is None else place.take(keep)
            sets, place = (len(self.nodes), mine) if place is None else (2 * len(self.nodes), mine * 2 + place)
        weights = (g.astype(np.float64), h.astype(np.float64), None)
        out = np.zeros((sets, self.width, 3), np.int64)
        ends = np.append(self.offsets[1:], self.width)
        for some in _bundles(self.features, ends - self.offsets, min(TOGETHER, codes.shape[1] // (4 * sets))):
            shape = [int(ends[f] - self.offsets[f]) for f in some]
            key = place
            for f, w in zip(some, shape):
                key = key * w + codes[f]
            for k, w in enumerate(weights):
                got = np.bincount(key, w, sets * math.prod(shape)).reshape(sets, *shape)
                for i, f in enumerate(some):
                    out[:, self.offsets[f]:ends[f], k] = got.sum(axis=tuple(j + 1 for j in range(len(some)) if j != i))
        return out


def _bundles(features: list[int], widths: np.ndarray, most: int) -> list[list[int]]:
    """Features in groups with at most ``most`` combinations of bins each."""
    out: list[list[int]] = []
    for f in sorted(features, key=lambda f: -widths[f]):
        fits = [b for b in out if math.prod(int(widths[x]) for x in (*b, f)) <= most]
        if fits:
            fits[0].append(f)
        else:
            out.append([f])
    return out


def _together(blocks, ask: Ask) -> np.ndarray | None:
    """Sums over blocks at hand."""
    total = None
    for b in blocks:
        s = ask.sums(b)
        total = s if total is None else total + s
    return total


def _drawn(part, ask: Ask):
    for b in part:
        yield ask.draw(b)


class _Levels:
    """Answers what the levels of one tree ask, from an RDD of blocks. The
    rows drawn for the tree are kept from its first sums on."""

    def __init__(self, blocks):
        self.blocks, self.drawn = blocks, None

    def __call__(self, ask: Ask) -> np.ndarray:
        if ask.survey:
            return _merged(self.blocks, ask)
        if self.drawn is None:
            self.drawn = self.blocks.mapPartitions(partial(_drawn, ask=ask)).persist(StorageLevel.MEMORY_AND_DISK)
        return _merged(self.drawn, ask)

    def end(self) -> None:
        if self.drawn is not None:
            self.drawn.unpersist()


class _Own(_Levels):
    """The same in the task of the only partition, from a list of blocks."""

    def __call__(self, ask: Ask) -> np.ndarray:
        if ask.survey:
            return _together(self.blocks, ask)
        if self.drawn is None:
            self.drawn = list(_drawn(self.blocks, ask))
        return _together(self.drawn, ask)


def _merged(blocks, ask: Ask) -> np.ndarray:
    """Sums over all blocks of an RDD; those of many partitions are merged as
    a tree (a few partial sums reach the driver)."""
    parts = blocks.mapPartitions(lambda part: [s for s in [_together(part, ask)] if s is not None])
    if blocks.getNumPartitions() > FEW:
        return parts.treeReduce(np.add, 2)
    return sum(parts.collect())


# ---------------------------------------------------------------- splits
def best_splits(sums: np.ndarray, offsets: np.ndarray, widths: list[int], features: list[int], growth: Growth):
    """(gain, feature, cut, left sums) of each node's best split, from float
    sums [nodes, width, 3]; gain 0 where nothing gains. Ties: the first
    feature, then the lowest cut."""
    n = len(sums)
    gain, feature, cut, left = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64), np.zeros((n, 3))
    for f in features:
        if widths[f] < 2:
            continue
        s = sums[:, offsets[f]:offsets[f] + widths[f]]
        part = np.cumsum(s, axis=1)
        whole, a = part[:, -1:], part[:, :-1]
        b = whole - a
        with np.errstate(divide="ignore", invalid="ignore"):
            score = (a[..., 0] ** 2 / (a[..., 1] + growth.l2) + b[..., 0] ** 2 / (b[..., 1] + growth.l2)
                     - whole[..., 0] ** 2 / (whole[..., 1] + growth.l2))
        ok = ((a[..., 1] >= growth.min_hessian) & (b[..., 1] >= growth.min_hessian)
              & (a[..., 2] >= growth.min_rows) & (b[..., 2] >= growth.min_rows))
        score = np.where(ok & np.isfinite(score), score, 0.0)
        at = score.argmax(axis=1)
        here = score[np.arange(n), at]
        better = here > gain + 1e-12
        gain, feature, cut = np.where(better, here, gain), np.where(better, f, feature), np.where(better, at, cut)
        left = np.where(better[:, None], a[np.arange(n), at], left)
    return gain, feature, cut, left


def _leaf_wise(tree: Tree, leaves: int) -> Tree:
    """The tree that splits the leaf with the largest gain first, cut at a
    number of leaves."""
    import heapq
    keep, heap = set(), [(-tree.gain[0], 0)] if tree.feature[0] >= 0 else []
    while heap and len(keep) + 1 < leaves:
        _, i = heapq.heappop(heap)
        keep.add(i)
        for j in (2 * i + 1, 2 * i + 2):
            if tree.feature[j] >= 0:
                heapq.heappush(heap, (-tree.gain[j], j))
    for i in range(len(tree.feature)):
        if i not in keep:
            tree.feature[i] = -1
    return tree


@dataclass
class Boosted:
    """Trees with what they were grown on."""
    base: float
    cuts: list[list[float]]
    growth: Growth
    trees: list[Tree] = field(default_factory=list)


class _Survey:
    """Layout of the slots: feature f has ``widths[f]`` of them."""

    def __init__(self, cuts: list[list[float]]):
        self.widths = [len(c) + 1 for c in cuts]
        self.offsets = np.cumsum([0, *self.widths[:-1]])
        self.width = sum(self.widths)


def _grow(sums_of: Callable[[Ask], np.ndarray], base: float, pending: list[Tree], lay: _Survey, growth: Growth,
          number: int) -> Tree:
    """One tree: ``sums_of`` is asked once for each level."""
    rng = np.random.default_rng([growth.seed, number])
    d = len(lay.widths)
    features = sorted(rng.permutation(d)[:max(1, math.ceil(d * growth.feature_share))].tolist())
    salt = growth.seed * 1_000_003 + number
    tree = Tree.empty(growth.depth)
    least, amplify = (-1, 1.0) if growth.one_sided else (0, 1.0)
    known: dict[int, np.ndarray] = {}                       # float sums of the nodes of this level
    level = [0]
    for depth in range(growth.depth):
        build = [i for i in level if i not in known]
        ask = Ask(base, pending, tree, build, features, lay.offsets, lay.width, salt, growth, least)
        got = sums_of(ask)
        if growth.one_sided and least < 0:
            count = got[:, lay.offsets[features[0]]:lay.offsets[features[0]] + lay.widths[features[0]], 2].sum(axis=1)
            top = np.cumsum(count[:STRATA][::-1])[::-1]
            least = max([s for s in range(STRATA) if top[s] >= growth.top_share * top[0]], default=0)
            rest, drawn = int(count[:least].sum()), int(count[STRATA:STRATA + least].sum())
            amplify = rest / drawn if drawn else 0.0
            got = np.stack([got[least:STRATA].sum(axis=0), got[STRATA:STRATA + least].sum(axis=0)])
        got = got.astype(np.float64)
        got[..., :2] /= UNIT
        if growth.one_sided:
            got = got.reshape(len(build), 2, lay.width, 3)
            got[:, 1, :, :2] *= amplify
            got = got.sum(axis=1)
        known.update(zip(build, got))
        for i in level:                                     # siblings: parent minus the child that was summed
            if known[i] is not None and i in build and i and (i + 1 if i % 2 else i - 1) in level:
                other = i + 1 if i % 2 else i - 1
                if other not in build:
                    known[other] = known[("parent", (i - 1) // 2)] - known[i]
        sums = np.stack([known[i] for i in level])
        gain, feature, cut, left = best_splits(sums, lay.offsets, lay.widths, features, growth)
        span = slice(lay.offsets[features[0]], lay.offsets[features[0]] + lay.widths[features[0]])
        nxt, upper = [], {}
        for k, i in enumerate(level):
            whole = sums[k][span].sum(axis=0)
            if depth == 0:
                tree.value[i], tree.rows[i] = _leaf(whole, growth), int(whole[2])
            if feature[k] < 0 or gain[k] <= 0:
                continue
            tree.feature[i], tree.cut[i], tree.gain[i] = feature[k], cut[k], gain[k]
            right = whole - left[k]
            for j, s in ((2 * i + 1, left[k]), (2 * i + 2, right)):
                tree.value[j], tree.rows[j] = _leaf(s, growth), int(s[2])
                nxt.append(j)
            upper[("parent", i)] = sums[k]
            small = 2 * i + 1 if left[k][2] <= right[2] else 2 * i + 2
            upper[small + 1 if small % 2 else small - 1] = None     # known once its sibling is
        known, level = upper, nxt
        if not level:
            break
    return _leaf_wise(tree, growth.leaves) if growth.leaves else tree


def _leaf(s: np.ndarray, growth: Growth) -> float:
    den = s[1] + growth.l2
    return float(-growth.step * s[0] / den) if den > 0 else 0.0


def log_odds(positives: int, n: int) -> float:
    """Log-odds of the positive class; bounded when a class is missing."""
    p = min(max(positives / max(n, 1), 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def fit(rows: DataFrame, growth: Growth, features_col: str = "features", label_col: str = "label", id_col: str | None = None) -> Boosted:
    """Boost ``growth.rounds`` trees on (features vector, label 0/1) rows."""
    binned = bin_rows(rows, growth.bins, features_col, label_col, id_col)
    try:
        return fit_binned(binned, growth)
    finally:
        binned.blocks.unpersist()


def fit_binned(rows: Binned, growth: Growth) -> Boosted:
    """Boost ``growth.rounds`` trees on rows that are cut into codes."""
    checkpoint_root(rows.spark)
    base = log_odds(rows.positives, rows.n)
    lay = _Survey(rows.cuts)
    blocks = rows.blocks.map(_unscored)
    alone = blocks.getNumPartitions() == 1
    old, out = [], Boosted(base, rows.cuts, growth)
    while len(out.trees) < growth.rounds:
        first = len(out.trees)
        if alone:                                           # one partition: nothing to merge between the levels
            grown = blocks.mapPartitions(_several(base, lay, growth, first)).collect()[0]
        else:
            levels = _Levels(blocks)
            grown = [_grow(levels, base, [], lay, growth, first)]
            levels.end()
        out.trees += grown
        if len(out.trees) < growth.rounds:                  # walked once: the levels of later trees read the margin
            blocks = blocks.mapPartitions(partial(_stored, trees=grown)).persist(StorageLevel.MEMORY_AND_DISK)
            if len(out.trees) % CHECKPOINT == 0:
                blocks.checkpoint()
            old.append(blocks)
            if len(old) > 2:                                # the last two stay: the new one is computed by the next job
                old.pop(0).unpersist()
    for b in old:
        b.unpersist()
    return out


def _unscored(block):
    return *block, np.zeros(len(block[1]))


def _stored(part, trees: list[Tree]):
    """Blocks with these trees in their margins."""
    for codes, y, marks, margin in part:
        yield codes, y, marks, margin + sum(t.value[t.walk(codes)] for t in trees)


def _several(base: float, lay: _Survey, growth: Growth, first: int):
    """Grow the next CHECKPOINT trees on the blocks of the only partition."""
    def run(part):
        blocks, trees = list(part), []
        for number in range(first, min(first + CHECKPOINT, growth.rounds)):
            trees.append(_grow(_Own(blocks), base, [], lay, growth, number))
            blocks = list(_stored(blocks, trees[-1:]))
        return [trees]
    return run


# ---------------------------------------------------------------- Spark ML form
NODE_SCHEMA = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,"
               "gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,"
               "numCategories:int>>")


def node_rows(model: Boosted) -> list[tuple]:
    """Stored rows of every node: a first tree with one leaf for the log-odds,
    then the boosted trees. Spark's margin counts twice, so values are halved."""
    def leaf(i, value, n):
        return (i, value / 2, 0.0, [float(n), 0.0, 0.0], int(n), -1.0, -1, -1, (-1, [], -1))

    out = [(0, leaf(0, model.base, 0))]
    for k, t in enumerate(model.trees, 1):
        nodes: list[tuple] = []

        def add(i: int) -> int:
            at = len(nodes)
            nodes.append(())
            if t.feature[i] < 0:
                nodes[at] = leaf(at, float(t.value[i]), int(t.rows[i]))
                return at
            a, b = add(2 * i + 1), add(2 * i + 2)
            f, n = int(t.feature[i]), float(t.rows[i])
            nodes[at] = (at, float(t.value[i]) / 2, 0.0, [n, 0.0, 0.0], int(n), float(t.gain[i]) / max(n, 1.0), a, b,
                         (f, [model.cuts[f][int(t.cut[i])]], -1))
            return at

        add(0)
        out += [(k, n) for n in nodes]
    return out


def to_spark_model(spark: SparkSession, model: Boosted, prefix: str, uid: str) -> GBTClassificationModel:
    """A GBTClassificationModel with these trees, and columns named after
    ``prefix``: its stored form is written and loaded."""
    path = work_dir(spark, "boosted")
    n_trees = len(model.trees) + 1
    tree_meta = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "timestamp": 0,
                 "sparkVersion": spark.version, "paramMap": {"maxDepth": model.growth.depth, "impurity": "variance"}, "defaultParamMap": {}}
    meta = {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "timestamp": 0, "sparkVersion": spark.version,
            "uid": uid, "defaultParamMap": {},
            "paramMap": {"maxDepth": model.growth.depth, "maxIter": max(1, model.growth.rounds), "stepSize": model.growth.step,
                         "impurity": "variance", "featuresCol": "features", "labelCol": "label",
                         "predictionCol": f"{prefix}_prediction", "probabilityCol": f"{prefix}_probability",
                         "rawPredictionCol": f"{prefix}_raw"},
            "numFeatures": len(model.cuts), "numTrees": n_trees}
    write_model(spark, path, node_rows(model), [(k, json.dumps(tree_meta | {"uid": f"dtr_{uid}_{k}"}), 1.0) for k in range(n_trees)], meta)
    return GBTClassificationModel.load(path)


def write_model(spark: SparkSession, path: str, nodes: list[tuple], trees: list[tuple], meta: dict) -> None:
    """A model of trees in the form that Spark ML stores."""
    spark.createDataFrame(nodes, NODE_SCHEMA, verifySchema=False).coalesce(1).write.parquet(f"{path}/data")      # bounded: the nodes of the model
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")


class HistogramBooster:
    """Estimator in the manner of Spark ML: ``fit`` gives a GBTClassificationModel."""

    def __init__(self, growth: Growth, prefix: str, id_col: str | None = None):
        self.growth, self.prefix, self.id_col, self.bins = growth, prefix, id_col, growth.bins

    def fit(self, rows: DataFrame) -> GBTClassificationModel:
        boosted = fit(rows, self.growth, id_col=self.id_col)
        return to_spark_model(rows.sparkSession, boosted, self.prefix, f"GBTClassifier_{self.prefix}")

    def fit_binned(self, rows: Binned) -> GBTClassificationModel:
        return to_spark_model(rows.spark, fit_binned(rows, self.growth), self.prefix, f"GBTClassifier_{self.prefix}")


# ---------------------------------------------------------------- what the data alone decide
def root_splits(rows: DataFrame, features: list[str], label_col: str, growth: Growth = LEVEL_WISE) -> DataFrame:
    """(position, feature, cut, gain, left_rows, right_rows): for each feature
    the best split of the first tree's root over all rows, by built-in
    aggregation; a feature that cannot be split has no row."""
    spark = rows.sparkSession
    cuts = cut_points(rows, features, growth.bins)
    lay = _Survey(cuts)
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), code(F.col(f).cast("double"), cuts[i]).alias("b")) for i, f in enumerate(features)])
    sums = (rows.select(F.col(label_col).cast("long").alias("y"), F.explode(pairs).alias("k")).groupBy("k.f", "k.b")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect())       # at most features x bins rows
    total = np.zeros((1, lay.width, 3))
    n = sum(r["n"] for r in sums if r["f"] == 0)
    p = sum(r["p"] for r in sums if r["f"] == 0) / n if n else 0.0
    for r in sums:
        total[0, lay.offsets[r["f"]] + r["b"]] = (p * r["n"] - r["p"], p * (1 - p) * r["n"], r["n"])
    out = []
    for i, f in enumerate(features):
        gain, feature, cut, left = best_splits(total, lay.offsets, lay.widths, [i], growth)
        if feature[0] >= 0:
            out.append((i, f, cuts[i][int(cut[0])], float(gain[0]), int(left[0][2]), n - int(left[0][2])))
    return spark.createDataFrame(out, "position int, feature string, cut double, gain double, left_rows long, right_rows long")
