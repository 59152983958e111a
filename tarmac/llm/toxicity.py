"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased letter runs; a document's features are the distinct
32-bit hashes of its terms, each with value one. On a bounded labelled sample
the hashes that tell the classes apart best are selected (chi-square), and a
factorization machine learns one weight and one vector per selected hash:

    margin = bias + sum w_i + 1/2 * sum_f ((sum v_if)^2 - sum v_if^2)

so a pair of terms may count more, or less, than the sum of both. The margin
is calibrated on a part of the sample that the weights never saw.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tarmac.llm.common import Adam, SparseRows, filter_rows, fold, labelled_sample, platt, prepare, sigmoid

MAX_ROWS = 20000           # bound of the labelled sample
TERMS = 2048               # selected hashes
MIN_CHI2 = 10.0
FACTORS = 4
THRESHOLD = 0.3
MEMO = 1 << 18             # terms remembered in one task
_TERM = re.compile(r"[^\W\d_]+")


@dataclass
class ToxicModel:
    hashes: np.ndarray      # uint32, sorted
    weights: np.ndarray     # float64[terms]
    vectors: np.ndarray     # float64[terms, factors]
    slope: float
    shift: float


def term_hashes(text: str | None) -> np.ndarray:
    """Distinct term hashes of a text, sorted."""
    terms = set(_TERM.findall((text or "").lower()))
    return np.unique(np.array([zlib.crc32(t.encode("utf-8")) for t in terms], dtype=np.uint32))


def learnable() -> Column:
    return F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2)


def _select(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The hashes with the largest chi-square against the label."""
    h = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    lab = np.repeat(y, [len(r) for r in rows])
    terms, at, n = np.unique(h, return_inverse=True, return_counts=True)
    a = np.bincount(at, lab, minlength=len(terms))
    pos, total = float(y.sum()), float(len(y))
    c, b = pos - a, n - a
    d = total - pos - b
    chi = total * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    ok = np.flatnonzero((chi >= MIN_CHI2) & (n >= 3))
    best = ok[np.lexsort((terms[ok], -chi[ok]))][:TERMS]
    return np.sort(terms[best])


def fm_margin(x: SparseRows, w: np.ndarray, v: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Margins and, per row, the summed vectors."""
    z = x.dot(w) + bias
    sums = np.stack([x.dot(v[:, f]) for f in range(v.shape[1])], axis=1)
    squares = sum(np.bincount(x.row, (x.val * v[x.idx, f]) ** 2, minlength=x.n) for f in range(v.shape[1]))
    return z + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None,
                 max_rows: int = MAX_ROWS) -> ToxicModel:
    """Fit on at most ``max_rows`` labelled documents; the term hashes of the
    sample are made on the executors. Without both labels the model gives
    every text the share of toxic labels (0 if there is none)."""
    sample = labelled_sample(docs, labels, "toxic", learnable() if learn is None else learn, max_rows)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2),
                 pa.array([term_hashes(t).astype("<u4").tobytes() for t in b.column(1).to_pylist()], pa.binary())],
                names=["held", "label", "terms"])

    got = (sample.select((F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(5)) == 0).alias("held"), "text", "label",
                         "doc_id").orderBy("doc_id").drop("doc_id")
           .mapInArrow(run, "held boolean, label int, terms binary").collect())
    none = ToxicModel(np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, FACTORS)), 1.0, -40.0)
    y = np.array([r["label"] for r in got], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        none.shift = 40.0 if len(y) and y.min() == 1 else -40.0
        return none
    held = np.array([r["held"] for r in got], dtype=bool)
    rows = [np.frombuffer(r["terms"], "<u4") for r in got]
    train = np.flatnonzero(~held)
    hashes = _select([rows[i] for i in train], y[train])

    def sparse(which) -> SparseRows:
        out = []
        for i in which:
            at = np.searchsorted(hashes, rows[i])
            hit = at[(at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == rows[i])] if len(hashes) else at[:0]
            out.append((hit, np.ones(len(hit))))
        return SparseRows(out)

    x, t = sparse(train), y[train]
    dim = len(hashes)
    w, bias = np.zeros(dim), np.array([np.log((t.sum() + 1) / (len(t) - t.sum() + 1))])
    v = np.random.default_rng(17).normal(0, 0.05, (dim, FACTORS))
    opt = Adam([w, bias, v], 0.05)
    for _ in range(200):
        z, sums = fm_margin(x, w, v, float(bias[0]))
        r = (sigmoid(z) - t) / len(t)
        gv = np.stack([x.back(r * sums[:, f], dim) for f in range(FACTORS)], axis=1)
        gv -= v * x.back(r, dim)[:, None]              # values are one, so their squares are too
        opt.step([x.back(r, dim) + 2e-5 * w, np.array([r.sum()]), gv + 1e-4 * v])
    a, b = platt(fm_margin(sparse(np.flatnonzero(held)), w, v, float(bias[0]))[0], y[held])
    return ToxicModel(hashes, w, v, a, a * float(bias[0]) + b)


class Scorer:
    """Scores texts with a model; remembers which terms are selected."""

    def __init__(self, model: ToxicModel):
        self.m, self.memo = model, {}
        self.at = {int(h): i for i, h in enumerate(model.hashes)}

    def __call__(self, text: str | None) -> float:
        memo, hit = self.memo, set()
        for term in set(_TERM.findall((text or "").lower())):
            i = memo.get(term)
            if i is None:
                i = self.at.get(zlib.crc32(term.encode("utf-8")), -1)
                if len(memo) < MEMO:
                    memo[term] = i
            if i >= 0:
                hit.add(i)
        m = self.m
        z = 0.0
        if hit:
            at = np.fromiter(sorted(hit), np.int64, len(hit))
            v = m.vectors[at]
            z = float(m.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v ** 2).sum()))
        return float(sigmoid(np.array(m.slope * z + m.shift)))


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row. NULL and
    empty texts have no term and get the bias; a NULL id is not held out.
    Only doc_id and text are read."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)    # at most TERMS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for b in batches:
            s = [score(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()),
                 pa.array([int(x >= threshold) for x in s], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"))


def keep_harmless(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all columns unchanged."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep_of():
        score = Scorer(shared.value)
        return lambda texts: np.array([score(t) < threshold for t in texts], dtype=bool)

    return filter_rows(docs, "text", keep_of)
