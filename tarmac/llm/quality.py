"""Quality rules: base text statistics and a hashed n-gram logistic regression.

The regression reads three kinds of hashed features, each normalised to sum
to one over the document: single words, pairs of neighbouring words, and
three-byte character n-grams. It is fitted on a bounded sample of labelled
rows (``max_rows``, chosen by a hash of the id), its margin is calibrated by a
logistic fit on a part of the sample that the weights never saw, and whole
texts are scored in Arrow batches by gathering weights. A document is kept if
no base rule fails and the calibrated probability of good quality reaches the
fixed threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarmac.llm.common import Adam, SparseRows, labelled_sample, platt, prepare, sigmoid

BITS = 16
DIM = 3 << BITS            # words, word pairs, character n-grams
SCALE = 20.0               # size of the normalised feature values
MAX_ROWS = 4000            # bound of the labelled sample
THRESHOLD = 0.5            # calibrated probability of good quality
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
CHUNK = 1 << 20            # bytes of one text handled at a time


@dataclass
class QualityModel:
    weights: np.ndarray     # float32[DIM]
    slope: float
    shift: float


def base_stats(text: str | None) -> tuple[int, int, int, int, int, list[bytes], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, distinct
    words, word numbers). NULL counts as an empty text."""
    if not text:
        return 0, 0, 0, 0, 0, [], np.zeros(0, np.int64)
    words = text.encode("utf-8").split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [ln for ln in text.split("\n") if ln.strip(SPACES)]
    return (len(words), chars, symbols, len(lines) - len(set(lines)),
            repeated_words(ids, len(seen)), list(seen), ids)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words covered by a 3-word window that occurs at least twice."""
    n = len(ids)
    if n < 4 or distinct == n:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:                      # keep the window code in 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    code = pair[:-1] * distinct + ids[2:]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def _word_features(distinct: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    if not len(ids):
        return [np.zeros(0, np.int64)] * 2
    mask = (1 << BITS) - 1
    h = np.array([zlib.crc32(w) for w in distinct], dtype=np.uint64)
    one = h[ids]
    pair = ((one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)) >> np.uint64(11)) & np.uint64(mask)
    return [(one & np.uint64(mask)).astype(np.int64), pair.astype(np.int64) + (1 << BITS)]


def _gram_features(raw: bytes) -> Iterator[np.ndarray]:
    """Hashed three-byte n-grams, in pieces of at most CHUNK bytes."""
    for at in range(0, len(raw), CHUNK):
        b = np.frombuffer(raw, np.uint8, min(CHUNK + 2, len(raw) - at), at).astype(np.uint32)
        if len(b) > 2:
            code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
            yield ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64) + (2 << BITS)


def sparse_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) pairs of one document; an empty text has none."""
    *_, distinct, ids = base_stats(text)
    kinds = [[x] for x in _word_features(distinct, ids)]
    kinds.append(list(_gram_features((text or "").encode("utf-8"))))
    idx, val = [], []
    for parts in kinds:
        total = sum(map(len, parts))
        if total:
            i, c = np.unique(np.concatenate(parts), return_counts=True)
            idx.append(i)
            val.append(c * (SCALE / total))
    if not idx:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(idx), np.concatenate(val)


def margin(weights: np.ndarray, text: str | None, distinct: list[bytes], ids: np.ndarray) -> float:
    z = 0.0
    for x in _word_features(distinct, ids):
        if len(x):
            z += SCALE * float(weights[x].mean())
    total, count = 0.0, 0
    for x in _gram_features((text or "").encode("utf-8")):
        total += float(weights[x].sum(dtype=np.float64))
        count += len(x)
    return z + (SCALE * total / count if count else 0.0)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> QualityModel:
    """Fit on at most ``max_rows`` labelled documents.

    Features are computed on the executors; only sparse rows of the bounded
    sample reach the driver. Every fifth row (by a hash of the id) is left
    out of the weights and used for the calibration. With no usable label the
    model is neutral: probability 0.5 for every text, so the base rules decide.
    """
    sample = labelled_sample(docs, labels, "quality", F.lit(True), max_rows)

    def run(batches):
        for b in batches:
            got = [sparse_features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2),
                pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()),
                pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())],
                names=["held", "label", "idx", "val"])

    rows = (sample.select((F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0).alias("held"), "text", "label",
                          "doc_id").orderBy("doc_id").drop("doc_id")
            .mapInArrow(run, "held boolean, label int, idx binary, val binary").collect())
    part = {False: [], True: []}
    for r in rows:
        part[r["held"]].append((r["label"], np.frombuffer(r["idx"], "<i4"), np.frombuffer(r["val"], "<f4")))
    del rows
    y = np.array([x[0] for x in part[False]], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(DIM, np.float32), 1.0, 0.0)
    x = SparseRows([r[1:] for r in part[False]])
    w, bias = np.zeros(DIM), np.zeros(1)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())   # classes weigh the same
    opt = Adam([w, bias], 0.05)
    for _ in range(80):
        r = (sigmoid(x.dot(w) + bias[0]) - y) * weight
        opt.step([x.back(r, DIM) + 1e-4 * w, np.array([r.sum()])])
    held = SparseRows([r[1:] for r in part[True]])
    a, b = platt(held.dot(w) + bias[0], np.array([r[0] for r in part[True]], dtype=np.float64))
    return QualityModel(w.astype(np.float32), a, a * float(bias[0]) + b)


def judge(model: QualityModel, text: str | None, threshold: float = THRESHOLD):
    """Base statistics and verdicts of one text: (n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept)."""
    n, chars, symbols, dup, repeat, distinct, ids = base_stats(text)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    p = float(sigmoid(np.array(model.slope * margin(model.weights, text, distinct, ids) + model.shift)))
    return n, chars, symbols, dup, repeat, failed, p, (not failed) and p >= threshold


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, quality_p double")


def quality_rules(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document, see SCHEMA. NULL and empty texts have zero
    statistics, fail the base rule and are not kept; repeated rows are judged
    one by one; other columns of ``docs`` are not read."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)     # 768 KB of weights at every size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_p", "kept"]
        for b in batches:
            got = list(zip(*(judge(m, t, threshold) for t in b.column(1).to_pylist()))) or [[]] * 8
            cols = dict(zip(names, (pa.array(c, t) for c, t in zip(got, types))))
            order = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_p"]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [cols[k] for k in order], names=["doc_id"] + order)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
