"""Packing documents into token windows.

A document's ids are cut into full windows, one main piece whose length is a
multiple of UNIT, and a tail shorter than UNIT. Full windows stand alone.
For the main pieces all shallow combinations (two or three lengths) that fill
a window exactly are enumerated; non-negative least squares finds how often
to use each so that the histogram of main pieces is met; the counts are
rounded down to what the histogram holds. Main pieces that are left over are
packed greedily, longest first, cut at the window's end, and so are the
tails. Only the last window of these two streams can hold padding.

Every place in the plan is a formula of a piece's rank: its number among the
pieces of its class inside one task plus the class's count in earlier tasks.
So no global sort is needed: tokens are written once to the shared folder
with their rank inside the task, per-task counts give the offsets, and a
second pass over the written table cuts the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tarmac.llm.common import materialise, prepare
from tarmac.llm.tokens import WordTokenizer, forget, shared as shared_tokenizer

WINDOW = 4096
UNIT = 64
DEPTH = 3                  # pieces of a combination
CLOSING = 2                # id after each document
TOKENIZER = "word_bpe_49k.json"

def tokenise(docs: DataFrame, path: str, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """(doc_id, ids, n, part, full_rank, main, main_rank, tail, tail_at), written
    to the shared folder. ``ids`` ends with the closing id; ``part`` is the
    task; the ranks count full windows and main pieces of a class so far in
    the task, ``tail_at`` the tail tokens so far."""
    prepare(docs.sparkSession)
    classes = window // unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, tok = TaskContext.get().partitionId(), shared_tokenizer(WordTokenizer, path)
        full, mains, tails = 0, np.zeros(classes, np.int64), 0
        closing = np.array([CLOSING], dtype="<u2").tobytes()
        for b in batches:
            ids = [x.astype("<u2").tobytes() + closing for x in tok(b.column(1))]
            n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
            whole, rest = n // window, n % window
            main, tail = rest // unit, rest % unit
            full_rank = full + np.cumsum(whole) - whole
            tail_at = tails + np.cumsum(tail) - tail
            rank = np.zeros(len(n), np.int64)
            for c in np.unique(main).tolist():
                hit = np.flatnonzero(main == c)
                rank[hit] = mains[c] + np.arange(len(hit))
                mains[c] += len(hit)
            full, tails = full + int(whole.sum()), tails + int(tail.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int64)),
                 pa.array(full_rank), pa.array(main), pa.array(rank), pa.array(tail), pa.array(tail_at)],
                names=["doc_id", "ids", "n", "part", "full_rank", "main", "main_rank", "tail", "tail_at"])

    schema = ("doc_id long, ids binary, n long, part long, full_rank long, main long, main_rank long, "
              "tail long, tail_at long")
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "ids")


def combinations(classes: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of two to ``depth`` lengths (in units) that fill a window."""
    out = []
    for size in range(2, depth + 1):
        for head in combinations_with_replacement(range(classes - 1, 0, -1), size - 1):
            last = classes - sum(head)
            if 0 < last <= head[-1]:
                out.append((*head, last))
    return out


def nnls(a: np.ndarray, y: np.ndarray, steps: int = 4000) -> np.ndarray:
    """min |a x - y| with x >= 0: accelerated projected gradient."""
    scale = max(float(y.max(initial=0)), 1.0)
    b = y / scale
    rate = 1.0 / np.linalg.norm(a, 2) ** 2
    x = np.zeros(a.shape[1])
    z, t = x.copy(), 1.0
    for _ in range(steps):
        nxt = np.maximum(z - rate * (a.T @ (a @ z - b)), 0.0)
        if (z - nxt) @ (nxt - x) > 0:                       # restart the momentum
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x * scale


@dataclass
class Plan:
    """Where pieces go. Segment k of ``of`` serves ``count[k]`` main pieces of
    its class, from rank ``rank[k]``; piece r of it lies in sequence
    ``seq[k] + r`` at ``offset[k]``. Later ranks join the rest stream."""
    window: int
    unit: int
    first: np.ndarray       # per class: first segment, classes + 1 entries
    rank: np.ndarray
    seq: np.ndarray
    offset: np.ndarray
    quota: np.ndarray       # per class: ranks served by combinations
    rest_at: np.ndarray     # per class: place of its first left-over piece in the rest stream
    rest_seq: int
    tail_seq: int


def make_plan(histogram: np.ndarray, full: int, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> Plan:
    """Plan for ``histogram[c]`` main pieces of c units and ``full`` windows."""
    classes = window // unit
    combos = combinations(classes, depth)
    a = np.zeros((classes, len(combos)))
    for k, c in enumerate(combos):
        for length in c:
            a[length, k] += 1
    y = histogram.astype(np.float64).copy()
    y[0] = 0
    times = np.floor(nnls(a, y) + 1e-6).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    for k in np.argsort(-times, kind="stable").tolist():    # never more than the histogram holds
        if times[k]:
            need = a[:, k].astype(np.int64)
            on = np.flatnonzero(need)
            times[k] = min(times[k], int((left[on] // need[on]).min()))
            left -= need * times[k]
    for k, c in enumerate(combos):                          # what rounding left, greedily
        need = a[:, k].astype(np.int64)
        on = np.flatnonzero(need)
        more = int((left[on] // need[on]).min())
        if more > 0:
            times[k] += more
            left -= need * more
    segments: list[list[tuple[int, int, int]]] = [[] for _ in range(classes)]
    used, seq = np.zeros(classes, np.int64), full
    for k, c in enumerate(combos):
        if times[k]:
            offset = 0
            for length in c:
                segments[length].append((int(used[length]), seq, offset))
                used[length] += times[k]
                offset += length * unit
            seq += int(times[k])
    flat = [s for c in segments for s in c]
    rest = np.where(np.arange(classes) > 0, histogram - used, 0)
    tokens = rest * np.arange(classes) * unit
    rest_at = np.zeros(classes, np.int64)                   # longest first
    rest_at[::-1] = np.cumsum(tokens[::-1]) - tokens[::-1]
    tail_seq = seq + -(-int(tokens.sum()) // window)
    cols = np.array(flat, dtype=np.int64).reshape(-1, 3)
    return Plan(window, unit, np.cumsum([0] + [len(c) for c in segments]), cols[:, 0], cols[:, 1], cols[:, 2],
                used, rest_at, seq, tail_seq)


def _stream(seq: int, at: int, start: int, length: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of tokens laid at ``at`` of a stream."""
    while length:
        room = min(length, window - at % window)
        yield start, room, seq + at // window, at % window
        at, start, length = at + room, start + room, length - room


def place(plan: Plan, n: int, full_rank: int, main: int, main_rank: int, tail: int, tail_at: int
          ) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of each piece of one document; ranks
    are those of the whole input."""
    w = plan.window
    out = [(k * w, w, full_rank + k, 0) for k in range(n // w)]
    start = n // w * w
    if main:
        length = main * plan.unit
        if main_rank < plan.quota[main]:
            lo, hi = plan.first[main], plan.first[main + 1]
            k = lo + int(np.searchsorted(plan.rank[lo:hi], main_rank, side="right")) - 1
            out.append((start, length, int(plan.seq[k]) + main_rank - int(plan.rank[k]), int(plan.offset[k])))
        else:
            at = int(plan.rest_at[main]) + (main_rank - int(plan.quota[main])) * length
            out += _stream(plan.rest_seq, at, start, length, w)
        start += length
    if tail:
        out += _stream(plan.tail_seq, tail_at, start, tail, w)
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, window: int = WINDOW, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, see SCHEMA (with ``with_ids`` also the piece's
    ids as 16-bit little-endian bytes).

    A NULL or empty text is the closing id alone; repeated rows are packed
    one by one; an empty table gives no piece. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ids = tokenise(docs, path, window, unit)
    classes = window // unit
    # One row for a task and class: pieces, and (class 0 stands for all) full windows and tail tokens.
    counts = (ids.groupBy("part", "main").agg(F.count(F.lit(1)).alias("pieces"),
                                              F.sum(F.floor(F.col("n") / window)).alias("full"),
                                              F.sum("tail").alias("tail")))
    counts = materialise(counts, "packcounts")
    total = {int(r["main"]): r for r in
             counts.groupBy("main").agg(F.sum("pieces").alias("p"), F.sum("full").alias("f")).collect()}
    histogram = np.array([int(total[c]["p"]) if c in total else 0 for c in range(classes)], dtype=np.int64)
    plan = make_plan(histogram, sum(int(r["f"]) for r in total.values()), window, unit)

    def before(*keys):
        return Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    # One row for a task: earlier tasks' pieces of each class, full windows and tail tokens.
    by_part = counts.groupBy("part").agg(F.sum("full").alias("full"), F.sum("tail").alias("tail"))
    by_part = by_part.select("part", F.coalesce(F.sum("full").over(before()), F.lit(0)).alias("full_before"),
                             F.coalesce(F.sum("tail").over(before()), F.lit(0)).alias("tail_before"))
    by_class = counts.select("part", "main",
                             F.coalesce(F.sum("pieces").over(before("main")), F.lit(0)).alias("main_before"))
    by_class = by_class.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("main", "main_before"))).alias("main_before"))
    offsets = materialise(by_class.join(by_part, "part"), "packoffsets")
    shared = spark.sparkContext.broadcast(plan)             # a few hundred integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        forget()                                     # the words are not needed any more
        for b in batches:
            cols = {k: b.column(i).to_pylist() for i, k in enumerate(b.schema.names)}
            rows: list[list] = [[] for _ in range(8)]
            for i, raw in enumerate(cols["ids"]):
                tokens = np.frombuffer(raw, "<u2")
                for start, length, seq, off in place(p, cols["n"][i], cols["full_rank"][i], cols["main"][i],
                                                     cols["main_rank"][i], cols["tail"][i], cols["tail_at"][i]):
                    piece = tokens[start:start + length]
                    for into, v in zip(rows, (cols["doc_id"][i], start, length, zlib.crc32(piece.astype("<u4").tobytes()),
                                              len(tokens), seq, off, piece.tobytes() if with_ids else None)):
                        into.append(v)
            arrays = [pa.array(x, pa.int64()) for x in rows[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(rows[7], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    placed = ids.join(offsets, "part").select(
        "doc_id", "ids", "n", (F.col("full_rank") + F.col("full_before")).alias("full_rank"), "main",
        (F.col("main_rank") + F.col("main_before")[F.col("main")]).alias("main_rank"), "tail",
        (F.col("tail_at") + F.col("tail_before")).alias("tail_at"))
    return placed.mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))


def sequence_length(total: int, window: int = WINDOW) -> int:
    """Stored length of a sequence with ``total`` tokens: a power of two stays
    as it is, anything else is padded to the window."""
    return total if total & (total - 1) == 0 else window
