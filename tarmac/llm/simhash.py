"""SimHash near-duplicates: fingerprints and an exact tiled comparison.

Distinct fingerprints are dealt into tiles by population count (number of one
bits) and, within a count, by a hash. Two fingerprints within ``radius`` bits
cannot differ by more than ``radius`` in population count, so only pairs of
tiles whose counts are that close are compared; the others are skipped. A
pair of tiles is compared exactly with numpy exclusive-or and bit counts.
Inside a pair, rows are also skipped by the counts of the two half words.

A task gives back a spanning forest of the links it found, never all pairs;
``connected_components`` joins the forests. Identical fingerprints are one
node, so any number of copies costs one row in the comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tarmac.llm.common import column_texts, fresh, materialise, prepare
from tarmac.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
TILE = 16384               # fingerprints of a tile
BLOCK = 128                # rows compared at once inside a tile pair
SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text. Bits of a shingle's XXH64 vote; a bit is
    set if more than half of the shingles (repeats count) have it. NULL or no
    word: 0; fewer words than a shingle: the whole sequence is one shingle."""
    if not text:
        return 0
    words = text.encode("utf-8").lower().split()        # bytes.lower() maps A-Z only
    if not words:
        return 0
    buf = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(buf, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = (ends[shingle - 1:] - 1).tolist()
    first = [0] + ends[: len(words) - shingle].tolist()
    total = len(first)
    votes = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 18):                 # bounded memory for very long texts
        h = np.array([digest(buf[a:b], SEED) for a, b in zip(first[at:at + (1 << 18)], last[at:at + (1 << 18)])],
                     dtype="<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):                           # byte 0 holds bits 0-7
            counts = np.bincount(h[:, byte], minlength=256)
            votes[byte * 8:byte * 8 + 8] += (counts @ _BITS)[::-1]
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > total).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64), pa.int64())],
                                             names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def with_fingerprint(docs: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with their fingerprint in the column ``name``."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in column_texts(b, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64), pa.int64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node number reachable from each of ``n`` nodes over links i-j."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        nxt = lab.copy()
        np.minimum.at(nxt, lab[i], low)
        np.minimum.at(nxt, lab[j], low)
        np.minimum.at(nxt, i, low)
        np.minimum.at(nxt, j, low)
        while True:                                     # point every node at its root
            up = nxt[nxt]
            if (up == nxt).all():
                break
            nxt = up
        if (nxt == lab).all():
            return lab
        lab = nxt


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (pairs of fingerprints) of the links between two tiles,
    or within one tile if ``b`` is None."""
    def ordered(x):
        hi = np.bitwise_count(x >> np.uint64(32)).astype(np.int16)
        lo = np.bitwise_count(x & np.uint64(0xFFFFFFFF)).astype(np.int16)
        o = np.lexsort((x, lo, hi))
        return x[o], hi[o], lo[o]

    xa, ha, la = ordered(a)
    xb, hb, lb = (xa, ha, la) if b is None else ordered(b)
    shift = 0 if b is None else len(xa)
    nodes = xa if b is None else np.concatenate([xa, xb])
    keep_i, keep_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(xa), BLOCK):
        e = min(s + BLOCK, len(xa))
        gap_h = np.maximum(np.maximum(ha[s] - hb, hb - ha[e - 1]), 0)
        gap_l = np.maximum(np.maximum(la[s:e].min() - lb, lb - la[s:e].max()), 0)
        near = np.flatnonzero(gap_h + gap_l <= radius)
        if b is None:
            near = near[near >= s]
        if not len(near):
            continue
        i, j = np.nonzero(np.bitwise_count(xa[s:e, None] ^ xb[None, near]) <= radius)
        i, j = i + s, near[j] + shift
        if b is None:
            up = i < j
            i, j = i[up], j[up]
        if len(i) > 4 * (e - s + len(near)):            # many links: keep a forest of this block only
            part, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            lab = _forest(len(part), back[:len(i)], back[len(i):])
            i, j = part, part[lab]
        keep_i.append(i)
        keep_j.append(j)
    i, j = np.concatenate(keep_i), np.concatenate(keep_j)
    part, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    lab = _forest(len(part), back[:len(i)], back[len(i):])
    up = lab != np.arange(len(part))
    return nodes[part[up]], nodes[part[lab[up]]]


def near_links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(src, dst): links that connect the distinct fingerprints ``fp`` of
    ``classes`` exactly as all pairs within ``radius`` bits would.

    The number of tiles of a population count follows the measured number of
    fingerprints (65 counts at most reach the driver). A row is sent to the
    tiles it must meet; the row count of a task is bounded by two tiles.
    """
    sized = classes.select("fp", F.bit_count("fp").alias("pop"))
    have = {int(r["pop"]): int(r["count"]) for r in sized.groupBy("pop").count().collect()}
    tiles = [-(-have.get(p, 0) // tile) for p in range(65)]
    base = np.concatenate([[0], np.cumsum(tiles)]).astype(int).tolist()

    def pick(values, at):
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at.cast("int"))

    p = F.col("pop")
    mine = (pick(base, p + 1) + F.pmod(F.xxhash64("fp", F.lit(3)), pick([max(1, t) for t in tiles], p + 1))).cast("int")
    first = pick(base, F.greatest(p - radius, F.lit(0)) + 1)
    last = pick(base, F.least(p + radius, F.lit(64)) + 2) - 1
    sent = (sized.withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(first, last)))
            .select("fp", F.least("mine", "other").alias("ta"), F.greatest("mine", "other").alias("tb"),
                    (F.col("mine") <= F.col("other")).alias("left")))

    def run(key, rows):
        fp = rows.column("fp").to_numpy().view(np.uint64)
        left = rows.column("left").to_numpy(zero_copy_only=False)
        same = key[0].as_py() == key[1].as_py()
        none = np.zeros(0, np.uint64)
        if same:
            u, v = tile_links(fp, None, radius)
        elif left.any() and not left.all():
            u, v = tile_links(fp[left], fp[~left], radius)
        else:
            u, v = none, none
        return pa.table({"src": u.view(np.int64), "dst": v.view(np.int64)})

    return sent.groupBy("ta", "tb").applyInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    NULL and empty texts have fingerprint zero and are linked like any other;
    ``component_id`` is the smallest non-NULL id reachable over links of at
    most ``radius`` bits (NULL only if every id there is NULL). Repeated rows
    stay, with equal results. An empty table gives an empty result. Only
    doc_id and text are read.
    """
    fps, member = _members(docs, shingle, radius, tile)
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = member.join(least, "root").select("fp", "component_id")
    return (fps.join(label, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def _members(docs: DataFrame, shingle: int, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, rep, root) of every fingerprint: its
    smallest id and its group."""
    fps = materialise(fingerprints(docs, shingle), "fp")
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fpclass")
    comp = connected_components(materialise(near_links(classes, radius, tile), "links"))
    return fps, (classes.join(comp, classes["fp"] == comp["node"], "left")
                 .select("fp", "rep", F.coalesce("component", "fp").alias("root")))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of every group of near-duplicates, all columns unchanged.

    The row whose doc_id is the group's smallest stays; a row without an id
    takes a key beyond all ids, made from its text, so it stays only if its
    group has no id at all. An id may occur with texts of several groups: each
    group keeps a row of its own. Among several rows of the chosen id in the
    group the one with the smallest fingerprint, then the smallest row (by its
    columns) stays.
    """
    key, mark = fresh(docs, "_key"), fresh(docs, "_fp")
    spare = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), spare))
    fps, member = _members(keyed.select(F.col(key).alias("doc_id"), "text"), shingle, radius, TILE)
    chosen = member.groupBy("root").agg(F.min(F.struct("rep", "fp")).alias("c")).select(F.col("c.rep").alias("doc_id"), "c.fp")
    chosen = materialise(chosen, "chosen")                # an id of several groups has several rows
    rows = (fps.join(chosen.select("doc_id"), "doc_id", "left_semi")
            .groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    rows = materialise(rows.select(F.col("doc_id").alias(key), "n"), "keep")
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]      # names may hold dots
    single = keyed.join(rows.where("n = 1").select(key), key, "left_semi")
    if rows.where("n > 1").isEmpty():
        return single.select(*own)
    several = keyed.join(rows.where("n > 1").select(key), key, "left_semi")
    several = with_fingerprint(several.select(key, "text", F.struct(*own).alias("_row")), mark, shingle)
    several = several.join(chosen.select(F.col("doc_id").alias(key), F.col("fp").alias(mark)), [key, mark], "left_semi")
    # any of the rows with one id and fingerprint, chosen by its text form: maps have no order of their own
    several = several.groupBy(key, mark).agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return single.select(*own).unionByName(several)
