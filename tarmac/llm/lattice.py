"""Near-duplicate vectors by E8 lattice hashing.

A unit vector is projected to eight dimensions by a seeded random matrix and
decoded to the nearest point of the E8 lattice; vectors that share a point
share a cell. Several tables use different matrices. Each vector also probes
the neighbouring points (of the 240 shortest lattice vectors those that lie
best towards its residual). Vectors that meet in a cell are compared exactly:
cosine in double precision.

Equal vectors of a label are one class with a count. A cell with more rows
than TILE is cut into tiles and every pair of tiles is compared, so no cell
is capped. A pair of classes may meet in several cells; it is counted at its
first meeting only, which follows from the cells of its two vectors, so link
counts need no table of pairs. A task returns link counts and a
spanning forest, at most a few rows for each row it read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarmac.llm.common import materialise, prepare
from tarmac.llm.components import connected_components
from tarmac.llm.simhash import _forest

TABLES = 6
PROBES = 4
SCALE = 0.6                # size of the projections against the lattice
MIN_COSINE = 0.93
TILE = 2048
SEED = 20


@lru_cache(maxsize=1)
def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even coordinate sum."""
    p = np.rint(x)
    err = x - p
    odd = np.flatnonzero(p.sum(axis=1) % 2 != 0)
    worst = np.abs(err[odd]).argmax(axis=1)
    p[odd, worst] += np.where(err[odd, worst] >= 0, 1.0, -1.0)
    return p


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of D8 and D8 + 1/2."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


@lru_cache(maxsize=8)
def _matrix(dim: int, table: int, scale: float) -> np.ndarray:
    return np.random.default_rng([SEED, dim, table]).normal(size=(dim, 8)) * scale


def _cell(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit hash of lattice points (twice a point is an integer vector)."""
    h = np.full(points.shape[:-1], 0x9E3779B97F4A7C15 * (table + 1) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    q = np.rint(2 * points).astype(np.int64).view(np.uint64)
    for i in range(8):
        h = (h ^ q[..., i]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """int64[rows, tables, 1 + probes]: home cell, then the probed cells."""
    out = np.empty((len(unit), tables, 1 + probes), dtype=np.int64)
    near = shortest_vectors()
    for t in range(tables):
        y = unit @ _matrix(unit.shape[1], t, scale)
        p = nearest_e8(y)
        best = np.argsort(-((y - p) @ near.T), axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = _cell(p, t)
        out[:, t, 1:] = _cell(p[:, None, :] + near[best], t)
    return out


def _first_meeting(a: np.ndarray, b: np.ndarray, table: int, way: int) -> np.ndarray:
    """Is (table, way) the first meeting of the pairs with cells a, b? Ways:
    0 same home, 1 a probe of the smaller class hits the home of the other,
    2 the reverse. Rows of ``a`` belong to the smaller class number."""
    first = np.ones(len(a), bool)
    for t in range(table + 1):
        met = [a[:, t, 0] == b[:, t, 0], (a[:, t, 1:] == b[:, t, :1]).any(axis=1), (b[:, t, 1:] == a[:, t, :1]).any(axis=1)]
        for w in range(3 if t < table else way):
            first &= ~met[w]
    return first


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tile_links(cid, unit, home, first_tile, second_tile, table, min_cosine, tables=TABLES, probes=PROBES, scale=SCALE):
    """(i, j) index pairs of the links that a tile pair must count: cosine at
    least ``min_cosine``, at least one of both at home in the cell, and first
    meeting here (the cells of linked rows are made again for that).
    ``first_tile``/``second_tile`` are the rows of the tiles (the same array
    for a tile with itself)."""
    known = np.zeros(len(cid), bool)
    keys = np.empty((len(cid), tables, 1 + probes), dtype=np.int64)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    same = first_tile is second_tile
    for s in range(0, len(first_tile), 512):
        rows = first_tile[s:s + 512]
        i, j = np.nonzero(unit[rows] @ unit[second_tile].T >= min_cosine)
        i, j = rows[i], second_tile[j]
        ok = cid[i] != cid[j]
        if same:
            ok &= i < j
        ok &= home[i] | home[j]
        i, j = i[ok], j[ok]
        seen = np.unique(np.concatenate([i, j]))
        seen = seen[~known[seen]]
        if len(seen):
            keys[seen] = cells(unit[seen], tables, probes, scale)
            known[seen] = True
        for at in range(0, len(i), 1 << 16):
            x, y = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            lo, hi = np.where(cid[x] < cid[y], x, y), np.where(cid[x] < cid[y], y, x)
            way = np.where(home[lo] & home[hi], 0, np.where(home[hi], 1, 2))
            keep = np.zeros(len(x), bool)
            for w in range(3):
                m = np.flatnonzero(way == w)
                if len(m):
                    keep[m] = _first_meeting(keys[lo[m]], keys[hi[m]], table, w)
            found_i.append(lo[keep])
            found_j.append(hi[keep])
    return np.concatenate(found_i), np.concatenate(found_j)


def _classes(vectors: DataFrame) -> DataFrame:
    """(label, vec, rep, copies, cid): equal usable vectors of a label."""
    v = F.col("embedding")
    usable = (F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
              & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
              & F.exists(v, lambda x: x != 0))
    return (vectors.where(usable).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
            .groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
            .withColumn("cid", F.xxhash64("label", "vec")))


def lattice_links(classes: DataFrame, min_cosine: float = MIN_COSINE, tables: int = TABLES, probes: int = PROBES,
                  scale: float = SCALE, tile: int = TILE) -> DataFrame:
    """(kind, a, b): kind 0 - class a has b links to rows of other classes
    (a partial count of one cell); kind 1 - a and b are connected."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in vecs])
            for dim in np.unique(sizes).tolist():           # vectors of other sizes are never compared
                at = np.flatnonzero(sizes == dim)
                x = np.array([vecs[i] for i in at], dtype=np.float64)
                key = cells(unit_vectors(x), tables, probes, scale)
                with np.errstate(over="ignore"):
                    small = x.astype(np.float32)            # half the bytes where nothing is lost
                raw = [(f if (f == v).all() else v).tobytes() for f, v in zip(small, x)]
                label, cid, copies = (batch.column(k).take(pa.array(at)) for k in (0, 2, 3))
                for t in range(tables):
                    for p in range(1 + probes):
                        yield pa.RecordBatch.from_arrays(
                            [label, pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), t, np.int32)),
                             pa.array(key[:, t, p]), pa.array(np.full(len(at), p == 0)), cid, copies,
                             pa.array(raw, pa.binary())],
                            names=["label", "dim", "t", "cell", "home", "cid", "copies", "raw"])

    schema = (f"label {classes.schema['label'].dataType.simpleString()}, dim int, t int, cell long, home boolean, "
              "cid long, copies long, raw binary")
    rows = classes.select("label", "vec", "cid", "copies").mapInArrow(index, schema)
    where = ["label", "dim", "t", "cell"]
    # Cells with more rows than a tile are cut; the others stay whole. Cells that nobody calls home hold no link.
    sizes = materialise(rows.groupBy(*where).agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("lived"))
                        .where("lived AND n > 1").select(*where, F.ceil(F.col("n") / tile).cast("int").alias("tiles")),
                        "cells")
    mine = F.pmod(F.xxhash64("cid", "home"), F.col("tiles")).cast("int")
    dealt = (rows.join(sizes, where).withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("ta", F.least("mine", "other")).withColumn("tb", F.greatest("mine", "other")))

    def compare(key, got):
        home = got.column("home").to_numpy(zero_copy_only=False)
        cid, count = got.column("cid").to_numpy(), got.column("copies").to_numpy()
        out = {"kind": np.zeros(0, np.int32), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}
        if home.any() and len(cid) > 1:
            dim, table = key[1].as_py(), key[2].as_py()
            unit = unit_vectors(np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64)
                                          for v in got.column("raw").to_pylist()]))
            side = got.column("mine").to_numpy()
            ta, tb = key[4].as_py(), key[5].as_py()
            first = np.flatnonzero(side == ta)
            second = first if ta == tb else np.flatnonzero(side == tb)
            i, j = tile_links(cid, unit, home, first, second, table, min_cosine, tables, probes, scale)
            if len(i):
                links = np.bincount(i, count[j], len(cid)) + np.bincount(j, count[i], len(cid))
                hit = np.flatnonzero(links)
                part, back = np.unique(np.concatenate([cid[i], cid[j]]), return_inverse=True)
                lab = _forest(len(part), back[:len(i)], back[len(i):])
                up = np.flatnonzero(lab != np.arange(len(part)))
                out = {"kind": np.repeat(np.array([0, 1], np.int32), [len(hit), len(up)]),
                       "a": np.concatenate([cid[hit], part[up]]),
                       "b": np.concatenate([links[hit].astype(np.int64), part[lab[up]]])}
        return pa.table(out)

    return (dealt.groupBy(*where, "ta", "tb").applyInArrow(compare, "kind int, a long, b long"))


def near_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Rows whose label or vector is NULL, or whose vector is empty, zero or
    holds a NULL or non-finite number, link with nothing: 0 links, a component of their own.
    Equal vectors of a label link with each other; repeated rows count as
    separate rows. ``component_id`` is the smallest vec_id reachable (NULL
    only if every id there is NULL); ``kept``: vec_id = component_id. An empty
    table gives an empty result; other columns are not read.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    classes = materialise(_classes(rows), "vectors")
    found = materialise(lattice_links(classes, min_cosine), "vectorlinks")
    links = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("others"))
    comp = connected_components(found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    member = (classes.select("label", "vec", "cid", "rep", "copies")
              .join(links, "cid", "left")
              .join(comp, F.col("cid") == F.col("node"), "left")
              .withColumn("root", F.coalesce("component", "cid")))
    least = member.groupBy("root").agg(F.min("rep").alias("least"))
    member = materialise(member.join(least, "root").select(
        "label", "vec", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "least"), "vectorclasses")
    out = rows.withColumn("vec", F.col("embedding").cast("array<double>")).join(member, ["label", "vec"], "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return (out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                       component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
