"""Whitening of embeddings through a bidiagonal qd solver.

1. Entries become integers, ``x = floor(256 * c)``; equal x vectors are
   fitted once. Sums are exact integers.
2. Blockwise QR: every task centres its rows (n x - S exactly, then divided
   by n) and folds them, block by block, into one triangular factor; factors
   are merged in groups of MERGE until one is left. The rows' covariance is
   R' R / n, but it is never formed.
3. Householder reflections make R bidiagonal; dqds with deflation finds the
   squared singular values to high relative accuracy; twisted factorisations
   of the shifted tridiagonal give each direction, and the reflections carry
   it back.

Vectors of different lengths are fitted on their own (a model for each
length; embeddings have one, seldom a few). What the driver holds is one
d x d factor and d sums for each length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarmac.llm.common import materialise, prepare

GRID = 256
COMPONENTS = 4
BLOCK = 4096               # rows folded into a factor at once
MERGE = 16                 # factors merged by one task
EPS = np.finfo(float).eps
LIMIT = 2.0 ** 62          # integers beyond this would not fit 64 bits


# ---------------------------------------------------------------- solver
def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with r = U B V', by Householder
    reflections from both sides; U is not kept."""
    a = np.array(r, dtype=np.float64)
    m, n = a.shape
    if m < n:
        a = np.vstack([a, np.zeros((n - m, n))])
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
        big = np.abs(x).max(initial=0.0)
        if big == 0.0 or not np.abs(x[1:]).max(initial=0.0):
            return x, 0.0, float(x[0]) if len(x) else 0.0
        y = x / big
        norm = np.sqrt(y @ y)
        head = -np.copysign(norm, y[0])
        w = y.copy()
        w[0] -= head
        return w, 2.0 / float(w @ w), float(head * big)

    for k in range(n):
        w, beta, head = reflector(a[k:, k])
        if beta:
            a[k:, k + 1:] -= np.outer(beta * w, w @ a[k:, k + 1:])
        a[k, k], a[k + 1:, k] = head, 0.0
        if k + 2 < n:
            w, beta, head = reflector(a[k, k + 1:])
            if beta:
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k + 1:] @ w, beta * w)
                v[:, k + 1:] -= np.outer(v[:, k + 1:] @ w, beta * w)
            a[k, k + 1], a[k, k + 2:] = head, 0.0
    return np.diag(a)[:n].copy(), np.diag(a, 1)[:n - 1].copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float]:
    """One differential qd transform with a shift: (q, e, least d, last d)."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        t = d + e[i]
        new_q[i] = t
        if t == 0.0:
            ratio = 0.0 if q[i + 1] == 0.0 else np.inf
        else:
            ratio = q[i + 1] / t
        if not np.isfinite(ratio):                          # only when e[i] was negligible
            return q, e, -np.inf, -np.inf
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
    new_q[n - 1] = d
    return new_q, new_e, least, d


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling: shifted
    differential qd transforms with deflation at the end and splits inside. A
    shift is tried below the smallest value of the last two rows and withdrawn
    when an entry becomes negative, so no subtraction loses the small ones."""
    todo = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    tol = (100 * EPS) ** 2
    found: list[float] = []
    while todo:
        q, e, sigma = todo.pop()
        for _ in range(100 * (len(q) + 2)):
            n = len(q)
            if n <= 1:
                break
            split = next((i for i in range(n - 2, -1, -1) if e[i] <= tol * (sigma + min(q[i], q[i + 1]))
                          or e[i] <= np.finfo(float).tiny), None)
            if split is not None:
                todo.append((q[:split + 1], e[:split], sigma))
                q, e = q[split + 1:], e[split + 1:]
                continue
            if 1.5 * q[0] < q[-1]:                          # graded the other way: turn it round
                q, e = q[::-1], e[::-1]
            if n == 2:                                      # a 2 x 2 block in closed form
                s = q[0] + q[1] + e[0]
                top = (s + np.sqrt(max((q[0] - q[1] + e[0]) ** 2 + 4 * q[1] * e[0], 0.0))) / 2
                found += [sigma + top, sigma + (q[0] / top) * q[1]]
                q, e = [], []
                break
            a, b, c = q[-2], q[-1], e[-1]
            s = a + b + c
            top = (s + np.sqrt(max((a - b + c) ** 2 + 4 * b * c, 0.0))) / 2
            shift = min((a / top) * b if top > 0 else 0.0, min(q)) * 0.98
            for t in (shift, shift / 4, 0.0):
                got = _sweep(q, e, t)
                if got[2] >= 0.0:
                    q, e, sigma = got[0], got[1], sigma + t
                    break
            else:
                raise ArithmeticError("qd transform failed")
        else:
            raise ArithmeticError("qd transforms did not converge")
        found += [sigma + q[0]] if q else []
    return np.sort(np.array(found))[::-1]


def _guard(x: float, size: float) -> float:
    """A pivot that may be divided by."""
    return x if abs(x) > size else (size if x >= 0 else -size)


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float, rhs: np.ndarray | None = None) -> np.ndarray:
    """Unit z with B'B z near value * z: the stationary and the progressive qd
    transform of B'B - value meet at the row where their joint pivot is
    smallest, and z follows from there in both directions. With ``rhs`` one
    step of inverse iteration from it (for equal values)."""
    n = len(diagonal)
    a, b = diagonal, np.append(upper, 0.0)
    size = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0))) ** 2
    tiny = max(size * EPS * (EPS if rhs is None else 1.0), np.finfo(float).tiny)    # a solve must not drown in one pivot
    off = a[:-1] * b[:n - 1]                                # off-diagonal of B'B
    down, up = np.zeros(n), np.zeros(n)                     # pivots of L D L' and U D U'
    s = -value
    lead = np.zeros(n)
    for i in range(n):                                      # stationary transform
        lead[i] = s
        down[i] = _guard(a[i] * a[i] + s, tiny)
        s = b[i] * b[i] * (s / down[i]) - value if i + 1 < n else s
    p = a[n - 1] ** 2 - value
    gamma = np.zeros(n)
    gamma[n - 1] = lead[n - 1] + a[n - 1] ** 2
    for i in range(n - 2, -1, -1):                          # progressive transform
        up[i + 1] = _guard(b[i] * b[i] + p, tiny)
        p = a[i] * a[i] * (p / up[i + 1]) - value
        gamma[i] = lead[i] + p + value
    if rhs is not None:                                     # solve (B'B - value) z = rhs with the L D L' pivots
        y = rhs.copy()
        for i in range(1, n):
            y[i] -= off[i - 1] / down[i - 1] * y[i - 1]
        z = y / down
        for i in range(n - 2, -1, -1):
            z[i] -= off[i] / down[i] * z[i + 1]
        z /= np.abs(z).max()
        return z / np.sqrt(z @ z)
    r = int(np.abs(gamma).argmin())
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -(off[i] / down[i]) * z[i + 1]
    for i in range(r + 1, n):
        z[i] = -(off[i - 1] / up[i]) * z[i - 1]
    z /= np.abs(z).max()
    return z / np.sqrt(z @ z)


def _residual(diagonal: np.ndarray, upper: np.ndarray, value: float, z: np.ndarray) -> float:
    y = diagonal * z
    y[:-1] += upper * z[1:]
    w = diagonal * y
    w[1:] += upper * y[:-1]
    return float(np.abs(w - value * z).max())


def _apart(z: np.ndarray, near: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """z without its parts along ``near``, of length one; any such vector if
    nothing of z is left."""
    while True:
        for y in near * 2:
            z = z - (y @ z) * y
        size = np.sqrt(z @ z)
        if size > 1e-8:
            z = z / size
            for y in near:
                z = z - (y @ z) * y
            return z / np.sqrt(z @ z)
        z = rng.normal(size=len(z))


def _directions(a: np.ndarray, b: np.ndarray, values: np.ndarray, most: int) -> list[np.ndarray]:
    """Unit vectors for the first ``most`` values of one unsplit block. Those
    of values that stand apart by less than a thousandth are made orthogonal
    and refined by inverse iteration."""
    rng = np.random.default_rng(11)
    bad = 64 * EPS * len(a) * float(values[0])
    out: list[np.ndarray] = []
    first = 0                                               # where the present cluster begins
    for k in range(most):
        value = float(values[k])
        if k and values[k - 1] - value > 1e-3 * values[k - 1]:
            first = k
        lonely = first == k and (k + 1 == len(values) or value - values[k + 1] > 1e-3 * value)
        z = twisted(a, b, value)
        near = out[first:k]
        for _ in range(0 if lonely else 8):
            z = _apart(z, near, rng)
            if _residual(a, b, value, z) <= bad:
                break
            z = _apart(twisted(a, b, value, z), near, rng)
        out.append(z)
    return out


def principal(r: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values of r, falling; unit right singular vectors of
    the first ``most`` as rows). The bidiagonal matrix is split where an upper
    entry is rounding error beside its neighbours: equal values lie in
    different blocks, so their directions are orthogonal. The entry of largest
    size in a direction is positive."""
    a, b, v = bidiagonalise(r)
    d = len(a)
    most = d if most is None else min(most, d)
    size = np.abs(a)
    cut = np.flatnonzero(np.abs(b) <= 4 * EPS * max(d, 1) * np.maximum(size[:-1], size[1:])) + 1 if d > 1 else []
    blocks = [(int(i), int(j)) for i, j in zip([0, *cut], [*cut, d]) if j > i]
    each = [dqds(a[i:j], b[i:j - 1]) for i, j in blocks]
    order = sorted((-float(x), n, k) for n, xs in enumerate(each) for k, x in enumerate(xs))
    values = np.array([-x for x, _, _ in order])
    wanted = [max([k + 1 for _, m, k in order[:most] if m == n], default=0) for n in range(len(blocks))]
    local = [_directions(a[i:j], b[i:j - 1], xs, w) if j - i > 1 and xs[0] > 0 else list(np.eye(j - i))
             for (i, j), xs, w in zip(blocks, each, wanted)]
    found = np.zeros((most, d))
    for row, (_, n, k) in zip(found, order):
        i, j = blocks[n]
        row[i:j] = local[n][k]
    found = found @ v.T
    for y in found:
        y *= (np.sign(y[np.abs(y).argmax()]) or 1.0) / np.sqrt(y @ y)
    return values, found


# ---------------------------------------------------------------- integers
def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S exactly: 64-bit integers where they fit, else Python's."""
    most = max(int(np.abs(sums).max(initial=0)), n * int(np.abs(x).max(initial=0)))
    if most < LIMIT / 2:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def deviations(y: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    most = int(np.abs(y).max(initial=0))
    if y.dtype != object and most * most * max(y.shape[1], 1) < LIMIT:
        return (y * y).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in y.astype(object).tolist()]


# ---------------------------------------------------------------- fit
@dataclass
class Whitening:
    """A fitted length: rows n, sums S, and of each kept component its unit
    direction, eigenvalue and share of the trace."""
    n: int
    sums: np.ndarray
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of integer rows, unrounded; NaN for a component
        without variance."""
        y = (centred(x, self.n, self.sums) / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues > 0, (y @ self.directions.T) / np.sqrt(self.eigenvalues), np.nan)


def integer_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows with a vector of finite numbers, and ``x``, its integers. A
    vector with an entry beyond the 64-bit range of x counts as not finite."""
    v = F.col(column)
    usable = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= F.lit(2.0 ** 53)))
    return vectors.where(usable).withColumn("x", F.transform(v, lambda c: F.floor(F.lit(float(GRID)) * c.cast("double")).cast("long")))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer matrix) for each length among a batch of lists."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = []
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out.append((at, flat[offsets[at][:, None] + np.arange(d)].astype(np.int64)))
    return out


def _exact_sums(distinct: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """dim -> (n, S): partial sums of each task and dimension, then summed by
    Spark as decimals, so nothing overflows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _matrix(b.column(0)):
                d = x.shape[1]
                n[d] = n.get(d, 0) + len(x)
                fits = int(np.abs(x).max(initial=0)) * len(x) < LIMIT
                part = (x if fits else x.astype(object)).sum(axis=0).astype(object)
                sums[d] = sums.get(d, 0) + part
        for d in n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d + 1, d, np.int32)), pa.array(np.arange(-1, d, dtype=np.int32)),
                 pa.array([str(n[d]), *map(str, sums[d].tolist())])], names=["d", "i", "s"])

    parts = distinct.mapInArrow(run, "d int, i int, s string")
    rows = parts.groupBy("d", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()   # d + 1 rows a length
    out = {}
    for d in {r["d"] for r in rows}:
        mine = {r["i"]: int(r["s"]) for r in rows if r["d"] == d}
        big = [mine[i] for i in range(d)]
        out[d] = (mine[-1], np.array(big, dtype=np.int64 if max(map(abs, big), default=0) < LIMIT else object))
    return out


def _factor(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


FACTOR = "d int, part long, r binary"


def triangular_factors(distinct: DataFrame, totals: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """dim -> R of the QR of the centred rows. Each task folds its rows in
    blocks; the factors (one for a task) are merged MERGE at a time."""
    shared = distinct.sparkSession.sparkContext.broadcast(totals)   # d + 1 integers a length

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, found = TaskContext.get().partitionId(), {}
        for b in batches:
            for _, x in _matrix(b.column(0)):
                d = x.shape[1]
                n, sums = shared.value[d]
                for at in range(0, len(x), BLOCK):
                    y = (centred(x[at:at + BLOCK], n, sums) / n).astype(np.float64)
                    found[d] = _factor(found.get(d, np.zeros((0, d))), y)
        for d, r in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int64()),
                                              pa.array([r.tobytes()], pa.binary())], names=["d", "part", "r"])

    def merge(key, got):
        d, total = key[0].as_py(), None
        for i in np.argsort(got.column("part").to_numpy(), kind="stable").tolist():    # same order, same bits
            r = np.frombuffer(got.column("r")[i].as_py()).reshape(-1, d)
            total = r if total is None else _factor(total, r)
        return pa.table({"d": pa.array([d], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()),
                         "r": pa.array([total.tobytes()], pa.binary())})

    factors = materialise(distinct.mapInArrow(fold, FACTOR), "qr")
    while True:
        most = factors.agg(F.max("part").alias("p")).first()["p"]
        if not most:
            break
        groups = factors.select("d", F.expr(f"part DIV {MERGE}").alias("group"), "part", "r")
        factors = materialise(groups.groupBy("d", "group").applyInArrow(merge, FACTOR), "qr")
    return {r["d"]: np.frombuffer(r["r"]).reshape(-1, r["d"]) for r in factors.collect() if r["d"]}    # one a length


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding"
                  ) -> tuple[dict[int, Whitening], DataFrame]:
    """({length: model}, distinct x vectors, stored)."""
    prepare(vectors.sparkSession)
    distinct = materialise(integer_vectors(vectors.select(column), column).select("x").distinct(), "whitenfit")
    totals = _exact_sums(distinct)
    models = {}
    for d, r in triangular_factors(distinct, totals).items():
        n, sums = totals[d]
        values, directions = principal(r, components)
        values = np.where(values > (EPS * max(d, 1)) ** 2 * values.max(initial=0.0), values, 0.0)
        e = values[:components] / n
        trace = float((r * r).sum()) / n
        models[d] = Whitening(n, sums, directions, e, e / trace if trace > 0 else np.zeros(len(e)))
    return models, distinct


def identity_errors(models: dict[int, Whitening], distinct: DataFrame) -> dict[int, float]:
    """dim -> largest entry of |covariance of whitened rows - identity| over
    the fit list; components without variance are left out."""
    shared = distinct.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _matrix(b.column(0)):
                m = shared.value.get(x.shape[1])
                if m is None:
                    continue
                w = m.project(x)[:, m.eigenvalues > 0]
                w = np.hstack([w, np.ones((len(w), 1))])
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + w.T @ w        # rows are centred before they are multiplied
        for d, s in sums.items():
            i, j = np.indices(s.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(s.size, d, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)),
                 pa.array(s.ravel())], names=["d", "i", "j", "s"])

    rows = (distinct.mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s"))
            .collect())                                     # (components + 1)^2 rows a length
    out = {}
    for d in {r["d"] for r in rows}:
        k = max(r["i"] for r in rows if r["d"] == d)
        s = np.zeros((k + 1, k + 1))
        for r in rows:
            if r["d"] == d:
                s[r["i"], r["j"]] = r["s"]
        mean = s[:k, k] / s[k, k]
        out[d] = float(np.abs(s[:k, :k] / s[k, k] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return out


SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
          "deviation_exact string")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component, see SCHEMA.

    Rows with a NULL vector, or one that holds NULL, NaN, an infinity or an
    entry of 2^53 and more, are dropped; NULL and repeated vec_ids stay, row by
    row. A component without variance (fewer distinct vectors than dimensions,
    a single row) has a NULL ``whitened`` and explains 0. ``deviation`` is NULL
    where it does not fit 64 bits; ``deviation_exact`` always holds its digits.
    Empty vectors have no component, an empty table gives an empty result.
    Other columns are not read.
    """
    models, distinct = fit_whitening(vectors, components)
    errors = identity_errors(models, distinct)
    shared = vectors.sparkSession.sparkContext.broadcast((models, errors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, wrong = shared.value
        for b in batches:
            for at, x in _matrix(b.column(1)):
                m = fitted.get(x.shape[1])
                if m is None:
                    continue
                k = len(m.eigenvalues)
                exact = deviations(centred(x, m.n, m.sums))
                w = m.project(x).ravel()
                size = len(at) * k
                ids = b.column(0).take(pa.array(np.repeat(at, k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(size, m.n, np.int64)),
                     pa.array([v if v < 1 << 63 else None for v in exact for _ in range(k)], pa.int64()),
                     pa.array(w, mask=np.isnan(w)), pa.array(np.tile(m.explained, len(at))),
                     pa.array(np.full(size, wrong.get(x.shape[1], 0.0))), pa.array([str(v) for v in exact for _ in range(k)])],
                    names=[f.split()[0] for f in SCHEMA.split(", ")])

    rows = integer_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    return rows.select("vec_id", "x").mapInArrow(run, SCHEMA)
