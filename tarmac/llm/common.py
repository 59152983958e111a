"""Helpers shared by the corpus operators: folds, bounded samples of labelled
rows, tables written to the shared folder, and Arrow batch mapping.

Words are maximal runs of bytes other than space and 0x09-0x0D. Python's
``bytes.split()`` without an argument splits on exactly these six bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarmac.session import work_dir

WORD_SQL = r"[^\x20\x09-\x0D]+"

# Rows in one Arrow batch sent to a Python worker: bounds the worker's memory
# (long documents are scored piece by piece inside the batch).
ARROW_ROWS = 2048


def prepare(spark: SparkSession) -> None:
    """Session settings of the Arrow stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts
    the lineage, survives lost executors, and gives the planner real sizes."""
    spark = df.sparkSession
    path = work_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text modulo ``k`` (NULL for a NULL id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


def word_count(text: Column) -> Column:
    """Number of words of a text, NULL counting as empty (built-ins only):
    each word with the white space behind it becomes one letter."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.length(F.regexp_replace(flat, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")).cast("long")


def hashed_sample(rows: DataFrame, by: list[str], most: int, seed: int) -> DataFrame:
    """At most ``most`` distinct rows of each group ``by``, the first in the
    order of a hash of ``doc_id``.

    The distinct rows of the groups are counted first, and only rows whose hash lies below twice
    the needed share are ranked. So what a task ranks is about twice the
    sample at every size of the input, also for a group with most of the rows.
    The groups are label values of a model that holds a table for each, so
    their counts (one row each) are small enough to broadcast.
    """
    from pyspark.sql import Window
    unit = 1 << 30
    mark = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(unit))
    rows = rows.withColumn("_mark", mark).distinct()
    if by:
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))        # one row for each group
    else:
        sizes = rows.agg(F.count(F.lit(1)).alias("_n"))
    limit = F.when(F.col("_n") > 2 * most, F.lit(2.0 * most) / F.col("_n") * unit).otherwise(F.lit(float(unit)))
    low = sizes.select(*by, limit.alias("_limit"))
    small = F.broadcast(low)
    near = (rows.join(small, by) if by else rows.crossJoin(small)).where("_mark < _limit")
    near = near.drop("_limit")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_mark", "doc_id"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank", "_mark")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column,
                    max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled documents (doc_id, text, label), chosen by
    a hash of the id, so the choice does not depend on the layout.

    Rows with a NULL id or a label other than 0/1 are not used; a document
    with several labels takes the largest; repeated documents count once.
    Only ids and labels are ranked; the chosen ids are a bounded table, so
    broadcasting it is safe at every size.
    """
    lab = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
           .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
           .groupBy("doc_id").agg(F.max("label").alias("label"))
           .where(learnable))
    ids = hashed_sample(lab, [], max_rows, 7)
    return (docs.select("doc_id", "text").where(F.col("text").isNotNull())
            .join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id", "label").agg(F.min("text").alias("text")))


def column_texts(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def filter_rows(docs: DataFrame, text_col: str,
                keep_of: Callable[[], Callable[[list[str | None]], np.ndarray]]) -> DataFrame:
    """The rows of ``docs`` that a batch predicate over the texts keeps, all
    columns unchanged. ``keep_of`` runs once in each task and returns the
    predicate (texts -> boolean array)."""
    at = docs.columns.index(text_col)
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])      # mapInArrow takes no names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = keep_of()
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(keep(b.column(at).to_pylist())))
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def grouped_prefix(df: DataFrame, group: list[str], bucket: str, order: list[Column],
                   value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, in the order of
    (bucket, order).

    Two levels: sums per (group, bucket), an exclusive running sum over the
    buckets of each group, and a window inside one bucket. No task holds a
    whole group, so a group with a third of all rows is spread over its
    buckets. Group columns must not be NULL.
    """
    from pyspark.sql import Window
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
               .withColumn("_off", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
               .drop("_sum"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("_run", F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(offsets, [*group, bucket])
            .withColumn(out, F.col("_run") + F.col("_off")).drop("_run", "_off"))


class SparseRows:
    """Rows of (index, value) pairs of a bounded training sample."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.sizes = np.array([len(i) for i, _ in rows], dtype=np.int64)
        self.idx = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.idx = self.idx.astype(np.int64)
        self.val = (np.concatenate([v for _, v in rows]) if rows else np.zeros(0)).astype(np.float32)
        self.row = np.repeat(np.arange(self.n), self.sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.idx], minlength=self.n).astype(np.float64)

    def back(self, r: np.ndarray, dim: int) -> np.ndarray:
        return np.bincount(self.idx, self.val * r[self.row], minlength=dim).astype(np.float64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


class Adam:
    """Adam steps for a list of numpy arrays (deterministic)."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.99 ** self.t)) + 1e-8)


PRIOR = 4.0                # rows that the calibration's prior weighs


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit p = sigmoid(a z + b) by Newton steps,
    with Platt's smoothed targets. A ridge holds the fit near the identity
    where rows are few; the identity when a class is missing."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    if pos == 0 or neg == 0:
        return 1.0, 0.0
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ w)
        g = x.T @ (p - t) + PRIOR * (w - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + PRIOR * np.eye(2)
        d = np.linalg.solve(h, g)
        w = w - np.clip(d, -5, 5)
        if np.abs(d).max() < 1e-9:
            break
    if w[0] <= 0:
        return 1.0, 0.0
    return float(w[0]), float(w[1])
