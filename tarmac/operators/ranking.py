"""Global ranks and prefix sums without a single-partition window.

A window with ORDER BY and no PARTITION BY moves every row into one task.
These helpers split the order into range buckets, compute per-bucket totals
(a table with one row per bucket, bounded by the bucket count), turn them
into offsets, and finish with a window partitioned by bucket:

* the row count and the bucket boundaries come from one aggregation
  (``percentile_approx``, a bounded sketch), so buckets are balanced whatever
  the value distribution;
* a value heavy enough to fill more than one bucket gets a bucket of its own,
  split further by the tie-break key, and so do the rows with a NULL key, so
  neither lands in one task;
* buckets are chosen on doubles, rows inside a bucket are ordered by the
  original columns: 64-bit integers and text keep their exact order;
* a key that is uniform by construction (a hash) is bucketed by its prefix.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows per bucket the final window aims at in one task.
TARGET_ROWS_PER_BUCKET = 2_000_000
MIN_BUCKETS = 16
# Boundaries that one aggregation collects: enough buckets for 4 billion rows
# of the target; beyond that the buckets grow with the input.
PROBES = 2_048
# Doubles hold whole numbers exactly up to here.
EXACT = 2.0 ** 53


def bucket_count(n_rows: int, target: int = TARGET_ROWS_PER_BUCKET) -> int:
    return int(min(PROBES, max(MIN_BUCKETS, math.ceil(n_rows / max(1, target)))))


def approximate(c: Column, dtype: T.DataType) -> Column:
    """A double that never decreases where ``c`` increases (for choosing
    buckets only): numbers cast, text by its first six bytes."""
    if isinstance(dtype, T.StringType):
        first = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0")
        return F.conv(first, 16, 10).cast("double")
    return c.cast("double")


def _survey(df: DataFrame, cols: list[str]) -> tuple[int, dict[str, tuple[int, list[float]]]]:
    """Rows, and per column (NULLs, PROBES - 1 quantiles), in one aggregation."""
    probs = F.array(*[F.lit(i / PROBES) for i in range(1, PROBES)])
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}_n"), F.percentile_approx(c, probs, 10 * PROBES).alias(f"{c}_q")]
    r = df.agg(*aggs).first()  # one row
    return int(r["_rows"]), {c: (int(r["_rows"]) - int(r[f"{c}_n"]), list(r[f"{c}_q"] or [])) for c in cols}


def _thin(quantiles: list[float], n_buckets: int) -> list[float]:
    """Every k-th quantile, for ``n_buckets`` buckets."""
    if not quantiles:
        return []
    return [quantiles[min(len(quantiles) - 1, round(i * PROBES / n_buckets) - 1)] for i in range(1, n_buckets)]


def _splits(raw: list[float]) -> tuple[list[float], list[float]]:
    """Strictly increasing splits with -inf/+inf, and the heavy values (those
    spanning two or more quantiles). Each heavy value v gets the bucket
    [v, next double after v), which holds v alone."""
    heavy = sorted(v for v, n in Counter(raw).items() if n >= 2)
    pts = {p for v in heavy for p in (v, math.nextafter(v, math.inf))} | set(raw)
    return [-math.inf] + sorted(p for p in pts if math.isfinite(p)) + [math.inf], heavy


def with_range_bucket(df: DataFrame, in_col: str, out_col: str, splits: list[float],
                      only_if: Column | None = None) -> DataFrame:
    """Add ``out_col`` = interval index of ``in_col`` (0 where ``only_if`` is
    false). A NULL key gets bucket -1: NULLs sort first, as in SQL's
    ascending order."""
    key = F.col(in_col)
    if len(splits) < 3:
        b, out = F.lit(0), df
    else:
        tmp, safe = f"{out_col}_raw", f"{out_col}_in"
        out = Bucketizer(splits=splits, inputCol=safe, outputCol=tmp, handleInvalid="keep").transform(
            df.withColumn(safe, F.coalesce(key, F.lit(0.0))))
        b = F.col(tmp).cast("int")
    b = F.when(key.isNull(), F.lit(-1)).otherwise(b)
    out = out.withColumn(out_col, b if only_if is None else F.when(only_if, b).otherwise(F.lit(0)))
    return out.drop(f"{out_col}_raw", f"{out_col}_in")


def _offsets(totals: DataFrame, order: list[str], sum_cols: list[str],
             partition: list[str] = ()) -> DataFrame:
    """Exclusive running totals over the (bounded) per-bucket table."""
    w = (Window.partitionBy(*partition) if partition else Window).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*partition, *order,
                         *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_off_{c}") for c in sum_cols])


def prefix_sums(df: DataFrame, order_col: str, sum_cols: list[str], descending: bool = False,
                index_col: str | None = None, partition: list[str] = ()) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over all rows up to and including this
    one, in the order of ``order_col`` (unique per row and partition,
    non-null), separately per ``partition`` group. With ``index_col`` also
    the 1-based position."""
    partition = list(partition)
    key = "_ord"
    base = df.withColumn(key, (-F.col(order_col) if descending else F.col(order_col)).cast("double"))
    n, found = _survey(base, [key])
    splits, _ = _splits(_thin(found[key][1], bucket_count(n)))
    base = with_range_bucket(base, key, "_b", splits)
    cols = list(sum_cols) + (["_one"] if index_col else [])
    if index_col:
        base = base.withColumn("_one", F.lit(1).cast("bigint"))
    totals = base.groupBy(*partition, "_b").agg(*[F.sum(c).alias(c) for c in cols])
    # one row per bucket and group; with groups the offsets window runs per
    # group, and the join below is on the final window's own keys, so it adds
    # no shuffle of the rows (AQE broadcasts the offsets when measured small)
    offs = _offsets(totals, ["_b"], cols, partition)
    ren = {c: f"_o_{c}" for c in [*partition, "_b"]}
    offs = offs.withColumnsRenamed(ren)
    if not partition:
        offs = F.broadcast(offs)  # bounded: one row per bucket
    cond = None
    for c, o in ren.items():  # null-safe: a NULL group keeps its rows
        e = F.col(c).eqNullSafe(F.col(o))
        cond = e if cond is None else cond & e
    w = Window.partitionBy(*partition, "_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = base.join(offs, cond, "left").drop(*ren.values())
    new = {f"cum_{c}": F.sum(c).over(w) + F.col(f"_off_{c}") for c in sum_cols}
    if index_col:
        new[index_col] = F.sum("_one").over(w) + F.col("_off__one")
    out = out.withColumns(new)
    return out.drop("_b", key, "_one", *[f"_off_{c}" for c in cols])


def global_row_number(df: DataFrame, key: Column, tie: Column, out_col: str = "row_number",
                      start: int = 1) -> DataFrame:
    """1-based position of each row in the order (key, tie), plus ``start - 1``;
    NULLs first.

    ``key`` is a number; ``tie`` is a number or text and unique. The rows of a
    heavy key value, and those without a key, are split by ``tie`` into
    buckets sized like the others. Ranks are found on (key, tie) and the row's
    other columns ride along."""
    base = df.withColumn("_key", key).withColumn("_tie", tie)
    base = base.withColumn("_k", F.col("_key").cast("double"))
    base = base.withColumn("_t", approximate(F.col("_tie"), base.schema["_tie"].dataType))
    n, found = _survey(base, ["_k", "_t"])
    B = bucket_count(n)
    splits, heavy = _splits(_thin(found["_k"][1], B))
    whole = isinstance(base.schema["_key"].dataType, T.IntegralType)
    heavy = [v for v in heavy if not whole or abs(v) < EXACT]      # above, several keys share a double
    base = with_range_bucket(base, "_k", "_b1", splits)
    # ties are split by the quantiles of all rows: a heavy value's rows spread over them unless tie follows key
    hot = F.col("_k").isNull() if found["_k"][0] * B > n else F.lit(False)
    if heavy:
        hot = hot | F.coalesce(F.col("_k").isin(heavy), F.lit(False))
    tsplits, _ = _splits(_thin(found["_t"][1], B))
    base = with_range_bucket(base, "_t", "_b2", tsplits, only_if=hot)
    totals = base.groupBy("_b1", "_b2").agg(F.count(F.lit(1)).alias("_n"))
    # level 1: per range bucket (at most 2B rows), offsets in one small window
    t1 = totals.groupBy("_b1").agg(F.sum("_n").alias("_n1"))
    off1 = F.broadcast(_offsets(t1, ["_b1"], ["_n1"]))
    # level 2: tie buckets within a range bucket, a window partitioned by the range bucket
    w2 = Window.partitionBy("_b1").orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
    off2 = totals.select("_b1", "_b2", F.coalesce(F.sum("_n").over(w2), F.lit(0)).alias("_off2"))
    offs = off2.join(off1, "_b1").select("_b1", "_b2", (F.col("_off__n1") + F.col("_off2")).alias("_off"))
    # joined on the window's own partition keys: no extra shuffle of the rows,
    # and AQE broadcasts the offsets when their measured size is small
    w = Window.partitionBy("_b1", "_b2").orderBy("_key", "_tie")
    out = base.join(offs, ["_b1", "_b2"], "left")
    out = out.withColumn(out_col, (F.row_number().over(w) + F.col("_off") + F.lit(start - 1)).cast("bigint"))
    return out.drop("_key", "_tie", "_k", "_t", "_b1", "_b2", "_off")


# Offsets tables up to this many rows are broadcast by hint.
OFFSETS_BROADCAST_MAX_ROWS = 200_000


def first_n_per_group(df: DataFrame, group_col: str, hash_col: str, quota_col: str,
                      out_col: str, n_rows: int | None = None, n_groups: int | None = None) -> DataFrame:
    """``out_col`` = this row is among the first ``quota`` rows of its group in
    the order of ``hash_col`` (lower-case hex of a uniform hash, unique).

    Buckets are hash prefixes (uniform by construction). Whole buckets before
    a group's boundary bucket are in, after it out; only the rows of the one
    boundary bucket per group are ranked, so only they are shuffled. The
    offsets (groups x buckets) are broadcast when ``n_groups`` proves them
    small."""
    n = df.count() if n_rows is None else n_rows
    # buckets of about 200,000 rows
    digits = max(1, math.ceil(math.log(max(2, n / 200_000), 16)))
    base = df.withColumn("_p", F.substring(F.col(hash_col), 1, digits))
    totals = base.groupBy(group_col, "_p").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group_col).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # bounded: groups x 16^digits rows
    offs = totals.select(group_col, "_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
                         "_n")
    offs = offs.withColumnRenamed(group_col, "_g").withColumnRenamed("_p", "_pp")
    if n_groups is not None and n_groups * 16 ** digits <= OFFSETS_BROADCAST_MAX_ROWS:
        offs = F.broadcast(offs)  # size proven by the group count
    # else: a join AQE plans from the measured size of the offsets
    # null-safe on the group: rows of a NULL group are kept and ranked too
    joined = base.join(offs, F.col(group_col).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_pp")),
                       "left").drop("_g", "_pp")
    q = F.col(quota_col)
    whole_in = (F.col("_before") + F.col("_n")) <= q
    whole_out = F.col("_before") >= q
    settled = joined.where(whole_in | whole_out).withColumn(out_col, whole_in)
    edge = joined.where(~(whole_in | whole_out))
    wr = Window.partitionBy(group_col, "_p").orderBy(hash_col)
    edge = edge.withColumn(out_col, (F.col("_before") + F.row_number().over(wr)) <= q)
    cols = df.columns + [out_col]
    return settled.select(*cols).unionByName(edge.select(*cols))
