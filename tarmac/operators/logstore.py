"""Upkeep of a date-partitioned log: key filters that find old deliveries, and
compaction of closed dates.

Key filters: for each date of the log, a Bloom filter of its delivery keys,
stored as rows (date, slice, bits). A slice holds the keys whose hash falls to
it, so a date with many keys has many slices of one fixed size, and no row or
task holds the filter of a whole date. Probing joins (date, slice) with the
hashes of a micro-batch; the dates that answer are few, and only they are read
for the exact anti-join. A batch reads the filters (two to four bytes for each
stored key) in place of the rows. A filter never denies a key that it holds, so no
stored delivery is missed; what it answers wrongly costs a read, not a row.

Compaction: the rows of a date in many small files are written again in files
of about ``target`` bytes, below a folder that readers of the log do not see.
A date's new folder then takes the place of the old one by two renames.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.rollup import NULL_DATE, log_dates, on_dates
from tarmac.sources.io import ensure_parent, path_exists

SLICE_KEYS = 4096                # keys that a slice is sized for
SLICE_WORDS = 1024               # 64-bit words of a slice: 16 bits a key
PROBES = 7                       # bits set for a key: about 0.1 % false answers at 16 bits a key
FILTER_SCHEMA = "slice long, slices long, words array<long>, log_date date"
SEEN_SCHEMA = "date string, files long, bytes long"
TARGET = 128 << 20               # bytes of a compacted file


# ---------------------------------------------------------------- key filters
def delivery_hash(key: str, mark: str) -> Column:
    """Hash of a delivery: its key, or where it has none the column ``mark``."""
    return F.xxhash64(F.col(key).cast("string"), F.col(mark))


def _slice(h: Column, slices: Column) -> Column:
    return F.pmod(F.shiftright(h, 20), slices)


def _bits(h: Column) -> Column:
    """The PROBES bit numbers of a hash in its slice."""
    total = SLICE_WORDS * 64
    a = F.pmod(F.xxhash64(h, F.lit(1)), F.lit(total))
    b = F.pmod(F.xxhash64(h, F.lit(2)), F.lit(total // 2)) * 2 + 1           # odd: the steps do not repeat
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(a + i * b, F.lit(total)))


def key_filters(hashes: DataFrame) -> DataFrame:
    """(slice, slices, words, log_date) of ``hashes`` (log_date, h).

    A date has a power of two of slices. The bits are combined per (date,
    slice, word) before anything is gathered: a slice gathers at most
    SLICE_WORDS words, however many keys it got."""
    keys = hashes.select("log_date", "h").distinct()
    need = F.greatest(F.ceil(F.log2(F.count(F.lit(1)) / SLICE_KEYS)), F.lit(0)).cast("int")
    sizes = keys.groupBy("log_date").agg(need.alias("_power")) \
        .select("log_date", F.expr("shiftleft(1L, _power)").alias("slices"))                # a row for each date
    bits = (keys.join(sizes, "log_date").withColumn("slice", _slice(F.col("h"), F.col("slices")))
            .select("log_date", "slices", "slice", F.explode(_bits(F.col("h"))).alias("bit")))
    words = (bits.withColumn("at", F.expr("CAST(bit DIV 64 AS INT)"))
             .groupBy("log_date", "slices", "slice", "at")
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("word")))
    gathered = words.groupBy("log_date", "slices", "slice").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(SLICE_WORDS - 1)),
                       lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0).cast("long")))
    return gathered.select("slice", "slices", full.alias("words"), "log_date")


def update_filters(spark: SparkSession, log_path: str, filter_path: str, hashed: Callable[[DataFrame], DataFrame],
                   schema, open_dates: tuple[str, str] | None = None) -> list[str]:
    """Bring the filters up to the log; returns the dates that were read.
    ``hashed`` turns rows of the log into (log_date, h). A date whose files
    changed has its filter written anew; what was seen is noted after that, so
    an update that fails in between is done again. Dates from ``open_dates[0]``
    to ``open_dates[1]`` and the NULL date get no filter. One writer at a time."""
    first, last = open_dates or ("~", "")
    now = {d: size for d, size in log_dates(spark, log_path).items() if d != NULL_DATE and not first <= d <= last}
    seen_path, seen = f"{filter_path}/_seen", {}
    if path_exists(spark, seen_path):
        seen = {r["date"]: (r["files"], r["bytes"]) for r in spark.read.schema(SEEN_SCHEMA).parquet(seen_path).collect()}  # a row for each date
    changed = [d for d, size in now.items() if seen.get(d) != size]
    if changed:
        ensure_parent(spark, f"{filter_path}/days")
        part = key_filters(hashed(spark.read.schema(schema).parquet(log_path).where(on_dates(changed))))
        (part.hint("rebalance", "log_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("log_date").parquet(f"{filter_path}/days"))
        seen |= {d: now[d] for d in changed}
        spark.createDataFrame([(d, *size) for d, size in seen.items()], SEEN_SCHEMA).coalesce(1) \
            .write.mode("overwrite").parquet(seen_path)                                     # bounded: a row for each date
    return changed


def answering_dates(spark: SparkSession, hashes: DataFrame, filter_path: str,
                    open_dates: tuple[str, str] | None = None) -> list[str]:
    """The dates outside ``open_dates`` whose filter may hold one of
    ``hashes`` (h), newest first. The hashes meet the filters by an equi-join
    on (slices, slice); at most one row for each date comes back."""
    if not path_exists(spark, f"{filter_path}/days"):
        return []
    days = spark.read.schema(FILTER_SCHEMA).parquet(f"{filter_path}/days")
    if open_dates:
        days = days.where(~F.col("log_date").between(F.lit(open_dates[0]).cast("date"), F.lit(open_dates[1]).cast("date")))
    kinds = [r["slices"] for r in days.select("slices").distinct().collect()]               # powers of two: some dozens at most
    if not kinds:
        return []
    asked = hashes.select("h").distinct().withColumn("slices", F.explode(F.array(*[F.lit(k).cast("long") for k in kinds])))
    asked = asked.select("slices", _slice(F.col("h"), F.col("slices")).alias("slice"), _bits(F.col("h")).alias("bits"))
    hit = F.forall(F.col("bits"), lambda b: F.getbit(F.get(F.col("words"), F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1)
    found = asked.join(days, ["slices", "slice"]).where(hit).select("log_date").distinct().collect()    # a row for each date
    return sorted((r["log_date"].isoformat() for r in found), reverse=True)


# ---------------------------------------------------------------- compaction
def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def recover(spark: SparkSession, log_path: str) -> int:
    """Finish swaps that a crash cut between its two renames: a date whose old
    folder is put away and whose new one is not in place gets its old one
    back. Returns how many."""
    fs, path = _fs(spark, log_path)
    away, back = path(f"{log_path}/_compacted/old"), 0
    if not fs.exists(away):
        return 0
    for s in fs.listStatus(away):
        home = path(f"{log_path}/{s.getPath().getName()}")
        if not fs.exists(home):
            back += bool(fs.rename(s.getPath(), home))
        else:
            fs.delete(s.getPath(), True)
    return back


def compact(spark: SparkSession, log_path: str, before: str, target: int = TARGET) -> list[str]:
    """Write the dates before ``before`` (ISO date; closed: nothing is appended
    to them any more) that have more files than their bytes need into files of
    about ``target`` bytes; returns them. Rows and columns stay the same.

    All dates are written by one job below ``_compacted``, which readers of
    the log skip; a job that fails leaves the log as it was. A date is then
    swapped by two renames: a reader that lists the log between them misses
    the date, and ``recover`` (run first here) puts it back after a crash.
    A reader that has listed the old files before the swap fails when it opens
    them and has to read again. NULL dates are never closed."""
    recover(spark, log_path)
    sizes = log_dates(spark, log_path)
    need = {d: max(1, -(-size // target)) for d, (_, size) in sizes.items()}
    chosen = [d for d, (files, _) in sizes.items() if d != NULL_DATE and d < before and files > need[d]]
    if not chosen:
        return []
    new = f"{log_path}/_compacted/{uuid.uuid4().hex}"
    ensure_parent(spark, new)
    parts = spark.createDataFrame([(d, int(need[d])) for d in chosen], "_date string, _files long") \
        .select(F.col("_date").cast("date").alias("log_date"), "_files")                    # bounded: a row for each date
    rows = spark.read.parquet(log_path).where(on_dates(chosen))
    columns = rows.columns
    # a date's rows are dealt to as many tasks as it needs files, by a hash of their values
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in columns if c != "log_date"]), F.col("_files"))
    rows = rows.join(F.broadcast(parts), "log_date").withColumn("_deal", deal)
    total = int(sum(need[d] for d in chosen))
    (rows.repartition(total, "log_date", "_deal").select(*columns)
     .write.partitionBy("log_date").parquet(new))
    fs, path = _fs(spark, log_path)
    fs.mkdirs(path(f"{log_path}/_compacted/old"))
    for d in chosen:
        home, old = path(f"{log_path}/log_date={d}"), path(f"{log_path}/_compacted/old/log_date={d}")
        if not (fs.rename(home, old) and fs.rename(path(f"{new}/log_date={d}"), home)):
            raise OSError(f"the files of {d} could not be swapped; run recover()")
        fs.delete(old, True)
    fs.delete(path(new), True)
    return chosen
