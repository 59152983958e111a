"""Per-date rollup of the inference log, and what the reports need from it.

The rollup holds, for each date of a date-partitioned log, the rows counted
per (prediction, probability) with the first and last timestamp: counts are
sums, so any set of dates adds up exactly. Logged probabilities have four
decimals, so a date has some ten thousand rows at most, however long its log.

``update`` compares the files of each date with those it has seen and reads
only the dates that changed; reports then read the rollup instead of the log.
Distinct counts come from HyperLogLog sketches, stored per date and united.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import monitor as MO
from tarmac.schema import DELAYED, DRIFT_BASELINE, DRIFT_MIN_ROWS, DRIFT_THRESHOLD, DRIFT_WINDOW_DAYS, HIGH_RISK_PROBABILITY
from tarmac.sources.io import ensure_parent, path_exists

NULL_DATE = "__HIVE_DEFAULT_PARTITION__"
SKETCH_BITS = 12                                            # relative error about 1.04 / sqrt(2 ** bits) = 1.6 %
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)            # three standard errors
ROLLUP_SCHEMA = "prediction string, probability double, n long, first_ts timestamp, last_ts timestamp, log_date date"
SEEN_SCHEMA = "date string, files long, bytes long"


# ---------------------------------------------------------------- dates of a log
def log_dates(spark: SparkSession, log_path: str) -> dict[str, tuple[int, int]]:
    """date folder -> (files, bytes), from the file system alone; newest date
    first, rows without a date last."""
    if not path_exists(spark, log_path):
        return {}
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log_path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith("log_date="):
            size = fs.getContentSummary(s.getPath())
            out[name.removeprefix("log_date=")] = (int(size.getFileCount()), int(size.getLength()))
    return {d: out[d] for d in sorted(out, key=lambda d: "" if d == NULL_DATE else d, reverse=True)}


def on_dates(dates: list[str]) -> Column:
    """Predicate on the partition column: the scan reads these dates only."""
    known = [dt.date.fromisoformat(d) for d in dates if d != NULL_DATE]
    cond = F.col("log_date").isin(known) if known else F.lit(False)
    return cond | F.col("log_date").isNull() if NULL_DATE in dates else cond


# ---------------------------------------------------------------- rollup
def roll(log: DataFrame) -> DataFrame:
    """Counts per (date, prediction, probability): one aggregation with
    map-side partial sums."""
    return log.groupBy("log_date", "prediction", "probability").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    ).select("prediction", "probability", "n", "first_ts", "last_ts", "log_date")


def update(spark: SparkSession, log_path: str, rollup_path: str) -> list[str]:
    """Bring the rollup up to the log; returns the dates that were read.

    Changed dates are rewritten as whole partitions, and what was seen of the
    log is noted after that: an update that fails in between is done again."""
    now = log_dates(spark, log_path)
    seen_path = f"{rollup_path}/_seen"
    seen = {}
    if path_exists(spark, seen_path):
        seen = {r["date"]: (r["files"], r["bytes"]) for r in spark.read.schema(SEEN_SCHEMA).parquet(seen_path).collect()}   # a row for each date
    changed = [d for d, size in now.items() if seen.get(d) != size]
    if changed:
        ensure_parent(spark, f"{rollup_path}/days")
        part = roll(spark.read.parquet(log_path).where(on_dates(changed)))
        (part.hint("rebalance", "log_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("log_date").parquet(f"{rollup_path}/days"))
        rows = [(d, *size) for d, size in now.items()]
        spark.createDataFrame(rows, SEEN_SCHEMA).coalesce(1).write.mode("overwrite").parquet(seen_path)     # bounded: a row for each date
    return changed


def load(spark: SparkSession, rollup_path: str) -> DataFrame:
    if not path_exists(spark, f"{rollup_path}/days"):
        return spark.createDataFrame([], ROLLUP_SCHEMA)
    return spark.read.schema(ROLLUP_SCHEMA).parquet(f"{rollup_path}/days")


# ---------------------------------------------------------------- reports
def _sum(cond: Column | None = None) -> Column:
    n = F.col("n") if cond is None else F.when(cond, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0)).cast("bigint")


def stats(rollup: DataFrame) -> DataFrame:
    """As ``monitor.prediction_stats``; no rows for an empty log."""
    p = F.col("probability")
    agg = rollup.agg(
        _sum().alias("total_predictions"), _sum(F.col("prediction") == F.lit(DELAYED)).alias("_delayed"),
        _sum(p.isNotNull()).alias("_with_p"), F.sum(p * F.col("n")).alias("_p"),
        _sum(p > F.lit(HIGH_RISK_PROBABILITY)).alias("high_risk_count"),
        F.min("first_ts").alias("start"), F.max("last_ts").alias("end")).where(F.col("total_predictions") > 0)
    return agg.select(
        "total_predictions", (F.col("_delayed") / F.col("total_predictions").cast("double")).alias("delay_rate"),
        F.try_divide(F.col("_p"), F.col("_with_p").cast("double")).alias("avg_probability"), "high_risk_count", "start", "end")


def counts(rollup: DataFrame) -> DataFrame:
    """As ``monitor.prediction_counts``."""
    return (rollup.where(F.col("prediction").isNotNull()).groupBy("prediction").agg(_sum().alias("n"))
            .orderBy(F.desc("n"), F.asc("prediction")))


def histogram(rollup: DataFrame, bins: int = MO.HIST_BINS) -> DataFrame:
    """As ``monitor.probability_histogram``."""
    return MO.probability_histogram(rollup, bins, weight="n")


def report(rollup: DataFrame, log: DataFrame, as_of, baseline: float = DRIFT_BASELINE, window_days: int = DRIFT_WINDOW_DAYS,
           threshold: float = DRIFT_THRESHOLD, min_rows: int = DRIFT_MIN_ROWS) -> DataFrame:
    """As ``monitor.monitoring_report``: whole dates from the rollup, and of
    the log only the date that the trailing window cuts."""
    cut = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(window_days))
    later = rollup.where(F.col("log_date") > F.to_date(cut)).select(F.col("prediction").alias("_p"), F.col("n").alias("_n"))
    edge = log.where((F.col("log_date") == F.to_date(cut)) & (F.col("timestamp") >= cut)).groupBy(F.col("prediction").alias("_p")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    recent = later.unionByName(edge).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("recent_predictions"),
        F.coalesce(F.sum(F.when(F.col("_p") == F.lit(DELAYED), F.col("_n"))), F.lit(0)).cast("bigint").alias("_recent_delayed"))
    total = stats(rollup).select("total_predictions", "delay_rate", "avg_probability", "high_risk_count")
    row = recent.join(total, how="left").withColumn("has_rows", F.col("total_predictions").isNotNull())     # one row each
    row = row.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("total_predictions", "high_risk_count")})
    return MO.report_rows(row, as_of, baseline, window_days, threshold, min_rows)


# ---------------------------------------------------------------- recent rows
def recent_rows(spark: SparkSession, log_path: str, limit: int = 100) -> DataFrame:
    """As ``monitor.recent_rows`` over a date-partitioned log: dates are taken
    from the newest until they hold ``limit`` rows (counted from file
    footers), and only those are read."""
    log, held, taken = spark.read.parquet(log_path), 0, []
    for d in log_dates(spark, log_path):
        taken.append(d)
        held += log.where(on_dates([d])).count()
        if held >= limit:
            break
    return MO.recent_rows(log.where(on_dates(taken)), limit)


# ---------------------------------------------------------------- distinct counts
def sketches(df: DataFrame, columns: list[str], by: str = "log_date") -> DataFrame:
    """(by, column, sketch): a HyperLogLog sketch of each column per date, in
    one aggregation; NULLs are not counted."""
    wide = df.groupBy(by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS)).alias(c) for c in columns])
    return wide.unpivot([by], columns, "column", "sketch")


def distinct_counts(stored: DataFrame) -> DataFrame:
    """(column, n): the distinct values over all stored dates, estimated from
    the united sketches within SKETCH_ERROR."""
    return stored.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
