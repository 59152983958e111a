"""File sources and sinks: flight CSV scan, table writes, load-or-generate,
batch request uploads, the inference log, reports."""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.requests import batch_requests
from tarmac.schema import INFERENCE_LOG_SCHEMA, RAW_COLUMNS
from tarmac.session import ensure_parent


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as STRING (no type inference; the
    cleaning operators coerce explicitly); a quote inside a quoted value is
    doubled. All files below one path must have the same header: a file with
    other columns, or another order, fails the read instead of being taken
    by position."""
    return (spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
            .option("escape", '"').csv(path))


def load_flights_csv(spark: SparkSession, path: str | list[str], columns: Iterable[str] = RAW_COLUMNS) -> DataFrame:
    """Flight CSV scan: keep the columns whose trimmed header is a known
    column, in file order, names trimmed; absent columns are not an error.
    Several paths are read each by its own header and united by name.
    Catalyst prunes the unused CSV columns at the scan."""
    wanted, out = set(columns), None
    for one in [path] if isinstance(path, str) else path:
        raw = read_text_csv(spark, one)
        keep = [c for c in raw.columns if c.strip() in wanted]
        part = raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in keep])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def save_csv(df: DataFrame, path: str, keep_spaces: bool = True) -> str:
    """Overwrite ``path`` with a header CSV (one folder of part files)."""
    ensure_parent(df.sparkSession, path)
    w = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if keep_spaces:
        w = w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    w.csv(path)
    return path


def save_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> str:
    ensure_parent(df.sparkSession, path)
    keys = list(partition_by)
    if keys:
        # few, evenly filled files for each key: adaptive execution splits a large key and merges small ones
        df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def write_dated(rows: DataFrame, path: str) -> None:
    """Append rows with a ``log_date`` column, partitioned by it."""
    ensure_parent(rows.sparkSession, path)
    rows.hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").parquet(path)


def load_or_generate(spark: SparkSession, paths: list[str], generate: Callable[[], DataFrame],
                     save_to: str | None = None, columns: Iterable[str] = RAW_COLUMNS) -> DataFrame:
    """First existing path of ``paths`` (CSV); else generate, save to
    ``save_to`` (or the first path) and read the saved table back."""
    for p in paths:
        if path_exists(spark, p):
            return load_flights_csv(spark, p, columns)
    target = save_to or paths[0]
    save_csv(generate(), target)
    return load_flights_csv(spark, target, columns)


def read_batch_requests(spark: SparkSession, path: str) -> DataFrame:
    """Batch upload: text CSV -> typed, defaulted request rows with
    ``reject_reason``/``is_valid`` (bad rows rejected one by one)."""
    return batch_requests(read_text_csv(spark, path))


def append_inference_log(log_rows: DataFrame, path: str, partition_by_date: bool = True) -> None:
    """Append log rows (parquet, partitioned by date so trailing-window reads
    prune to the days they need)."""
    out = log_rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if partition_by_date:
        write_dated(out.withColumn("log_date", F.to_date("timestamp")), path)
    else:
        ensure_parent(out.sparkSession, path)
        out.write.mode("append").parquet(path)


def load_inference_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with a timestamp column; an empty log with the log schema if
    nothing was written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], INFERENCE_LOG_SCHEMA)
    df = spark.read.parquet(path)
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def write_report(report: DataFrame, path: str) -> str:
    """Report rows (section, metric, value, text) as a single small CSV."""
    ensure_parent(report.sparkSession, path)
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # bounded: report rows
    return path


def read_inference_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """A log written as CSV text: timestamp parsed (bad -> NULL), numbers
    coerced; an empty log with the log schema if the path is absent."""
    from tarmac.functions.coerce import to_double
    from pyspark.sql import types as T
    if not path_exists(spark, path):
        return spark.createDataFrame([], INFERENCE_LOG_SCHEMA)
    raw = read_text_csv(spark, path)
    text = T.StringType()
    ts = F.coalesce(F.try_to_timestamp(F.col("timestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
                    F.try_to_timestamp(F.col("timestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ss")),
                    F.try_to_timestamp(F.col("timestamp"), F.lit("yyyy-MM-dd HH:mm:ss")))
    cols = {f.name for f in INFERENCE_LOG_SCHEMA.fields}
    return raw.select(
        ts.alias("timestamp"),
        *[F.col(c) for c in ["airline", "origin", "destination", "prediction"] if c in raw.columns],
        *[to_double(F.col(c), text).alias(c) for c in ["distance", "probability"] if c in raw.columns],
        *[F.col(c) for c in raw.columns if c not in cols])


def normalise_flights(spark: SparkSession, csv_path: str, parquet_path: str) -> DataFrame:
    """Raw flight CSV -> coerced, typed Parquet (partitioned by month of the
    flight date). Cleaning the typed copy pushes the target-range filter into
    the Parquet scan and prunes columns, which text CSV cannot."""
    from tarmac.operators.clean import coerce
    typed = coerce(load_flights_csv(spark, csv_path, list(RAW_COLUMNS) + ["flight_id"]))
    part = []
    if "FL_DATE" in typed.columns:
        typed = typed.withColumn("fl_month", F.date_format("FL_DATE", "yyyy-MM"))
        part = ["fl_month"]
    save_parquet(typed, parquet_path, part)
    return spark.read.parquet(parquet_path)
