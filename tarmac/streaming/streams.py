"""Structured Streaming: request scoring, the append-only inference log and
windowed drift monitoring.

Sinks are file sinks with a checkpoint (exactly-once); the checkpoint and the
sink live under the shared checkpoint root of the session. ``run_available``
drains what is available (``availableNow``) and returns the sink as a batch
DataFrame, which makes stream and batch results directly comparable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import logstore
from tarmac.operators.features import Dictionary, feature_columns, score_features
from tarmac.operators.requests import validate_requests
from tarmac.operators.rollup import on_dates
from tarmac.operators.scoring import batch_score, respond
from tarmac.schema import (DELAYED, DRIFT_BASELINE, DRIFT_MIN_ROWS, DRIFT_THRESHOLD,
                           DRIFT_WINDOW_DAYS)
from tarmac.session import work_dir


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available (it ends by itself);
    return the sink as a batch table. A failed query raises."""
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", checkpoint).option("path", sink)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.parquet(sink)


def score_requests_stream(requests: DataFrame, dictionary: Dictionary | None, model=None, rule=None,
                          keep=("flight_id",), risk_scheme: str = "A") -> DataFrame:
    """T1: request stream -> validation -> score-time features (static
    dictionary, stream-static join) -> score -> bands. Rejected rows are the
    output of ``rejected_requests_stream``."""
    valid = validate_requests(requests).where("is_valid")
    return batch_score(valid, dictionary, model=model, rule=rule, keep=keep, risk_scheme=risk_scheme)


def rejected_requests_stream(requests: DataFrame) -> DataFrame:
    """The rows that ``score_requests_stream`` does not score, each with its reason."""
    return validate_requests(requests).where(~F.col("is_valid"))


def responses_stream(requests: DataFrame, dictionary: Dictionary | None, model_name: str, model=None, rule=None,
                     key: str = "flight_id", ts_col: str = "request_ts", risk_scheme: str = "A") -> DataFrame:
    """Response rows of the valid requests: key, prediction, probability,
    confidence, risk level, model name, inference id and timestamp.

    A stream has no running number over all rows, so the inference id is made
    from the request's key and time: equal for a re-delivered request."""
    valid = validate_requests(requests).where("is_valid")
    feats = score_features(valid, dictionary)
    if model is not None:
        from tarmac.operators.learn import score
        feats = score(model, feature_columns(feats, keep=[key, ts_col, "OP_CARRIER", "ORIGIN", "DEST"]))
    else:
        feats = feats.withColumn("probability", rule(feats))
    out = respond(feats, "probability", model_name, F.col(ts_col).cast("timestamp"), risk_scheme=risk_scheme)
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col(ts_col).cast("string")))
    return out.withColumn("inference_id", F.concat(F.lit("INF-"), F.substring(digest, 1, 16)))


def append_once(batch: DataFrame, sink: str, key: str = "flight_id", ts_col: str = "timestamp",
                horizon: str = "1 hour", filters: str | None = None) -> None:
    """Append the rows of a micro-batch that the dated table ``sink`` does not
    hold yet: de-duplicated as a batch (``dropDuplicates`` combines map-side,
    so a key re-delivered millions of times is reduced before the shuffle), then anti-joined with
    the stored rows from ``horizon`` before the batch's first timestamp to
    ``horizon`` after its last (a date-pruned read). The batch is evaluated
    once. A batch that failed half way and is run again adds what is missing.

    A delivery is known again by its key; rows without a key are known by all
    their values. Rows without a timestamp are kept (in the NULL date) and
    compared with the stored rows without a timestamp."""
    from tarmac.sources.io import path_exists, write_dated
    spark = batch.sparkSession
    values = F.struct(*[F.col(c) for c in batch.columns if c != key])
    mark = F.when(F.col(key).isNull(), F.xxhash64(values.cast("string")))
    rows = batch.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withColumn("_mark", mark)
    rows = rows.dropDuplicates([key, "_mark"]).withColumn("log_date", F.to_date(ts_col)).persist()
    try:
        new = rows
        if path_exists(spark, sink):
            span = rows.agg(F.min(ts_col).alias("a"), F.max(ts_col).alias("b")).first()  # one row
            near = F.col("log_date").isNull()
            if span["a"] is not None:
                lo = F.lit(span["a"]) - F.expr(f"INTERVAL {horizon}")
                hi = F.lit(span["b"]) + F.expr(f"INTERVAL {horizon}")
                near = near | (F.col("log_date").between(F.to_date(lo), F.to_date(hi)) & F.col(ts_col).between(lo, hi))
            schema = rows.drop("_mark").schema
            if filters:
                near = F.col("log_date").isNull() | _filtered_dates(rows, sink, filters, key, mark, schema, span, horizon)
            seen = spark.read.schema(schema).parquet(sink).where(near).withColumn("_mark", mark)
            seen = seen.select(F.col(key).alias("_k"), F.col("_mark").alias("_m"))
            new = rows.join(seen, F.col(key).eqNullSafe(F.col("_k")) & F.col("_mark").eqNullSafe(F.col("_m")), "left_anti")
        write_dated(new.drop("_mark"), sink)
    finally:
        rows.unpersist()


def _filtered_dates(rows: DataFrame, sink: str, filters: str, key: str, mark, schema, span, horizon: str):
    """The dates of ``sink`` that may hold a delivery of ``rows``: those that
    the horizon touches, and those whose filter answers."""
    spark, open_dates, near = rows.sparkSession, None, F.lit(False)
    if span["a"] is not None:
        edge = F.expr(f"INTERVAL {horizon}")
        ends = spark.range(1).select(F.to_date(F.lit(span["a"]) - edge).cast("string").alias("a"),
                                     F.to_date(F.lit(span["b"]) + edge).cast("string").alias("b")).first()      # one row
        open_dates = (ends["a"], ends["b"])
        near = F.col("log_date").between(F.lit(ends["a"]).cast("date"), F.lit(ends["b"]).cast("date"))

    def hashed(log: DataFrame) -> DataFrame:
        return log.withColumn("_mark", mark).select("log_date", logstore.delivery_hash(key, "_mark").alias("h"))
    logstore.update_filters(spark, sink, filters, hashed, schema, open_dates)
    return near | on_dates(logstore.answering_dates(spark, hashed(rows.drop("_mark")), filters, open_dates))


def append_log_stream(log: DataFrame, sink: str, checkpoint: str, key: str = "flight_id",
                      ts_col: str = "timestamp", horizon: str = "1 hour", available_now: bool = True,
                      trigger_seconds: int = 10, filters: str | None = None):
    """T3, skew-proof: every micro-batch goes through ``append_once``, so
    re-delivered rows and a repeated batch write nothing twice within the
    horizon, and with ``filters`` (a folder for key filters) at any distance."""
    w = log.writeStream.foreachBatch(lambda batch, _: append_once(batch, sink, key, ts_col, horizon, filters))
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


def drift_windows(log: DataFrame, window_days: int = DRIFT_WINDOW_DAYS, slide_days: int = 1,
                  delay: str = "1 day", baseline: float = DRIFT_BASELINE,
                  threshold: float = DRIFT_THRESHOLD, min_rows: int = DRIFT_MIN_ROWS,
                  ts_col: str = "timestamp") -> DataFrame:
    """T2: per event-time window (``window_days`` long, sliding by
    ``slide_days``): predictions, delay rate and the drift rule. Rows later
    than the watermark are dropped (Spark filters late input with the
    watermark reached by the previous micro-batch); a window is emitted once
    the watermark passes its end.

    Two chained aggregations: rows are summed into panes of ``slide_days``,
    and closed panes into windows. So a row is counted once, and only a pane's
    one row of sums is repeated for the windows that hold it. State is one row
    per open pane and open window."""
    s = log.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", delay)
    panes = s.groupBy(F.window("_ts", f"{slide_days} days").alias("pane")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("prediction") == F.lit(DELAYED), 1)).alias("delayed"))
    agg = panes.groupBy(F.window(F.window_time("pane"), f"{window_days} days", f"{slide_days} days").alias("w")).agg(
        F.sum("n").alias("n"), F.sum("delayed").alias("delayed"))
    rate = F.col("delayed") / F.col("n").cast("double")
    return agg.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "n", rate.alias("delay_rate"),
        ((F.col("n") >= min_rows) & (F.abs(rate - F.lit(baseline)) > F.lit(threshold))).alias("drift_detected"))


def stage_as_files(df: DataFrame, path: str, copies: int = 1) -> str:
    """Write a table as parquet files a file stream can pick up (``copies``
    > 1 writes the rows again, as a source that re-delivers would)."""
    for i in range(copies):
        df.write.mode("append").parquet(path)
    return path


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str, str]:
    """(input, sink, checkpoint) folders for one run."""
    root = work_dir(spark, name)
    return f"{root}/input", f"{root}/sink", f"{root}/checkpoint"
