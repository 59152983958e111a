"""Registered queries over files and streams: CSV round trip into cleaning,
batch upload defaults, and the streams (S1, S2, S7, T1-T3). Files go to fresh folders under the session's
checkpoint root."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import clean as C
from tarmac.operators import logstore
from tarmac.operators.features import engineer, fit_dictionary, load_dictionary, save_dictionary
from tarmac.operators.monitor import monitoring_report
from tarmac.operators.requests import validate_requests
from tarmac.operators.scoring import batch_score
from tarmac.plans.oracle import with_ctes
from tarmac.plans.q_clean import _CLEAN_COLS
from tarmac.plans.q_features import _REQ_VALID
from tarmac.plans.q_monitor import AS_OF
from tarmac.plans.q_scoring import _BATCH_SQL, _rule
from tarmac.plans.registry import QUERIES, register
from tarmac.schema import RAW_COLUMNS
from tarmac.session import work_dir
from tarmac.sources import io, tables
from tarmac.streaming import streams as ST


@register("csv_roundtrip_clean", operators=("S1", "S2", "P1", "P2", "P3"),
          oracle=QUERIES["clean_flights"].oracle)
def csv_roundtrip_clean(spark, sf):
    """Flights written as text CSV in two folders with padded headers, other
    column orders and other date spellings, scanned back as all STRING
    columns, then cleaned: same result as cleaning the typed table."""
    raw = tables.flights_raw(spark, sf).drop("ts")
    odd, root = F.col("flight_id") % 2 == 1, work_dir(spark, "flights-csv")
    padded = raw.where(~odd).select(*[F.col(c).alias(f" {c} ") for c in raw.columns])
    us = raw.where(odd).withColumn("FL_DATE", F.date_format("FL_DATE", "M/d/yyyy h:mm:ss a"))
    paths = [io.save_csv(padded, f"{root}/padded"), io.save_csv(us.select(*reversed(raw.columns)), f"{root}/reversed")]
    text = io.load_flights_csv(spark, paths, RAW_COLUMNS + ["flight_id"])
    df = C.clean(text).withColumn("flight_id", F.col("flight_id").cast("bigint"))
    return df.select(F.col("FL_DATE").cast("string").alias("FL_DATE"), *_CLEAN_COLS)


_UPLOAD_SQL = """
upload AS (
 SELECT flight_id, upper(airline) AS airline, upper(origin) AS origin, upper(destination) AS destination,
  flight_id % 17 = 1 AS bad_delay, flight_id % 13 = 2 AS bad_hour,
  CASE WHEN flight_id % 17 = 1 OR flight_id % 19 = 3 THEN 0.0 ELSE coalesce(CASE WHEN NOT isnan(departure_delay) THEN departure_delay END, 0.0) END AS departure_delay,
  CASE WHEN NOT isnan(distance) THEN distance END AS distance, day_of_week, month,
  CASE WHEN flight_id % 13 = 2 OR flight_id % 11 = 4 THEN 12 ELSE hour END AS hour
 FROM requests)"""


@register("batch_defaults", operators=("S7",), oracle=with_ctes(["requests"], """
SELECT flight_id, airline, origin, destination, departure_delay, distance, day_of_week, month, hour, reject_reason,
 reject_reason = '' AS is_valid
FROM (SELECT *, concat_ws(';', CASE WHEN airline IS NULL THEN 'airline: missing' END,
   CASE WHEN origin IS NULL THEN 'origin: missing' END, CASE WHEN destination IS NULL THEN 'destination: missing' END,
   CASE WHEN distance IS NULL THEN 'distance: missing' END, CASE WHEN bad_hour THEN 'hour: not a number' END,
   CASE WHEN bad_delay THEN 'departure_delay: not a number' END) AS reject_reason FROM upload) u""",
    [_UPLOAD_SQL]))
def batch_defaults(spark, sf):
    """A batch upload with empty, bad and fractional fields: written as CSV,
    scanned back, defaults and reject reasons row by row."""
    req, fid = tables.requests(spark, sf), F.col("flight_id")
    text = req.withColumn("departure_delay", F.when(fid % 17 == 1, "abc").when(fid % 19 == 3, "")
                          .otherwise(F.col("departure_delay").cast("string")))
    text = text.withColumn("hour", F.when(fid % 13 == 2, "noon").when(fid % 11 == 4, F.lit(None).cast("string"))
                           .when(fid % 3 == 0, F.concat(F.col("hour").cast("string"), F.lit(".5")))
                           .otherwise(F.col("hour").cast("string")))
    path = io.save_csv(text, f"{work_dir(spark, 'batch-upload')}/requests")
    out = io.read_batch_requests(spark, path)
    return out.withColumn("flight_id", F.col("flight_id").cast("bigint"))


def _dictionary(spark, sf):
    return fit_dictionary(engineer(C.clean(tables.flights_raw(spark, sf))))


@register("stream_score", operators=("T1",), oracle=with_ctes(["requests"], """
SELECT * FROM batch""", [_REQ_VALID, _BATCH_SQL]))
def stream_score(spark, sf):
    """Requests arrive as files; the stream validates, encodes and scores
    them into a file sink. Equal to the batch result."""
    src, sink, ckpt = ST.fresh_paths(spark, "stream-score")
    req = tables.requests(spark, sf)
    ST.stage_as_files(req, src)
    stream = ST.read_stream(spark, src, req.schema)
    scored = ST.score_requests_stream(stream, _dictionary(spark, sf), rule=_rule)
    return ST.run_available(scored, sink, ckpt)


@register("stream_rejects", operators=("T1", "P13"), oracle=with_ctes(["requests"], """
SELECT flight_id, airline, origin, destination, reject_reason FROM req_valid WHERE reject_reason <> ''""", [_REQ_VALID]))
def stream_rejects(spark, sf):
    """The requests that the scoring stream does not score, with reasons."""
    src, sink, ckpt = ST.fresh_paths(spark, "stream-rejects")
    req = tables.requests(spark, sf)
    ST.stage_as_files(req, src)
    rejected = ST.rejected_requests_stream(ST.read_stream(spark, src, req.schema))
    return ST.run_available(rejected.select("flight_id", "airline", "origin", "destination", "reject_reason"), sink, ckpt)


@register("stream_responses", operators=("T1", "I6", "I7"), oracle=with_ctes(["requests"], """
SELECT flight_id, CASE WHEN p >= 0.5 THEN 'Delayed' ELSE 'On Time' END AS prediction, round(p, 4) AS delay_probability,
 CASE WHEN abs(p - 0.5) > 0.35 THEN 'HIGH' WHEN abs(p - 0.5) > 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
 CASE WHEN p < 0.25 THEN 'LOW RISK' WHEN p < 0.45 THEN 'MODERATE RISK' WHEN p < 0.65 THEN 'HIGH RISK' ELSE 'VERY HIGH RISK' END AS risk_level,
 'rule' AS model_name, 'INF-' || substr(md5(CAST(flight_id AS VARCHAR) || ':2024-01-31 00:00:00'), 1, 16) AS inference_id
FROM (SELECT *, round(1/(1+exp(-(coalesce(departure_delay, 0)-15)/20)),4) AS p FROM req_valid WHERE reject_reason = '') v""",
    [_REQ_VALID]))
def stream_responses(spark, sf):
    """Responses of the live path (risk scheme B), with a stable id per request."""
    src, sink, ckpt = ST.fresh_paths(spark, "stream-responses")
    req = tables.requests(spark, sf).withColumn("request_ts", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    ST.stage_as_files(req, src)
    out = ST.responses_stream(ST.read_stream(spark, src, req.schema), _dictionary(spark, sf), "rule", rule=_rule,
                              risk_scheme="B")
    return ST.run_available(out.select("flight_id", "prediction", "delay_probability", "confidence", "risk_level",
                                       "model_name", "inference_id"), sink, ckpt)


_GAPS = ["""
gaps AS (SELECT CASE WHEN flight_id % 67 <> 0 THEN flight_id END AS flight_id,
   CASE WHEN flight_id % 73 <> 0 THEN "timestamp" END AS "timestamp", airline, origin, destination, distance, prediction,
   round(probability, 4) AS probability FROM inference_log)"""]


def _log_with_gaps(spark, sf):
    """The inference log with some keys and some timestamps missing."""
    fid = F.col("flight_id")
    return tables.inference_log(spark, sf).select(
        F.when(fid % 67 != 0, fid).alias("flight_id"), F.when(fid % 73 != 0, F.col("timestamp")).alias("timestamp"),
        "airline", "origin", "destination", "distance", "prediction", F.round("probability", 4).alias("probability"))


@register("stream_log_dedup", operators=("T3", "S5", "S6"), oracle=with_ctes(["inference_log"], """
SELECT DISTINCT flight_id, CAST("timestamp" AS VARCHAR) AS "timestamp", airline, origin, destination, distance, prediction,
 probability FROM gaps""", _GAPS))
def stream_log_dedup(spark, sf):
    """Every log row delivered twice, in separate micro-batches, some without
    key or timestamp; the exactly-once append keeps each prediction once."""
    src, sink, ckpt = ST.fresh_paths(spark, "stream-log")
    log = _log_with_gaps(spark, sf)
    ST.stage_as_files(log, src, copies=2)
    stream = ST.read_stream(spark, src, log.schema, max_files=1)  # copies arrive in separate batches
    ST.append_log_stream(stream, sink, ckpt).awaitTermination()   # an availableNow stream ends by itself
    out = io.load_inference_log(spark, sink).drop("log_date")
    return out.withColumn("timestamp", F.col("timestamp").cast("string"))


@register("log_append_load", operators=("S5", "S6"), oracle=with_ctes(["inference_log"], """
SELECT flight_id, CAST("timestamp" AS VARCHAR) AS "timestamp", airline, origin, destination, distance, prediction,
 probability, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS log_date FROM gaps""", _GAPS))
def log_append_load(spark, sf):
    """The log appended in two parts and loaded back."""
    path, log = f"{work_dir(spark, 'log')}/log", _log_with_gaps(spark, sf)
    early = F.coalesce(F.col("timestamp") < "2024-01-15", F.lit(False))
    for part in (log.where(early), log.where(~early)):
        io.append_inference_log(part, path)
    out = io.load_inference_log(spark, path)
    return out.withColumn("timestamp", F.col("timestamp").cast("string")).withColumn("log_date", F.col("log_date").cast("string"))


@register("stream_log_redelivered", operators=("T3", "S5", "S6"), oracle=with_ctes(["inference_log"], """
SELECT flight_id, CAST("timestamp" AS VARCHAR) AS "timestamp", prediction, round(probability, 4) AS probability FROM inference_log
UNION ALL
SELECT -flight_id - 1, CAST("timestamp" + INTERVAL 30 DAY AS VARCHAR), prediction, round(probability, 4) FROM inference_log
WHERE flight_id % 5 = 0"""))
def stream_log_redelivered(spark, sf):
    """The log, then every fifth key once more 30 days later (long after the
    horizon; dropped) together with as many new keys (kept)."""
    src, sink, ckpt = ST.fresh_paths(spark, "stream-late-log")
    log = tables.inference_log(spark, sf).select("flight_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "prediction",
                                                 F.round("probability", 4).alias("probability"))
    later = log.where(F.col("flight_id") % 5 == 0).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 30 DAYS"))
    later = later.unionByName(later.withColumn("flight_id", -F.col("flight_id") - 1))
    for part in (log, later):
        ST.stage_as_files(part, src)
        ST.append_log_stream(ST.read_stream(spark, src, log.schema), sink, ckpt, filters=f"{sink}-filters").awaitTermination()
    out = io.load_inference_log(spark, sink).drop("log_date")
    return out.withColumn("timestamp", F.col("timestamp").cast("string"))


@register("log_compacted", operators=("S5", "S6"), oracle=QUERIES["log_append_load"].oracle)
def log_compacted(spark, sf):
    """The log appended in four parts, its closed dates compacted, and loaded."""
    path, log = f"{work_dir(spark, 'log')}/log", _log_with_gaps(spark, sf)
    part = F.pmod(F.xxhash64("flight_id", "timestamp"), F.lit(4))
    for i in range(4):
        io.append_inference_log(log.where(part == i), path)
    logstore.compact(spark, path, before=AS_OF[:10])
    out = io.load_inference_log(spark, path)
    return out.withColumn("timestamp", F.col("timestamp").cast("string")).withColumn("log_date", F.col("log_date").cast("string"))


@register("load_existing", operators=("S3",), oracle=QUERIES["clean_flights"].oracle)
def load_existing(spark, sf):
    """Load-or-generate where the file is there: nothing is generated."""
    def unused():
        raise AssertionError("the file exists")
    raw = tables.flights_raw(spark, sf).drop("ts")
    path = io.save_csv(raw, f"{work_dir(spark, 'flights')}/flights")
    text = io.load_or_generate(spark, [f"{path}-absent", path], unused, columns=RAW_COLUMNS + ["flight_id"])
    df = C.clean(text).withColumn("flight_id", F.col("flight_id").cast("bigint"))
    return df.select(F.col("FL_DATE").cast("string").alias("FL_DATE"), *_CLEAN_COLS)


@register("batch_file_roundtrip", operators=("S8", "I8"), oracle=with_ctes(["requests"], """
SELECT CAST(flight_id AS VARCHAR) AS flight_id, airline, origin || '→' || destination AS route, prediction, risk_level,
 printf('%.1f%%', round(CAST(CAST(p * 100 AS VARCHAR) AS DECIMAL(38, 17)), 1)) AS delay_probability
FROM (SELECT *, CASE WHEN p >= 0.5 THEN 'Delayed' ELSE 'On Time' END AS prediction,
        CASE WHEN p >= 0.5 THEN 'HIGH' ELSE 'LOW' END AS risk_level
      FROM (SELECT *, round(1/(1+exp(-(coalesce(departure_delay, 0)-15)/20)),4) AS p
            FROM req_valid WHERE reject_reason = '') v) w""", [_REQ_VALID]))
def batch_file_roundtrip(spark, sf):
    """Batch results with the two-way risk and percent text, written as CSV and read back."""
    valid = validate_requests(tables.requests(spark, sf)).where("is_valid")
    scored = batch_score(valid, _dictionary(spark, sf), rule=_rule, risk_scheme="two-way", percent=True)
    return io.read_text_csv(spark, io.save_csv(scored, f"{work_dir(spark, 'batch-out')}/scored"))


@register("dictionary_roundtrip", operators=("S9", "F6"), oracle=with_ctes(["encoder_dictionary"], """
SELECT column_name, value, code FROM encoder_dictionary"""))
def dictionary_roundtrip(spark, sf):
    """The category dictionary saved and loaded."""
    path = f"{work_dir(spark, 'dictionary')}/dictionary"
    save_dictionary(_dictionary(spark, sf), path)
    return load_dictionary(spark, path).table


@register("report_roundtrip", operators=("S12", "O3"), oracle=QUERIES["monitoring_report"].oracle)
def report_roundtrip(spark, sf):
    """The monitoring report written and read back."""
    path = f"{work_dir(spark, 'report')}/report"
    io.write_report(monitoring_report(tables.inference_log(spark, sf), AS_OF), path)
    return io.read_text_csv(spark, path).withColumn("value", F.round(F.col("value").cast("double"), 6))


@register("stream_drift", operators=("T2",), oracle=with_ctes(["inference_log"], """
SELECT CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end, n,
 d / CAST(n AS DOUBLE) AS delay_rate, n >= 50 AND abs(d / CAST(n AS DOUBLE) - 0.22) > 0.1 AS drift_detected
FROM (SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, count(*) AS n,
        count(*) FILTER (WHERE prediction = 'Delayed') AS d
      FROM (SELECT date_trunc('day', "timestamp") - k * INTERVAL 1 DAY AS window_start, prediction
            FROM inference_log, range(7) r(k)) w
      GROUP BY window_start) a
WHERE window_end <= (SELECT max("timestamp") FROM inference_log) - INTERVAL 1 DAY"""))
def stream_drift(spark, sf):
    """Drift per 7-day window sliding by a day, from the log as a stream;
    windows are emitted once the watermark (1 day) passes their end."""
    src, sink, ckpt = ST.fresh_paths(spark, "stream-drift")
    log = tables.inference_log(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    ST.stage_as_files(log, src)
    stream = ST.read_stream(spark, src, log.schema)
    out = ST.run_available(ST.drift_windows(stream), sink, ckpt)
    return out.select(F.col("window_start").cast("string").alias("window_start"),
                      F.col("window_end").cast("string").alias("window_end"),
                      "n", "delay_rate", "drift_detected")
