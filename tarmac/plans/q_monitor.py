"""Registered queries: monitoring of the inference log (A2-A5, A8, O1-O3).
The log is the rule-scored flights stamped with their event time; ``as_of``
replaces the wall clock."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import monitor as MO
from tarmac.operators import rollup as RO
from tarmac.plans.oracle import with_ctes
from tarmac.plans.registry import register
from tarmac.session import work_dir
from tarmac.sources import io, tables

AS_OF = "2024-01-31 00:00:00"
CUTOFF = "2024-01-24 00:00:00"  # AS_OF - 7 days


def _log(spark, sf):
    return tables.inference_log(spark, sf)


def _pct_sql(x: str) -> str:
    """Percent text, one decimal, half up on the shortest decimal form."""
    return f"printf('%.1f%%', round(CAST(CAST(({x}) * 100 AS VARCHAR) AS DECIMAL(38, 17)), 1))"


@register("prediction_stats", operators=("A2",), oracle=with_ctes(["inference_log"], """
SELECT count(*) AS total_predictions,
 avg(CAST(coalesce(prediction = 'Delayed', false) AS DOUBLE)) AS delay_rate,
 round(avg(probability), 6) AS avg_probability,
 count(*) FILTER (WHERE probability > 0.7) AS high_risk_count,
 CAST(min("timestamp") AS VARCHAR) AS "start", CAST(max("timestamp") AS VARCHAR) AS "end"
FROM inference_log HAVING count(*) > 0"""))
def prediction_stats(spark, sf):
    s = MO.prediction_stats(_log(spark, sf))
    return s.select("total_predictions", "delay_rate", F.round("avg_probability", 6).alias("avg_probability"),
                    "high_risk_count", F.col("start").cast("string").alias("start"),
                    F.col("end").cast("string").alias("end"))


@register("prediction_counts", operators=("A3",), oracle=with_ctes(["inference_log"], """
SELECT prediction, count(*) AS n FROM inference_log WHERE prediction IS NOT NULL GROUP BY prediction"""))
def prediction_counts(spark, sf):
    return MO.prediction_counts(_log(spark, sf))


@register("probability_histogram", operators=("A4",), oracle=with_ctes(["inference_log"], """
SELECT g.bin, g.bin_start, g.bin_end, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT CAST(i AS INTEGER) AS bin, CASE WHEN i >= 30 THEN hi ELSE lo + i * ((hi - lo) / 30) END AS bin_start,
        CASE WHEN i + 1 >= 30 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 30) END AS bin_end
      FROM range(30) r(i), mm) g
LEFT JOIN (SELECT b2 AS bin, count(*) AS n FROM (
   SELECT CASE WHEN p >= (CASE WHEN b1 + 1 >= 30 THEN hi ELSE lo + (b1 + 1) * ((hi - lo) / 30) END) AND b1 <> 29
               THEN b1 + 1 ELSE b1 END AS b2
   FROM (SELECT p, lo, hi, CASE WHEN p < (CASE WHEN raw >= 30 THEN hi ELSE lo + raw * ((hi - lo) / 30) END)
                           THEN raw - 1 ELSE raw END AS b1
         FROM (SELECT p, lo, hi, CAST(least(floor((p - lo) * (30 / (hi - lo))), 29) AS INTEGER) AS raw
               FROM (SELECT probability AS p FROM inference_log WHERE probability IS NOT NULL) x, mm) y) z) w
   GROUP BY b2) c ON g.bin = c.bin""", ["""
mm AS (SELECT CASE WHEN min(p) = max(p) THEN min(p) - 0.5 ELSE min(p) END AS lo,
              CASE WHEN min(p) = max(p) THEN max(p) + 0.5 ELSE max(p) END AS hi
       FROM (SELECT probability AS p FROM inference_log WHERE probability IS NOT NULL) q
       HAVING count(*) > 0)"""]))
def probability_histogram(spark, sf):
    return MO.probability_histogram(_log(spark, sf))


_LOG_COLS = ('flight_id, CAST("timestamp" AS VARCHAR) AS "timestamp", airline, origin, destination, '
             'distance, prediction, probability')


@register("recent_log", operators=("A5",), oracle=with_ctes(["inference_log"], f"""
SELECT {_LOG_COLS}, (SELECT count(*) FROM last) AS total,
 (SELECT coalesce(avg(CAST(coalesce(prediction = 'Delayed', false) AS DOUBLE)), 0.0) FROM last) AS window_delay_rate
FROM last""", ["""
last AS (SELECT * FROM inference_log ORDER BY "timestamp" DESC, flight_id DESC LIMIT 100)"""]))
def recent_log(spark, sf):
    r = MO.recent_rows(_log(spark, sf), 100)
    return r.withColumn("timestamp", F.col("timestamp").cast("string"))


def _dated_log(spark, sf):
    """The log written in two appends, as a growing log is."""
    path, log = f"{work_dir(spark, 'log')}/log", _log(spark, sf)
    half = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp")
    io.append_inference_log(log.where(half), path)
    return path, log.where(~half | F.col("timestamp").isNull())


@register("recent_log_dates", operators=("A5", "S5"), oracle=with_ctes(["inference_log"], f"""
SELECT {_LOG_COLS}, (SELECT count(*) FROM last) AS total,
 (SELECT coalesce(avg(CAST(coalesce(prediction = 'Delayed', false) AS DOUBLE)), 0.0) FROM last) AS window_delay_rate
FROM last""", ["""
last AS (SELECT * FROM inference_log ORDER BY "timestamp" DESC, flight_id DESC LIMIT 100)"""]))
def recent_log_dates(spark, sf):
    """The last 100 rows of a date-partitioned log, reading its newest dates only."""
    path, rest = _dated_log(spark, sf)
    io.append_inference_log(rest, path)
    r = RO.recent_rows(spark, path, 100).drop("log_date")
    return r.withColumn("timestamp", F.col("timestamp").cast("string"))


@register("log_distinct_sketches", operators=("A1", "P12"), oracle=with_ctes(["inference_log"], """
SELECT 'airline' AS "column", count(DISTINCT airline) AS n, true AS within FROM inference_log
UNION ALL SELECT 'origin', count(DISTINCT origin), true FROM inference_log
UNION ALL SELECT 'destination', count(DISTINCT destination), true FROM inference_log
UNION ALL SELECT 'flight_id', count(DISTINCT flight_id), true FROM inference_log"""))
def log_distinct_sketches(spark, sf):
    """Distinct values from stored per-date sketches beside the exact counts; ``within``: the estimate keeps its bound."""
    cols = ["airline", "origin", "destination", "flight_id"]
    log = _log(spark, sf).withColumn("log_date", F.to_date("timestamp"))
    path = f"{work_dir(spark, 'sketch')}/sketches"
    RO.sketches(log, cols).write.parquet(path)
    found = RO.distinct_counts(spark.read.parquet(path)).withColumnRenamed("n", "estimate")
    exact = log.agg(*[F.count_distinct(c).alias(c) for c in cols]).unpivot([], cols, "column", "n")
    ok = F.abs(F.col("estimate") - F.col("n")) <= F.lit(RO.SKETCH_ERROR) * F.col("n")
    return exact.join(found, "column").select("column", "n", ok.alias("within"))


@register("session_sequence", operators=("A8", "P17"), oracle=with_ctes(["inference_log"], f"""
SELECT flight_id, row_number() OVER (ORDER BY "timestamp", flight_id) AS seq,
 CAST(replace({_pct_sql('probability')}, '%', '') AS DOUBLE) / 100 AS probability_shown,
 CAST(coalesce(prediction = 'Delayed', false) AS INTEGER) AS is_delayed, CAST(0.5 AS DOUBLE) AS threshold,
 avg(CAST(coalesce(prediction = 'Delayed', false) AS DOUBLE)) OVER () AS session_delay_rate
FROM inference_log"""))
def session_sequence(spark, sf):
    return MO.session_sequence(_log(spark, sf))


@register("recent_window", operators=("O1",), oracle=with_ctes(["inference_log"], f"""
SELECT flight_id, CAST("timestamp" AS VARCHAR) AS "timestamp", prediction, probability
FROM inference_log WHERE "timestamp" >= TIMESTAMP '{CUTOFF}'"""))
def recent_window(spark, sf):
    r = MO.recent_window(_log(spark, sf), AS_OF)
    return r.select("flight_id", F.col("timestamp").cast("string").alias("timestamp"), "prediction", "probability")


_DRIFT = f"""
drift_a AS (SELECT count(*) AS n_all,
   count(*) FILTER (WHERE "timestamp" >= TIMESTAMP '{CUTOFF}') AS n,
   count(*) FILTER (WHERE "timestamp" >= TIMESTAMP '{CUTOFF}' AND prediction = 'Delayed') AS d
 FROM inference_log),
drift_b AS (SELECT *, n_all > 0 AND n >= 50 AS ev,
   CASE WHEN n_all > 0 AND n >= 50 THEN d / CAST(n AS DOUBLE) END AS rate FROM drift_a),
drift AS (SELECT
  coalesce(ev AND abs(rate - 0.22) > 0.1, false) AS drift_detected,
  CASE WHEN ev THEN 0.22 END AS baseline_delay_rate,
  rate AS recent_delay_rate,
  abs(rate - 0.22) AS drift_magnitude,
  CASE WHEN ev THEN 0.1 END AS threshold,
  CASE WHEN ev THEN 7 END AS window_days,
  n AS recent_predictions,
  CASE WHEN ev AND abs(rate - 0.22) > 0.1
       THEN '⚠️ Data drift detected! (' || {_pct_sql('abs(rate - 0.22)')} || ' > ' || {_pct_sql('0.1')} || ')'
       WHEN ev THEN '✅ No significant drift' END AS alert,
  CASE WHEN ev AND abs(rate - 0.22) > 0.1 THEN 'Consider retraining model'
       WHEN ev THEN 'Model healthy' END AS recommendation,
  CASE WHEN n_all = 0 THEN 'No data'
       WHEN NOT ev THEN 'Insufficient recent data (' || CAST(n AS VARCHAR) || ' predictions)' END AS message
 FROM drift_b)"""


@register("drift_check", operators=("O1", "O2"), oracle=with_ctes(["inference_log"], """
SELECT drift_detected, CAST(baseline_delay_rate AS DOUBLE) AS baseline_delay_rate, recent_delay_rate,
 drift_magnitude, CAST(threshold AS DOUBLE) AS threshold, CAST(window_days AS INTEGER) AS window_days,
 recent_predictions, alert, recommendation, message FROM drift""", [_DRIFT]))
def drift_check(spark, sf):
    return MO.drift_check(_log(spark, sf), AS_OF)


_REPORT_SQL = with_ctes(["inference_log"], f"""
SELECT section, metric, CAST(value AS DOUBLE) AS value, text FROM (
 SELECT 'PREDICTION STATS' AS section, 'total_predictions' AS metric, round(CAST(tp AS DOUBLE), 6) AS value,
        CAST(tp AS VARCHAR) AS text FROM st
 UNION ALL SELECT 'PREDICTION STATS', 'delay_rate', round(coalesce(dr, 0), 6), {_pct_sql('coalesce(dr, 0)')} FROM st
 UNION ALL SELECT 'PREDICTION STATS', 'avg_probability', round(coalesce(ap, 0), 6),
        printf('%.3f', round(CAST(CAST(coalesce(ap, 0) AS VARCHAR) AS DECIMAL(38, 17)), 3)) FROM st
 UNION ALL SELECT 'PREDICTION STATS', 'high_risk_count', round(CAST(hr AS DOUBLE), 6), CAST(hr AS VARCHAR) FROM st
 UNION ALL SELECT 'DRIFT ANALYSIS', 'status', NULL, coalesce(alert, 'N/A') FROM drift
 UNION ALL SELECT 'DRIFT ANALYSIS', 'baseline_rate', round(coalesce(baseline_delay_rate, 0), 6),
        {_pct_sql('coalesce(baseline_delay_rate, 0)')} FROM drift
 UNION ALL SELECT 'DRIFT ANALYSIS', 'recent_rate', round(coalesce(recent_delay_rate, 0), 6),
        {_pct_sql('coalesce(recent_delay_rate, 0)')} FROM drift
 UNION ALL SELECT 'DRIFT ANALYSIS', 'drift', round(coalesce(drift_magnitude, 0), 6),
        {_pct_sql('coalesce(drift_magnitude, 0)')} FROM drift
 UNION ALL SELECT 'DRIFT ANALYSIS', 'recommendation', NULL, coalesce(recommendation, 'N/A') FROM drift
 UNION ALL SELECT 'REPORT', 'generated', NULL, '{AS_OF}'
) t""", [_DRIFT, """
st AS (SELECT count(*) AS tp, avg(CAST(coalesce(prediction = 'Delayed', false) AS DOUBLE)) AS dr,
   avg(probability) AS ap, count(*) FILTER (WHERE probability > 0.7) AS hr FROM inference_log)"""])


@register("monitoring_report", operators=("O3", "S12"), oracle=_REPORT_SQL)
def monitoring_report(spark, sf):
    report = MO.monitoring_report(_log(spark, sf), AS_OF)
    return report.withColumn("value", F.round("value", 6))


@register("rollup_report", operators=("O3", "A2", "O2"), oracle=_REPORT_SQL)
def rollup_report(spark, sf):
    """The report from a per-date rollup that was extended by the dates of a second append."""
    path, rest = _dated_log(spark, sf)
    kept = f"{work_dir(spark, 'rollup')}/rollup"
    RO.update(spark, path, kept)
    io.append_inference_log(rest, path)
    RO.update(spark, path, kept)
    report = RO.report(RO.load(spark, kept), io.load_inference_log(spark, path), AS_OF)
    return report.withColumn("value", F.round("value", 6))


@register("rollup_counts", operators=("A3", "A4"), oracle=with_ctes(["inference_log"], """
SELECT prediction AS name, count(*) AS n FROM inference_log WHERE prediction IS NOT NULL GROUP BY prediction
UNION ALL SELECT 'probabilities', count(probability) FROM inference_log"""))
def rollup_counts(spark, sf):
    """Value counts from the rollup, and the rows that its histogram holds."""
    path, rest = _dated_log(spark, sf)
    io.append_inference_log(rest, path)
    kept = f"{work_dir(spark, 'rollup')}/rollup"
    RO.update(spark, path, kept)
    r = RO.load(spark, kept)
    total = RO.histogram(r).agg(F.lit("probabilities").alias("name"), F.sum("n").alias("n"))
    return RO.counts(r).select(F.col("prediction").alias("name"), "n").unionByName(total)
