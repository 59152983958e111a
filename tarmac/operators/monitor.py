"""Monitoring of the inference log: stats, value counts, histogram, recent
rows, trailing-window drift and the report — each a single aggregation (or
a top-k) over the log; the log is read once per report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.scalar import percent_text
from tarmac.schema import (DELAYED, DRIFT_BASELINE, DRIFT_MIN_ROWS, DRIFT_THRESHOLD,
                           DRIFT_WINDOW_DAYS, HIGH_RISK_PROBABILITY)

HIST_BINS = 30


def _delayed() -> Column:
    """Is the prediction 'Delayed'; a missing prediction is not."""
    return F.coalesce(F.col("prediction") == F.lit(DELAYED), F.lit(False))


def prediction_stats(log: DataFrame) -> DataFrame:
    """count, share 'Delayed' (a missing prediction counts as not delayed),
    mean probability, count of probability > 0.7, first and last timestamp.
    No rows for an empty log."""
    agg = log.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg(_delayed().cast("double")).alias("delay_rate"),
        F.avg("probability").alias("avg_probability"),
        F.count(F.when(F.col("probability") > F.lit(HIGH_RISK_PROBABILITY), 1)).alias("high_risk_count"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
    )
    return agg.where(F.col("total_predictions") > 0)


def prediction_counts(log: DataFrame) -> DataFrame:
    """Rows per prediction value, most frequent first (missing values dropped)."""
    return log.where(F.col("prediction").isNotNull()).groupBy("prediction") \
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("prediction"))


def probability_histogram(log: DataFrame, bins: int = HIST_BINS, weight: str | None = None) -> DataFrame:
    """Equal-width bins from min to max (last bin closed); equal min and max
    widen by 0.5 on each side; empty bins present. ``weight`` names a column
    that says how often a row counts."""
    times = F.col(weight) if weight else F.lit(1)
    p = log.select(F.col("probability").alias("p"), times.cast("bigint").alias("w")).where(F.col("p").isNotNull())
    mm = p.agg(F.min("p").alias("lo0"), F.max("p").alias("hi0")).select(
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
    ).where(F.col("lo").isNotNull())
    mm = F.broadcast(mm)  # one row
    lo, hi = F.col("lo"), F.col("hi")
    step = (hi - lo) / F.lit(bins)

    def edge(i: Column) -> Column:
        return F.when(i >= bins, hi).otherwise(lo + i * step)

    raw = F.least(F.floor((F.col("p") - lo) * (F.lit(bins) / (hi - lo))), F.lit(bins - 1)).cast("int")
    b1 = F.when(F.col("p") < edge(raw), raw - 1).otherwise(raw)
    b2 = F.when((F.col("p") >= edge(b1 + 1)) & (b1 != bins - 1), b1 + 1).otherwise(b1)
    counts = p.crossJoin(mm).select(b2.alias("bin"), "w").groupBy("bin").agg(F.sum("w").alias("n"))
    grid = p.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(mm)
    grid = grid.select("bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"))
    return grid.join(counts, "bin", "left").select(
        "bin", "bin_start", "bin_end", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def recent_rows(log: DataFrame, limit: int = 100, ts_col: str = "timestamp",
                key_col: str = "flight_id") -> DataFrame:
    """The last ``limit`` rows by (timestamp, key), each with the count and
    delay rate of those rows (a top-k: per-partition top-k, then merge)."""
    last = log.orderBy(F.desc(ts_col), F.desc(key_col)).limit(limit)
    w = Window.partitionBy()  # bounded: the ``limit`` rows of the top-k
    delayed = _delayed().cast("double")
    return last.withColumns({
        "total": F.count(F.lit(1)).over(w),
        "window_delay_rate": F.coalesce(F.avg(delayed).over(w), F.lit(0.0)),
    })


def session_sequence(log: DataFrame, ts_col: str = "timestamp", key_col: str = "flight_id") -> DataFrame:
    """Per prediction: position, probability (as read back from its percent
    text), delayed flag and the 0.5 line; plus the session's delay rate."""
    from tarmac.functions.scalar import percent_value
    from tarmac.operators.ranking import global_row_number
    key = F.unix_micros(F.col(ts_col).cast("timestamp"))
    seq = global_row_number(log, key, F.col(key_col), "seq")
    d = _delayed().cast("int")
    out = seq.select(key_col, "seq", percent_value(percent_text(F.col("probability"))).alias("probability_shown"),
                     d.alias("is_delayed"), F.lit(0.5).alias("threshold"))
    rate = log.agg(F.avg(_delayed().cast("double")).alias("session_delay_rate"))
    return out.crossJoin(F.broadcast(rate))  # rate: one row


def _cutoff(as_of, window_days: int):
    return F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(window_days))


def _recent_pred(log: DataFrame, as_of, window_days: int, ts_col: str) -> Column:
    """timestamp >= as_of - window_days; on a date-partitioned log also a
    predicate on the partition column, so the scan prunes to those days."""
    cutoff = _cutoff(as_of, window_days)
    cond = F.col(ts_col).isNotNull() & (F.col(ts_col).cast("timestamp") >= cutoff)
    if "log_date" in log.columns:
        cond = cond & (F.col("log_date") >= F.to_date(cutoff))
    return cond


def recent_window(log: DataFrame, as_of, window_days: int = DRIFT_WINDOW_DAYS,
                  ts_col: str = "timestamp") -> DataFrame:
    """Rows with timestamp >= as_of - window_days (missing timestamps out)."""
    return log.where(_recent_pred(log, as_of, window_days, ts_col))


def _drift_columns(baseline: float, window_days: int, threshold: float, min_rows: int) -> list[Column]:
    """Drift row from ``has_rows``, ``recent_predictions``, ``_recent_delayed``."""
    has, n = F.col("has_rows"), F.col("recent_predictions")
    evaluated = has & (n >= min_rows)
    rate = F.when(evaluated, F.col("_recent_delayed") / n.cast("double"))
    drift = F.abs(rate - F.lit(baseline))
    detected = F.coalesce(evaluated & (drift > F.lit(threshold)), F.lit(False))
    # fixed values: the texts below are the result's
    alert = F.when(evaluated & detected, F.concat(F.lit("⚠️ Data drift detected! ("), percent_text(drift),
                                                   F.lit(" > "), percent_text(F.lit(threshold)), F.lit(")"))) \
             .when(evaluated, F.lit("✅ No significant drift"))
    return [
        detected.alias("drift_detected"),
        F.when(evaluated, F.lit(baseline)).alias("baseline_delay_rate"),
        rate.alias("recent_delay_rate"),
        drift.alias("drift_magnitude"),
        F.when(evaluated, F.lit(threshold)).alias("threshold"),
        F.when(evaluated, F.lit(window_days)).alias("window_days"),
        n.alias("recent_predictions"),
        alert.alias("alert"),
        F.when(evaluated & detected, F.lit("Consider retraining model"))
         .when(evaluated, F.lit("Model healthy")).alias("recommendation"),
        F.when(~has, F.lit("No data"))
         .when(~evaluated, F.concat(F.lit("Insufficient recent data ("), n.cast("string"), F.lit(" predictions)")))
         .alias("message"),
    ]


def drift_check(log: DataFrame, as_of, baseline: float = DRIFT_BASELINE,
                window_days: int = DRIFT_WINDOW_DAYS, threshold: float = DRIFT_THRESHOLD,
                min_rows: int = DRIFT_MIN_ROWS, ts_col: str = "timestamp") -> DataFrame:
    """One row with a fixed schema for every outcome: no data, too few recent
    rows (not detected), or evaluated (detected when |rate - baseline| >
    threshold, strictly). Reads the trailing window only (pruned on a
    date-partitioned log) plus a one-row probe for "no data"."""
    recent = recent_window(log, as_of, window_days, ts_col)
    counts = recent.agg(
        F.count(F.lit(1)).alias("recent_predictions"),
        F.count(F.when(F.col("prediction") == F.lit(DELAYED), 1)).alias("_recent_delayed"))
    probe = log.select(F.lit(1).alias("_one")).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows"))
    return counts.crossJoin(probe).select(*_drift_columns(baseline, window_days, threshold, min_rows))


def monitoring_report(log: DataFrame, as_of, baseline: float = DRIFT_BASELINE,
                      window_days: int = DRIFT_WINDOW_DAYS, threshold: float = DRIFT_THRESHOLD,
                      min_rows: int = DRIFT_MIN_ROWS, ts_col: str = "timestamp") -> DataFrame:
    """Report rows (section, metric, value, text): prediction stats and drift
    from one pass over the log; missing values read as 0 as in the text
    report."""
    recent = _recent_pred(log, as_of, window_days, ts_col)
    row = log.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg(_delayed().cast("double")).alias("delay_rate"),
        F.avg("probability").alias("avg_probability"),
        F.count(F.when(F.col("probability") > F.lit(HIGH_RISK_PROBABILITY), 1)).alias("high_risk_count"),
        F.count(F.when(recent, 1)).alias("recent_predictions"),
        F.count(F.when(recent & (F.col("prediction") == F.lit(DELAYED)), 1)).alias("_recent_delayed"),
    ).withColumn("has_rows", F.col("total_predictions") > 0)
    return report_rows(row, as_of, baseline, window_days, threshold, min_rows)


def report_rows(row: DataFrame, as_of, baseline: float, window_days: int, threshold: float, min_rows: int) -> DataFrame:
    """The report's rows from one row of totals (total_predictions, delay_rate,
    avg_probability, high_risk_count, recent_predictions, _recent_delayed, has_rows)."""
    row = row.select("total_predictions", "delay_rate", "avg_probability", "high_risk_count",
                     *_drift_columns(baseline, window_days, threshold, min_rows))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    three = lambda c: F.format_string("%.3f", F.round(z(c), 3))

    def item(section, metric, value, text):
        return F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                        value.cast("double").alias("value"), text.cast("string").alias("text"))

    none = F.lit(None)
    items = F.array(
        item("PREDICTION STATS", "total_predictions", z("total_predictions"),
             F.col("total_predictions").cast("string")),
        item("PREDICTION STATS", "delay_rate", z("delay_rate"), percent_text(z("delay_rate"))),
        item("PREDICTION STATS", "avg_probability", z("avg_probability"), three("avg_probability")),
        item("PREDICTION STATS", "high_risk_count", z("high_risk_count"),
             F.col("high_risk_count").cast("string")),
        item("DRIFT ANALYSIS", "status", none, F.coalesce(F.col("alert"), F.lit("N/A"))),
        item("DRIFT ANALYSIS", "baseline_rate", z("baseline_delay_rate"), percent_text(z("baseline_delay_rate"))),
        item("DRIFT ANALYSIS", "recent_rate", z("recent_delay_rate"), percent_text(z("recent_delay_rate"))),
        item("DRIFT ANALYSIS", "drift", z("drift_magnitude"), percent_text(z("drift_magnitude"))),
        item("DRIFT ANALYSIS", "recommendation", none, F.coalesce(F.col("recommendation"), F.lit("N/A"))),
        item("REPORT", "generated", none, F.lit(str(as_of))),
    )
    return row.select(F.explode(items).alias("r")).select(
        F.col("r.section").alias("section"), F.col("r.metric").alias("metric"),
        F.col("r.value").alias("value"), F.col("r.text").alias("text"))
