"""Monitoring: stats, counts, recent rows, drift rule and report."""

import datetime as dt

from tarmac.operators import monitor as MO
from tarmac.schema import INFERENCE_LOG_SCHEMA

AS_OF = "2024-01-31 00:00:00"


def _log(spark, preds, probs, start=dt.datetime(2024, 1, 1), step_h=1):
    rows = [(start + dt.timedelta(hours=i * step_h), "AA", "JFK", "LAX", 100.0, p, q)
            for i, (p, q) in enumerate(zip(preds, probs))]
    return spark.createDataFrame(rows, INFERENCE_LOG_SCHEMA)


def test_stats_empty_and_small(spark):
    assert MO.prediction_stats(spark.createDataFrame([], INFERENCE_LOG_SCHEMA)).count() == 0
    log = _log(spark, ["Delayed", "On Time", "Delayed", "On Time", "On Time"], [0.7, 0.3, 0.8, 0.2, 0.4])
    s = MO.prediction_stats(log).first()
    assert s["total_predictions"] == 5 and abs(s["delay_rate"] - 0.4) < 1e-12
    assert s["high_risk_count"] == 1  # 0.7 is not above 0.7
    assert s["start"] == dt.datetime(2024, 1, 1) and s["end"] == dt.datetime(2024, 1, 1, 4)


def test_counts_and_recent(spark):
    log = _log(spark, ["Delayed"] * 3 + ["On Time"] * 5, [0.9] * 3 + [0.1] * 5).withColumn(
        "flight_id", __import__("pyspark.sql.functions", fromlist=["col"]).monotonically_increasing_id())
    c = [(r["prediction"], r["n"]) for r in MO.prediction_counts(log).collect()]
    assert c == [("On Time", 5), ("Delayed", 3)]
    r = MO.recent_rows(log, 4).collect()
    assert len(r) == 4 and r[0]["total"] == 4 and r[0]["window_delay_rate"] == 0.0


def _drift_log(spark, n, delayed, when=dt.datetime(2024, 1, 30)):
    preds = ["Delayed"] * delayed + ["On Time"] * (n - delayed)
    return _log(spark, preds, [0.5] * n, start=when - dt.timedelta(hours=n), step_h=1)


def test_drift_rules(spark):
    empty = MO.drift_check(spark.createDataFrame([], INFERENCE_LOG_SCHEMA), AS_OF).first()
    assert (empty["drift_detected"], empty["message"]) == (False, "No data")
    few = MO.drift_check(_drift_log(spark, 49, 49), AS_OF).first()
    assert (few["drift_detected"], few["message"]) == (False, "Insufficient recent data (49 predictions)")
    hit = MO.drift_check(_drift_log(spark, 50, 50), AS_OF).first()
    assert hit["drift_detected"] and hit["recent_predictions"] == 50 and hit["message"] is None
    assert hit["alert"] == "⚠️ Data drift detected! (78.0% > 10.0%)"
    assert hit["recommendation"] == "Consider retraining model"
    # rate .25 -> drift .03: evaluated, healthy
    ok = MO.drift_check(_drift_log(spark, 100, 25), AS_OF).first()
    assert not ok["drift_detected"] and ok["alert"] == "✅ No significant drift"
    # drift equal to the threshold is not drift (python float rule)
    rate, base = 0.32, 0.22
    eq = MO.drift_check(_drift_log(spark, 100, 32), AS_OF).first()
    assert eq["drift_detected"] == (abs(rate - base) > 0.1)
    # old rows are outside the 7-day window
    old = MO.drift_check(_drift_log(spark, 60, 60, when=dt.datetime(2024, 1, 10)), AS_OF).first()
    assert old["recent_predictions"] == 0 and not old["drift_detected"]


def test_report_rows(spark):
    rep = MO.monitoring_report(_drift_log(spark, 60, 30), AS_OF).collect()
    d = {(r["section"], r["metric"]): r for r in rep}
    assert d[("PREDICTION STATS", "delay_rate")]["text"] == "50.0%"
    assert d[("DRIFT ANALYSIS", "status")]["text"] == "⚠️ Data drift detected! (28.0% > 10.0%)"
    assert d[("REPORT", "generated")]["text"] == AS_OF
    assert len(rep) == 10
