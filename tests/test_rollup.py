"""Rollup, recent dates, sketches, AUC bounds and the drift panes."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tarmac.operators import metrics as M
from tarmac.operators import monitor as MO
from tarmac.operators import rollup as RO
from tarmac.session import work_dir
from tarmac.sources import io
from tarmac.streaming import streams as ST

SCHEMA = "flight_id long, timestamp timestamp, airline string, prediction string, probability double"


def _rows(days, per_day=60, seed=1, start=0):
    rng, out = random.Random(seed), []
    for d in days:
        for k in range(per_day):
            p = round(rng.random(), 4) if k % 9 else None
            out.append((start + len(out), dt.datetime(2024, 1, d, rng.randrange(24), k % 60), f"A{k % 7}",
                        None if p is None else ("Delayed" if p >= 0.5 else "On Time"), p))
    return out


def _same(a, b):
    f = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]
    return sorted(f(a), key=repr) == sorted(f(b), key=repr)


def test_rollup_equals_the_full_scan_and_reads_changed_dates_only(spark):
    root = work_dir(spark, "t-rollup")
    log, kept = f"{root}/log", f"{root}/rollup"
    assert RO.update(spark, log, kept) == [] and RO.stats(RO.load(spark, kept)).collect() == []
    io.append_inference_log(spark.createDataFrame(_rows(range(1, 12)), SCHEMA), log)
    assert len(RO.update(spark, log, kept)) == 11 and RO.update(spark, log, kept) == []
    late = _rows([12], start=10_000) + _rows([3], 7, 5, 20_000) + [(30_000, None, "A1", "Delayed", 0.9)]
    io.append_inference_log(spark.createDataFrame(late, SCHEMA), log)
    assert sorted(RO.update(spark, log, kept)) == ["2024-01-03", "2024-01-12", RO.NULL_DATE]
    full, rolled = io.load_inference_log(spark, log), RO.load(spark, kept)
    assert _same(RO.stats(rolled), MO.prediction_stats(full))
    assert _same(RO.counts(rolled), MO.prediction_counts(full))
    assert _same(RO.histogram(rolled), MO.probability_histogram(full))
    for as_of in ("2024-01-13 00:00:00", "2024-01-12 13:37:00", "2024-01-02 05:00:00"):     # also in the middle of a day
        assert _same(RO.report(rolled, full, as_of), MO.monitoring_report(full, as_of))


def test_recent_rows_read_the_newest_dates(spark):
    log = f"{work_dir(spark, 't-recent')}/log"
    rows = _rows(range(1, 9), 40) + [(999_999, None, "A1", "Delayed", 0.9)]
    io.append_inference_log(spark.createDataFrame(rows, SCHEMA), log)
    full = io.load_inference_log(spark, log)
    for limit in (1, 40, 41, 100, 1000):                    # the newest day alone, more days, all with the row without a date
        got = RO.recent_rows(spark, log, limit)
        assert _same(got, MO.recent_rows(full, limit))
    files = RO.recent_rows(spark, log, 41).select("log_date").distinct().collect()
    assert len(files) == 2
    plan = RO.recent_rows(spark, log, 41)._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-07" in plan.replace("19729", "2024-01-07") and "PartitionFilters" in plan
    assert next(iter(RO.log_dates(spark, log))) == "2024-01-08" and list(RO.log_dates(spark, log))[-1] == RO.NULL_DATE


def test_sketches_unite_to_one_pass(spark):
    df = spark.range(30_000).select(F.col("id").alias("flight_id"), (F.col("id") % 7).alias("airline"),
                                    F.expr("date_add(DATE'2024-01-01', CAST(id % 9 AS INT))").alias("log_date"))
    united = {r["column"]: r["n"] for r in RO.distinct_counts(RO.sketches(df, ["flight_id", "airline"])).collect()}
    assert united["airline"] == 7 and abs(united["flight_id"] - 30_000) <= RO.SKETCH_ERROR * 30_000


def test_auc_bounds_hold_the_exact_value(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 3)) for _ in range(400)] + [(1, None), (0, 1.0), (1, 0.0)]
    df = spark.createDataFrame(rows, "label int, probability double")
    exact = M.roc_auc(df).first()["roc_auc"]
    for bins in (1, 10, 1000):
        b = M.auc_bounds(df, bins=bins).first()
        assert b["lower"] - 1e-12 <= exact <= b["upper"] + 1e-12
    assert b["upper"] - b["lower"] < 0.05
    assert M.auc_bounds(df.where("label = 1")).first()["lower"] is None


def _drift_batch(rows):
    out = {}
    for _, ts, _, p, _ in rows:
        for k in range(7):
            start = dt.datetime(ts.year, ts.month, ts.day) - dt.timedelta(days=k)
            n, d = out.get(start, (0, 0))
            out[start] = (n + 1, d + (p == "Delayed"))
    return out


def test_drift_panes_over_micro_batches_with_late_rows(spark):
    src, sink, ckpt = ST.fresh_paths(spark, "t-panes")
    first, second = _rows(range(1, 11), 30), _rows(range(11, 16), 30, 2, 1000)
    in_time = (5001, dt.datetime(2024, 1, 10, 1), "A1", "Delayed", 0.9)             # later than the watermark of the first batch
    too_late = (5002, dt.datetime(2024, 1, 2, 1), "A1", "Delayed", 0.9)             # behind it: dropped
    third = _rows([28], 5, 3, 2000)
    stream = None
    for batch in (first, second + [in_time, too_late], third):
        df = spark.createDataFrame(batch, SCHEMA)
        ST.stage_as_files(df.coalesce(1), src)
        stream = ST.drift_windows(ST.read_stream(spark, src, df.schema))
        got = ST.run_available(stream, sink, ckpt)
    want = _drift_batch(first + second + [in_time] + third)
    rows = {r.window_start: (r.n, round(r.delay_rate * r.n)) for r in got.collect()}
    closed = {s: v for s, v in want.items() if s + dt.timedelta(days=7) <= dt.datetime(2024, 1, 27)}
    assert {k: v for k, v in rows.items() if k in closed} == {k: v for k, v in closed.items() if k in rows}
    assert set(rows) >= {s for s in closed if s <= dt.datetime(2024, 1, 15)} and len(rows) == len(set(rows))


def test_drift_plan_has_no_expansion_of_rows(spark):
    src, _, _ = ST.fresh_paths(spark, "t-plan")
    df = spark.createDataFrame(_rows([1]), SCHEMA)
    ST.stage_as_files(df, src)
    plan = ST.drift_windows(spark.read.parquet(src))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") + plan.count("Generate") <= 1
    below = plan[plan.index("Aggregate", plan.index("Aggregate") + 1):]             # the panes' aggregation and its input
    assert "Expand" not in below and "Generate" not in below
