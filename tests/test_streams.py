"""Streaming semantics: watermark drops late rows, duplicates across
micro-batches are removed, hot scores keep the exact AUC."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tarmac.operators import metrics as M
from tarmac.schema import INFERENCE_LOG_SCHEMA
from tarmac.streaming import streams as ST


def _rows(days, pred="Delayed"):
    base = dt.datetime(2024, 1, 1)
    return [(base + dt.timedelta(days=d, hours=h), "AA", "JFK", "LAX", 100.0, pred, 0.9)
            for d in days for h in range(0, 24, 6)]


def test_drift_window_drops_late_rows(spark):
    src, sink, ckpt = ST.fresh_paths(spark, "t-late")
    import time
    # three files, one micro-batch each; late rows are filtered with the
    # watermark of the previous batch, so the late row comes in the third
    for days, extra in [(range(0, 10), []), (range(10, 13), []),
                        (range(13, 20), _rows([1], pred="On Time")[:1])]:
        spark.createDataFrame(_rows(days) + extra, INFERENCE_LOG_SCHEMA).coalesce(1) \
            .write.mode("append").parquet(src)
        time.sleep(1.1)  # distinct modification times keep the file order
    stream = ST.read_stream(spark, src, INFERENCE_LOG_SCHEMA, max_files=1)
    out = ST.run_available(ST.drift_windows(stream, min_rows=1), sink, ckpt)
    rows = out.collect()
    assert rows, "closed windows are emitted"
    # the late 'On Time' row never reaches a window: every window is all delayed
    assert all(r["delay_rate"] == 1.0 for r in rows)
    w0 = [r for r in rows if r["window_start"] == dt.datetime(2023, 12, 27)]
    assert w0 and w0[0]["n"] == 4 * 2  # Jan 1 and Jan 2 (window Dec 27 - Jan 3)


def test_dedup_across_batches(spark):
    src, sink, ckpt = ST.fresh_paths(spark, "t-dedup")
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), "AA", "JFK", "LAX", 1.0, "Delayed", 0.7) for i in range(20)]
    schema = "flight_id long, " + INFERENCE_LOG_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " ")
    df = spark.createDataFrame(rows, schema)
    ST.stage_as_files(df.coalesce(1), src, copies=3)
    stream = ST.read_stream(spark, src, df.schema, max_files=1)
    ST.append_log_stream(stream, sink, ckpt).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == 20 and out.select("flight_id").distinct().count() == 20


def test_auc_with_a_hot_score(spark):
    rnd = random.Random(11)
    rows = [(1 if rnd.random() < 0.4 else 0, 0.5 if i % 3 == 0 else round(rnd.random(), 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "label int, probability double")
    pos = [p for y, p in rows if y == 1]
    neg = sorted(p for y, p in rows if y == 0)
    import bisect
    s = sum(bisect.bisect_left(neg, p) + 0.5 * (bisect.bisect_right(neg, p) - bisect.bisect_left(neg, p))
            for p in pos)
    assert abs(M.roc_auc(df).first()["roc_auc"] - s / (len(pos) * len(neg))) < 1e-12
    pts = M.roc_points(df).where(F.col("threshold") == 0.5).collect()
    assert len(pts) == 1


def test_append_log_hot_duplicate_key(spark):
    src, sink, ckpt = ST.fresh_paths(spark, "t-append")
    base = dt.datetime(2024, 1, 1)
    rows = [(i % 50 if i % 3 else 7, base + dt.timedelta(minutes=i % 50 if i % 3 else 7), "AA", "JFK", "LAX", 1.0,
             "Delayed", 0.7) for i in range(3000)]  # key 7 holds a third of the rows
    schema = "flight_id long, " + INFERENCE_LOG_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " ")
    df = spark.createDataFrame(rows, schema)
    ST.stage_as_files(df.repartition(3), src, copies=2)
    q = ST.append_log_stream(ST.read_stream(spark, src, df.schema, max_files=2), sink, ckpt)
    q.awaitTermination(300)
    assert q.exception() is None
    out = spark.read.parquet(sink)
    assert out.count() == 50 and out.select("flight_id").distinct().count() == 50
