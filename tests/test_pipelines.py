"""End-to-end plans: train -> artifacts -> batch file scoring -> live stream
into the log -> monitoring report."""

import datetime as dt

from pyspark.sql import functions as F

from tarmac.operators import learn as L
from tarmac.plans import pipelines as P
from tarmac.session import work_dir
from tarmac.sources import io, synthetic

SMALL = L.Presets(lr_max_iter=50, rf_trees=10, gbt_rounds=5)


def test_end_to_end(spark):
    root = work_dir(spark, "e2e")
    art = P.Artifacts(root + "/artifacts")
    res = P.training_run(spark, synthetic.generate(spark, 800, seed=5), art, SMALL)
    assert res.best_name in L.MODEL_ORDER
    info = P.model_info(spark, art).collect()
    assert [r["name"] for r in info if r["kind"] == "model"] == [res.best_name]
    assert sum(r["kind"] == "feature" for r in info) == 12 and any(r["kind"] == "airport" for r in info)
    assert {r["name"] for r in info if r["kind"] == "metric"} == {"roc_auc", "accuracy", "precision", "recall", "f1"}
    assert spark.read.parquet(art.evaluation + "/report").count() == 5
    assert spark.read.parquet(art.evaluation + "/summary").count() == 1
    from tarmac.operators.metrics import full_evaluation
    ev = full_evaluation(res.scored_test().cache(), res.best_name)
    assert ev["comparison"].count() == 20 and ev["confusion"].count() == 4 and ev["report"].count() == 5
    assert ev["roc"].count() >= 2

    up = spark.createDataFrame(
        [("AS", "SEA", "PHX", "12", "1107", "3", "2", "21"), ("F9", "MCO", "BWI", "33", "787", "7", "10", "6"),
         ("HA", "LAS", "DTW", "-8", "1749", "4", "5", "13"), ("OO", "MSP", "SLC", "90", "991", "1", "11", "18"),
         ("OO", "MSP", "SLC", "90", "", "1", "11", "18")],
        "airline string, origin string, destination string, departure_delay string, distance string, "
        "day_of_week string, month string, hour string")
    io.save_csv(up, root + "/upload")
    scored = P.batch_score_file(spark, root + "/upload", art, root + "/scored")
    assert scored.count() == 4
    assert spark.read.option("header", True).csv(root + "/scored_rejected").count() == 1

    schema = ("flight_id long, request_ts timestamp, airline string, origin string, destination string, "
              "departure_delay double, distance double, day_of_week int, month int, hour int")
    t0 = dt.datetime(2024, 1, 29, 12)
    reqs = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=i), "aa", "jfk", "lax", float(i % 40), 1000.0 + i,
                                   1 + i % 7, 1 + i % 12, i % 24) for i in range(60)]
                                  + [(99, t0, "aa", "jfk", "lax", 1.0, float("nan"), 1, 1, 1)], schema)
    src = root + "/requests"
    reqs.write.parquet(src)
    for q in P.start_scoring_stream(spark, src, reqs.schema, art, root + "/log", root + "/log_ckpt", trigger_seconds=None,
                                    responses_path=root + "/responses", rejects_path=root + "/rejects"):
        q.awaitTermination()
    resp = spark.read.parquet(root + "/responses")
    assert resp.count() == 60 == resp.select("inference_id").distinct().count()
    assert resp.where("confidence IS NULL OR risk_level IS NULL").count() == 0
    assert spark.read.parquet(root + "/rejects").where("reject_reason = 'distance: not a number'").count() == 1
    log = io.load_inference_log(spark, root + "/log")
    assert log.count() == 60
    assert log.where(F.col("origin") == "JFK").count() == 60

    dq = P.start_drift_stream(spark, root + "/log", root + "/drift", root + "/drift_ckpt", trigger_seconds=None)
    dq.awaitTermination(300)
    assert dq.exception() is None  # one hour of log: no window closed yet

    rep = P.monitoring_run(spark, root + "/log", "2024-01-31 00:00:00", root + "/report")
    d = {r["metric"]: r for r in rep.collect()}
    assert d["total_predictions"]["value"] == 60.0
    assert d["status"]["text"] != "N/A"  # 60 recent rows: evaluated


def test_a_new_run_takes_over_between_micro_batches(spark):
    root = work_dir(spark, "swap")
    art = P.Artifacts(root + "/artifacts")
    one = L.Presets(lr_max_iter=5, rf_trees=2, rf_depth=2, gbt_rounds=1)
    P.training_run(spark, synthetic.generate(spark, 400, seed=5), art, one)
    schema = ("flight_id long, request_ts timestamp, airline string, origin string, destination string, "
              "departure_delay double, distance double, day_of_week int, month int, hour int")
    t0 = dt.datetime(2024, 1, 29, 12)

    def batch(first):
        rows = [(i, t0 + dt.timedelta(minutes=i), "aa", "jfk", "lax", float(i % 40), 900.0, 1, 1, 9) for i in range(first, first + 20)]
        return spark.createDataFrame(rows, schema)

    current, paths = P.CurrentModel(spark, art), (root + "/log", "flight_id", root + "/responses", root + "/rejects")
    P.score_batch(batch(0), current, *paths)
    old = current.version
    P.training_run(spark, synthetic.generate(spark, 500, seed=6), art, one)
    P.score_batch(batch(20), current, *paths)
    P.score_batch(batch(20), current, *paths)               # the batch is run again: nothing twice
    P.score_batch(batch(0), current, *paths)                # re-delivered after the swap: kept as it was scored
    assert current.version != old
    got = spark.read.parquet(root + "/responses").groupBy("model_version").agg(F.count("*").alias("n"), F.min("flight_id").alias("a"))
    assert {(r.model_version, r.n, r.a) for r in got.collect()} == {(old, 20, 0), (current.version, 20, 20)}
    assert io.load_inference_log(spark, root + "/log").count() == 40
