"""Key filters of a dated log, deliveries long after the horizon, compaction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarmac.operators import logstore as LS
from tarmac.operators import rollup as RO
from tarmac.session import work_dir
from tarmac.sources import io
from tarmac.streaming import streams as ST

SCHEMA = "flight_id long, timestamp timestamp, prediction string"
DAY0 = dt.datetime(2024, 1, 1)


def _batch(spark, keys, day, prediction="Delayed"):
    return spark.createDataFrame([(k, DAY0 + dt.timedelta(days=day, minutes=i % 600), prediction) for i, k in enumerate(keys)], SCHEMA)


def _hashed(df):
    return df.select("log_date", F.xxhash64("flight_id").alias("h"))


def test_filters_know_every_key_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(LS, "SLICE_KEYS", 256)
    monkeypatch.setattr(LS, "SLICE_WORDS", 64)
    root = work_dir(spark, "t-filters")
    day = F.expr("date_add(DATE'2024-01-01', CAST(pmod(id, 3) AS INT))")
    log = spark.range(6000).select(F.col("id").alias("flight_id"), day.alias("log_date"))
    log = log.where("log_date != DATE'2024-01-03' OR flight_id < 60")             # a small date beside two large ones
    log.write.partitionBy("log_date").parquet(f"{root}/log")
    assert len(LS.update_filters(spark, f"{root}/log", f"{root}/f", _hashed, log.schema)) == 3
    days = spark.read.schema(LS.FILTER_SCHEMA).parquet(f"{root}/f/days")
    assert {r.slices for r in days.select("log_date", "slices").distinct().collect()} == {1, 8}
    assert all(len(r.words) == 64 for r in days.collect())

    def dates(ids):
        return set(LS.answering_dates(spark, ids.select(F.xxhash64("id").alias("h")), f"{root}/f"))
    assert dates(spark.range(0, 6000, 3)) >= {"2024-01-01"} and dates(spark.range(1, 2)) == {"2024-01-02"}
    for start in (0, 1):                                                          # no stored key is denied
        for i in range(start, 300, 30):
            assert f"2024-01-0{i % 3 + 1}" in dates(spark.range(i, i + 1)) or (i % 3 == 2 and i >= 60)
    asked = spark.range(10**6, 10**6 + 4000).select(F.xxhash64("id").alias("h"), LS._bits(F.xxhash64("id")).alias("bits"))
    one = days.where("log_date = DATE'2024-01-01'")
    asked = asked.withColumn("slice", LS._slice(F.col("h"), F.lit(8).cast("long"))).join(one, "slice")
    hit = F.forall("bits", lambda b: F.getbit(F.get("words", F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1)
    assert asked.where(hit).count() < 60                                          # 1.5 %, at 16 bits a key 0.1 % is expected


def test_a_duplicate_a_month_late_is_dropped(spark):
    sink = f"{work_dir(spark, 't-late')}/log"
    filters = sink + "-filters"
    for day in range(3):
        ST.append_once(_batch(spark, range(day * 100, day * 100 + 100), day), sink, filters=filters)
    late = _batch(spark, [*range(5), *range(900, 910)], 31, "On Time")
    ST.append_once(late, sink, filters=filters)
    assert spark.read.parquet(sink).count() == 310
    ST.append_once(late, sink, filters=filters)                                   # the batch again
    assert spark.read.parquet(sink).count() == 310
    known = _batch(spark, range(5), 60).withColumn("_mark", F.lit(None).cast("long"))
    found = LS.answering_dates(spark, known.select(LS.delivery_hash("flight_id", "_mark").alias("h")), filters)
    assert found == ["2024-01-01"]                                                # the other dates are not read
    nulls = spark.createDataFrame([(None, DAY0, "x"), (None, None, "x"), (3, None, "y")], SCHEMA)
    for _ in range(2):
        ST.append_once(nulls, sink, filters=filters)
    assert spark.read.parquet(sink).count() == 312                                # key 3 is known, rows without a key are new once
    ST.append_once(_batch(spark, [], 70), sink, filters=filters)                  # an empty batch
    assert spark.read.parquet(sink).count() == 312


def test_only_changed_dates_get_a_new_filter(spark):
    root = work_dir(spark, "t-changed")
    log = spark.range(300).select(F.col("id").alias("flight_id"), F.expr("date_add(DATE'2024-01-01', CAST(id % 3 AS INT))").alias("log_date"))
    log.write.partitionBy("log_date").parquet(f"{root}/log")
    args = (spark, f"{root}/log", f"{root}/f", _hashed, log.schema)
    assert LS.update_filters(*args, open_dates=("2024-01-03", "2024-01-04")) == ["2024-01-02", "2024-01-01"]
    log.limit(1).write.mode("append").partitionBy("log_date").parquet(f"{root}/log")
    assert LS.update_filters(*args) == ["2024-01-03", "2024-01-01"] and LS.update_filters(*args) == []


def _log_of_many_files(spark):
    path = f"{work_dir(spark, 't-compact')}/log"
    for i in range(4):
        for day in (0, 1, 9):
            io.append_inference_log(_batch(spark, range(i * 50, i * 50 + 50), day), path)
    io.append_inference_log(spark.createDataFrame([(1, None, "x")], SCHEMA), path)
    return path


def _content(spark, path):
    return sorted(map(str, spark.read.parquet(path).select("flight_id", "timestamp", "prediction", "log_date").collect()))


def test_compaction_keeps_rows_and_leaves_open_dates(spark):
    path = _log_of_many_files(spark)
    before, rows = RO.log_dates(spark, path), _content(spark, path)
    assert LS.compact(spark, path, "2024-01-10") == ["2024-01-02", "2024-01-01"]
    after = RO.log_dates(spark, path)
    # a checksum file stands beside each data file of the local file system
    assert after["2024-01-01"][0] < before["2024-01-01"][0] and after["2024-01-10"] == before["2024-01-10"]
    one = spark.read.parquet(path).where("log_date = DATE'2024-01-01'")
    assert one.select("_metadata.file_path").distinct().count() == 1
    assert _content(spark, path) == rows and LS.compact(spark, path, "2024-01-10") == []
    small = LS.compact(spark, path, "2024-01-11", target=1000)
    assert "2024-01-10" in small or after["2024-01-10"][0] <= -(-after["2024-01-10"][1] // 1000)
    assert _content(spark, path) == rows


def test_a_swap_that_was_cut_is_finished(spark):
    path = _log_of_many_files(spark)
    rows = _content(spark, path)
    fs, at = LS._fs(spark, path)
    fs.mkdirs(at(f"{path}/_compacted/old"))
    fs.rename(at(f"{path}/log_date=2024-01-01"), at(f"{path}/_compacted/old/log_date=2024-01-01"))
    assert _content(spark, path) != rows
    assert LS.recover(spark, path) == 1 and _content(spark, path) == rows and LS.recover(spark, path) == 0


def test_compaction_of_nothing(spark):
    assert LS.compact(spark, f"{work_dir(spark, 't-none')}/log", "2024-01-10") == []
