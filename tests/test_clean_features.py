"""Cleaning, validation, summary, features and the category dictionary."""

import datetime as dt

from pyspark.sql import functions as F

from tarmac.operators import clean as C
from tarmac.operators import features as FE
from tarmac.operators.requests import batch_requests, validate_requests
from tarmac.schema import ALL_FEATURES
from tarmac.sources import synthetic


def _raw(spark, rows):
    cols = "FL_DATE string, OP_CARRIER string, ORIGIN string, DEST string, DEP_TIME string, " \
           "DEP_DELAY string, ARR_DELAY string, DISTANCE string"
    return spark.createDataFrame(rows, cols)


def test_range_filter_and_label(spark):
    rows = [("2023-01-05", "AA", "JFK", "LAX", "1200", "5", a, "100") for a in
            ["-120", "600", "-119.9", "599.9", "15", "15.1", "abc", None]]
    out = C.clean(_raw(spark, rows)).orderBy("ARR_DELAY")
    got = [(r["ARR_DELAY"], r["is_delayed"]) for r in out.collect()]
    assert got == [(-119.9, 0), (15.0, 0), (15.1, 1), (599.9, 1)]


def test_month_weekday_hour_rules(spark):
    rows = [("2023-01-01", "AA", "JFK", "LAX", None, None, "10", "100"),
            ("2023-02-30", "AA", "JFK", "LAX", "2400", "3", "10", "100"),
            ("2023-03-06 10:00:00", "AA", "JFK", "LAX", "-5", "3", "10", "100")]
    out = C.clean(_raw(spark, rows)).orderBy("DEP_TIME").collect()
    by_date = {r["FL_DATE"]: r for r in out}
    jan = by_date[dt.date(2023, 1, 1)]
    assert (jan["MONTH"], jan["DAY_OF_WEEK"], jan["HOUR"], jan["DEP_DELAY"]) == (1, 7, 12, 0.0)
    bad = by_date[None]
    assert (bad["MONTH"], bad["DAY_OF_WEEK"], bad["HOUR"]) == (None, None, 23)
    mar = by_date[dt.date(2023, 3, 6)]
    assert (mar["MONTH"], mar["DAY_OF_WEEK"], mar["HOUR"]) == (3, 1, 0)


def test_existing_weekday_kept_and_defaults(spark):
    df = spark.createDataFrame([("AA", "10", "3", "100")], "OP_CARRIER string, ARR_DELAY string, "
                                                          "DAY_OF_WEEK string, DISTANCE string")
    r = C.clean(df).first()
    assert (r["DAY_OF_WEEK"], r["MONTH"], r["HOUR"]) == (3, 1, 12)


def test_header_trim(spark):
    df = spark.createDataFrame([("20",)], "` ARR_DELAY ` string")
    assert C.clean(df).columns[0] == "ARR_DELAY"


def test_validation_messages(spark):
    ok = C.clean(_raw(spark, [("2023-01-01", "AA", "J", "L", "1", "1", "20", "1"),
                              ("2023-01-01", "AA", "J", "L", "1", "1", "2", "1")]))
    assert tuple(C.validate(ok).first()) == (True, "Validation passed")
    one = C.clean(_raw(spark, [("2023-01-01", "AA", "J", "L", "1", "1", "2", "1")]))
    assert C.validate(one).first()[1] == "Target column has only one class — check data"
    empty = C.clean(_raw(spark, [("2023-01-01", "AA", "J", "L", "1", "1", "900", "1")]))
    assert C.validate(empty).first()[1] == "DataFrame is empty after cleaning"
    assert C.validate(ok.drop("MONTH")).first()[1] == "Missing required column: MONTH"


def test_summary_routes_skip_missing_ends(spark):
    rows = [("2023-01-01", "AA", "J", "L", "1", "1", "20", "1"),
            ("2023-01-01", "DL", "J", None, "1", "1", "2", "1"),
            ("2023-01-01", "DL", "J", "L", "1", "1", "2", "1")]
    r = C.data_summary(C.clean(_raw(spark, rows))).first()
    assert (r["total_flights"], r["delayed_flights"], r["airlines"], r["routes"]) == (3, 1, 2, 1)


def test_dictionary_order_and_unseen(spark):
    vals = ["a", "AA", "9E", "é", None, "B", "AA"]
    df = spark.createDataFrame([(v, "X", "Y") for v in vals], "OP_CARRIER string, ORIGIN string, DEST string")
    d = FE.fit_dictionary(df)
    codes = {r["value"]: r["code"] for r in d.for_column("OP_CARRIER").collect()}
    assert codes == {"9E": 0, "AA": 1, "B": 2, "a": 3, "nan": 4, "é": 5}
    new = spark.createDataFrame([("B", "X", "Z"), ("ZZ", "X", "Y")], "OP_CARRIER string, ORIGIN string, DEST string")
    enc = FE.encode(new, d).orderBy("OP_CARRIER").collect()
    assert [(r["AIRLINE_ENC"], r["ORIGIN_ENC"], r["DEST_ENC"]) for r in enc] == [(2, 0, 0), (0, 0, 0)]


def test_dictionary_has_no_class_limit(spark):
    df = spark.range(1_000_050).select(F.format_string("c%07d", F.col("id")).alias("OP_CARRIER"))
    d = FE.fit_dictionary(df)
    r = d.table.agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"),
                    F.count(F.when(F.substring("value", 2, 7).cast("int") != F.col("code"), 1)).alias("wrong")).first()
    assert (r["n"], r["lo"], r["hi"], r["wrong"]) == (1_000_050, 0, 1_000_049, 0)


def test_feature_matrix_no_missing(spark):
    raw = synthetic.generate(spark, 500, seed=42)
    enc, d = FE.build_features(C.clean(raw))
    X = FE.feature_columns(enc, keep=["is_delayed"])
    assert X.columns[1:] == ALL_FEATURES
    nulls = X.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in ALL_FEATURES]).first()
    assert sum(nulls) == 0
    stats = FE.feature_stats(X).first()
    assert stats["n_rows"] == X.count() and stats["rejected_rows"] == 0
    assert set(r[0] for r in X.select("is_delayed").distinct().collect()) == {0, 1}
    vals = X.agg(F.min("SEASON"), F.max("SEASON"), F.max("IS_WEEKEND"), F.max("DIST_BUCKET")).first()
    assert vals[0] >= 0 and vals[1] <= 3 and vals[2] <= 1 and vals[3] <= 5
    assert [f.dataType.simpleString() for f in X.schema.fields if f.name == "AIRLINE_ENC"] == ["int"]


def test_vocabulary_fallback(spark):
    v = FE.vocabulary(spark, None).collect()
    assert [r["value"] for r in v if r["kind"] == "airline"][:3] == ["AA", "DL", "UA"]


def test_request_validation(spark):
    req = spark.createDataFrame(
        [("aa", "jfk", " lax ", 15.0, 2475.0, 5, 7, 14), ("AA", "JFK", "LAX", None, 1000.0, 8, 6, None),
         ("AA", "JFK", "LAX", 0.0, 1000.0, 3, 13, 12), (None, "JFK", "LAX", 0.0, None, 3, 6, 24)],
        "airline string, origin string, destination string, departure_delay double, distance double, "
        "day_of_week int, month int, hour int")
    out = validate_requests(req).collect()
    assert (out[0]["airline"], out[0]["origin"], out[0]["destination"], out[0]["is_valid"]) == ("AA", "JFK", "LAX", True)
    assert (out[1]["is_valid"], out[1]["reject_reason"], out[1]["departure_delay"], out[1]["hour"]) == \
        (False, "day_of_week: out of range", 0.0, 12)
    assert out[2]["reject_reason"] == "month: out of range"
    assert out[3]["reject_reason"] == "airline: missing;distance: missing;hour: out of range"


def test_batch_upload_defaults(spark):
    up = spark.createDataFrame([("aa", "jfk", "lax", "2475", "5", "7"), ("dl", "atl", "ord", "x", "2", "3")],
                               "airline string, origin string, destination string, distance string, "
                               "day_of_week string, month string")
    out = batch_requests(up).orderBy("airline").collect()
    assert (out[0]["airline"], out[0]["departure_delay"], out[0]["hour"], out[0]["is_valid"]) == ("AA", 0.0, 12, True)
    assert (out[1]["is_valid"], out[1]["reject_reason"]) == (False, "distance: not a number")


def test_encode_then_decode_is_identity(spark):
    raw = synthetic.generate(spark, 300, seed=9)
    enc, d = FE.build_features(C.clean(raw))
    dec = FE.decode(enc, d)
    bad = dec.where((F.col("OP_CARRIER") != F.col("OP_CARRIER_DECODED")) |
                    (F.col("ORIGIN") != F.col("ORIGIN_DECODED")) | (F.col("DEST") != F.col("DEST_DECODED")))
    assert bad.count() == 0 and dec.count() == enc.count()


def test_typed_input_nan_and_inf_excluded(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (10.0,), (None,), (700.0,)],
                               "ARR_DELAY double")
    assert [r["ARR_DELAY"] for r in C.clean(df).collect()] == [10.0]
