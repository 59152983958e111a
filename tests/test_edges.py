"""Edge tables per operator: every boundary of the data model."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tarmac.functions import bands as B
from tarmac.functions import scalar as S
from tarmac.functions.coerce import to_date, to_double


def _one_col(spark, values, dtype):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def test_numeric_coercion(spark):
    good = {"1e3": 1000.0, " 12 ": 12.0, "+5": 5.0, "inf": math.inf, "-2.5": -2.5, ".5": 0.5, "7.": 7.0}
    bad = ["0x10", "12d", "12f", "", "abc", "1_000", "1,000", "True", "nan", "NA", "None", "0x1p3"]
    df = _one_col(spark, list(good) + bad, "string")
    out = dict(df.select("v", to_double(F.col("v"), df.schema["v"].dataType).alias("x")).collect())
    for k, v in good.items():
        assert out[k] == v, k
    for k in bad:
        assert out[k] is None, k


def test_nan_becomes_null(spark):
    df = _one_col(spark, [float("nan"), 1.0, None], "double")
    got = [r[0] for r in df.orderBy("i").select(to_double(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [None, 1.0, None]


def test_date_coercion(spark):
    df = _one_col(spark, ["2023-01-01", "2023-02-30", "01/02/2023", "junk", None], "string")
    got = [r[0] for r in df.orderBy("i").select(to_date(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [dt.date(2023, 1, 1), None, dt.date(2023, 1, 2), None, None]


@pytest.mark.parametrize("d,b", [(-1, 2), (0, 2), (0.5, 0), (250, 0), (250.1, 1), (500, 1), (1000, 2),
                                 (1500, 3), (2000, 4), (6000, 5), (6000.1, 2), (None, 2)])
def test_distance_bucket(spark, d, b):
    df = spark.createDataFrame([(None if d is None else float(d),)], "d double")
    assert df.select(S.distance_bucket(F.col("d"))).first()[0] == b


def test_hour_from_dep_time(spark):
    cases = [(0, 0), (59, 0), (100, 1), (2359, 23), (2400, 23), (2500, 23), (-1, 0), (-250, 0),
             (None, 12), (math.inf, 12), (-math.inf, 12), (1259.9, 12)]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, (v, _) in enumerate(cases)], "i int, t double")
    got = [r[0] for r in df.orderBy("i").select(S.hour_from_dep_time(F.col("t"))).collect()]
    assert got == [h for _, h in cases]


def test_weekday_and_season(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1),), (dt.date(2023, 1, 2),), (None,)], "d date")
    assert [r[0] for r in df.select(S.iso_weekday(F.col("d"))).collect()] == [7, 1, None]
    m = spark.createDataFrame([(1,), (12,), (13,), (None,), (4,), (7,), (10,)], "m int")
    assert [r[0] for r in m.select(S.season(F.col("m"))).collect()] == [0, 0, 0, 0, 1, 2, 3]


def test_weekend_and_peak(spark):
    df = spark.createDataFrame([(5, 5), (6, 6), (7, 9), (None, 10), (1, 16), (2, 20), (3, 21), (4, None)],
                               "d int, h int")
    got = df.select(S.is_weekend(F.col("d")), S.is_peak_hour(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 1), (1, 1), (0, 0), (0, 1), (0, 1), (0, 0), (0, 0)]


def test_names_route_percent(spark):
    df = spark.createDataFrame([(1, 1, "JFK", "LAX", 0.4567), (7, 12, None, "ORD", 0.05)],
                               "d int, m int, o string, t string, p double")
    r = df.select(S.day_name(F.col("d")), S.month_name(F.col("m")), S.route(F.col("o"), F.col("t")),
                  S.percent_text(F.col("p"))).collect()
    assert tuple(r[0]) == ("Monday", "January", "JFK→LAX", "45.7%")
    assert tuple(r[1]) == ("Sunday", "December", None, "5.0%")
    back = spark.createDataFrame([("Wednesday", "July", "45.7%", "AA — American Airlines")], "a string, b string, c string, e string")
    r = back.select(S.day_number(F.col("a")), S.month_number(F.col("b")), S.percent_value(F.col("c")),
                    S.airline_code_from_label(F.col("e"))).first()
    assert (r[0], r[1], round(r[2], 6), r[3]) == (3, 7, 0.457, "AA")


def test_strip_upper(spark):
    df = spark.createDataFrame([(" aa ",), ("\tjfk\n",), ("lax",)], "s string")
    assert [r[0] for r in df.select(S.strip_upper(F.col("s"))).collect()] == ["AA", "JFK", "LAX"]


def _bands(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("p"))).collect()]


def test_risk_scheme_a(spark):
    eps = 1e-9
    got = _bands(spark, [0.1, 0.35, 0.55, 0.80, 0.3 - eps, 0.3, 0.5 - eps, 0.5, 0.7 - eps, 0.7],
                 lambda p: B.risk_level(p, "A"))
    assert got == ["LOW", "MODERATE", "HIGH", "VERY HIGH", "LOW", "MODERATE", "MODERATE", "HIGH",
                   "HIGH", "VERY HIGH"]


def test_risk_scheme_b_and_two_way(spark):
    eps = 1e-9
    got = _bands(spark, [0.25 - eps, 0.25, 0.45 - eps, 0.45, 0.65 - eps, 0.65], lambda p: B.risk_level(p, "B"))
    assert got == ["LOW RISK", "MODERATE RISK", "MODERATE RISK", "HIGH RISK", "HIGH RISK", "VERY HIGH RISK"]
    assert _bands(spark, [0.5 - eps, 0.5], lambda p: B.risk_level(p, "two-way")) == ["LOW", "HIGH"]
    assert _bands(spark, [0.5 - eps, 0.5], B.decision) == ["On Time", "Delayed"]
    assert _bands(spark, [0.5, 0.5 + eps], B.predicted_class) == [0, 1]


def _py_confidence(p):
    m = abs(p - 0.5)
    return "HIGH" if m > 0.35 else "MEDIUM" if m > 0.2 else "LOW"


def test_confidence(spark):
    values = [0.86, 0.851, 0.85, 0.75, 0.71, 0.7, 0.5, 0.1, 0.14, 0.15, 0.3, 0.29]
    got = _bands(spark, values, B.confidence)
    assert got == [_py_confidence(p) for p in values]
    assert got[:3] == ["HIGH", "HIGH", "MEDIUM"]  # margin .35 is not above .35


def test_size_shuffles(spark):
    from tarmac.session import input_bytes, size_shuffles
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.files.maxPartitionBytes"]
    old = {k: spark.conf.get(k) for k in keys}
    try:
        assert input_bytes(spark, "/root/testdata/sf0.001/events.parquet") > 0
        assert size_shuffles(spark, 100 * (1 << 40)) == 409_600  # 100 TB at 256 MB
        assert size_shuffles(spark, 10 << 30) == 40               # 10 GB / 256 MB
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
