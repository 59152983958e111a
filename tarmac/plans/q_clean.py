"""Registered queries: coercion and cleaning (P2-P12, A1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions.coerce import to_date, to_double
from tarmac.operators import clean as C
from tarmac.plans.oracle import with_ctes
from tarmac.plans.registry import register
from tarmac.sources import tables


def _clean(spark, sf):
    return C.clean(tables.flights_raw(spark, sf))


# ---------------------------------------------------------------- coercion
_NUM_RE = r"\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*"


@register("coerce_numeric", operators=("P3",), oracle=with_ctes(["flights_text"], f"""
SELECT flight_id, num_text,
 CASE WHEN num_text IN ('', 'NA', 'N/A', 'NULL', 'NaN', 'nan', 'None', 'null', 'n/a', '<NA>') THEN NULL
      WHEN regexp_full_match(num_text, '{_NUM_RE}') THEN
        CASE WHEN isnan(TRY_CAST(trim(num_text) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(num_text) AS DOUBLE) END
 END AS num_value
FROM flights_text"""))
def coerce_numeric(spark, sf):
    t = tables.flights_text(spark, sf)
    return t.select("flight_id", "num_text",
                    to_double(F.col("num_text"), t.schema["num_text"].dataType).alias("num_value"))


@register("coerce_date", operators=("P2",), oracle=with_ctes(["flights_text"], """
SELECT flight_id, date_text,
 CAST(date_true AS VARCHAR) AS date_value, CAST(month(date_true) AS INTEGER) AS month_value
FROM flights_text"""))
def coerce_date(spark, sf):
    t = tables.flights_text(spark, sf)
    d = to_date(F.col("date_text"), t.schema["date_text"].dataType)
    return t.select("flight_id", "date_text", d.cast("string").alias("date_value"),
                    F.month(d).cast("int").alias("month_value"))


# ---------------------------------------------------------------- cleaning
_CLEAN_COLS = ["flight_id", "OP_CARRIER", "ORIGIN", "DEST", "DEP_TIME", "DEP_DELAY",
               "ARR_DELAY", "DISTANCE", "WEATHER_DELAY", "CARRIER_DELAY", "NAS_DELAY",
               "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY", "is_delayed", "MONTH",
               "DAY_OF_WEEK", "HOUR"]


@register("clean_flights", operators=("P1", "P2", "P3", "P4", "P5", "P6", "P7", "P8", "P9", "P10"),
          oracle=with_ctes(["flights_clean"], f"""
SELECT CAST(FL_DATE AS VARCHAR) AS FL_DATE, {', '.join(_CLEAN_COLS)} FROM flights_clean"""))
def clean_flights(spark, sf):
    df = _clean(spark, sf)
    return df.select(F.col("FL_DATE").cast("string").alias("FL_DATE"), *_CLEAN_COLS)


@register("delay_fill", operators=("P6", "P7"), oracle=with_ctes(["flights_clean"], """
SELECT flight_id, DEP_DELAY, WEATHER_DELAY, CARRIER_DELAY, NAS_DELAY, SECURITY_DELAY,
 LATE_AIRCRAFT_DELAY FROM flights_clean"""))
def delay_fill(spark, sf):
    return _clean(spark, sf).select("flight_id", "DEP_DELAY", "WEATHER_DELAY", "CARRIER_DELAY",
                                    "NAS_DELAY", "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY")


@register("hour_month_weekday", operators=("P9", "P10"), oracle=with_ctes(["flights_clean"], """
SELECT flight_id, DEP_TIME, HOUR, MONTH, DAY_OF_WEEK, is_delayed FROM flights_clean"""))
def hour_month_weekday(spark, sf):
    return _clean(spark, sf).select("flight_id", "DEP_TIME", "HOUR", "MONTH", "DAY_OF_WEEK",
                                    "is_delayed")


@register("cleaning_report", operators=("P11",), oracle=with_ctes(["flights_raw"], """
SELECT rows_in, rows_with_target, rows_kept, rows_in - rows_kept AS rows_removed,
 (rows_in - rows_kept) / CAST(rows_in AS DOUBLE) AS removed_share,
 delayed_kept / CAST(rows_kept AS DOUBLE) AS delay_rate
FROM (SELECT count(*) AS rows_in, count(ARR_DELAY) AS rows_with_target,
        count(*) FILTER (WHERE ARR_DELAY > -120 AND ARR_DELAY < 600) AS rows_kept,
        count(*) FILTER (WHERE ARR_DELAY > -120 AND ARR_DELAY < 600 AND ARR_DELAY > 15) AS delayed_kept
      FROM flights_raw) t"""))
def cleaning_report(spark, sf):
    return C.cleaning_report(tables.flights_raw(spark, sf))


@register("validate_flights", operators=("P12",), oracle=with_ctes(["flights_clean"], """
SELECT (count(*) > 0 AND count(DISTINCT is_delayed) >= 2) AS ok,
 CASE WHEN count(*) = 0 THEN 'DataFrame is empty after cleaning'
      WHEN count(DISTINCT is_delayed) < 2 THEN 'Target column has only one class — check data'
      ELSE 'Validation passed' END AS message
FROM flights_clean"""))
def validate_flights(spark, sf):
    return C.validate(_clean(spark, sf))


@register("data_summary", operators=("A1",), oracle=with_ctes(["flights_clean"], """
SELECT count(*) AS total_flights, CAST(coalesce(sum(is_delayed), 0) AS BIGINT) AS delayed_flights,
 avg(is_delayed) AS delay_rate, round(avg(ARR_DELAY), 6) AS avg_arr_delay,
 CAST(count(DISTINCT OP_CARRIER) AS BIGINT) AS airlines,
 CAST(count(DISTINCT ORIGIN || '-' || DEST) AS BIGINT) AS routes
FROM flights_clean"""))
def data_summary(spark, sf):
    s = C.data_summary(_clean(spark, sf))
    return s.withColumn("avg_arr_delay", F.round("avg_arr_delay", 6))
