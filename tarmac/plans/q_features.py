"""Registered queries: features, dictionary encoding, lookups and text
helpers (F1-F13, P13-P18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import scalar as S
from tarmac.operators import clean as C
from tarmac.operators import features as FE
from tarmac.operators.lookup import with_carrier_name
from tarmac.operators.requests import validate_requests
from tarmac.plans.oracle import with_ctes
from tarmac.plans.registry import register
from tarmac.schema import ALL_FEATURES, CARRIER_NAMES, DAY_NAMES, MONTH_NAMES
from tarmac.sources import tables


def _engineered(spark, sf):
    return FE.engineer(C.clean(tables.flights_raw(spark, sf)))


def _encoded(spark, sf):
    enc, d = FE.build_features(C.clean(tables.flights_raw(spark, sf)))
    return enc, d


def _values_sql(rows, cols):
    vals = ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
                                     for v in r) + ")" for r in rows)
    return f"(VALUES {vals}) AS t({', '.join(cols)})"


CARRIER_VALUES = _values_sql(CARRIER_NAMES, ["carrier_code", "carrier_name"])
DAY_VALUES = _values_sql(list(enumerate(DAY_NAMES, 1)), ["num", "name"])
MONTH_VALUES = _values_sql(list(enumerate(MONTH_NAMES, 1)), ["num", "name"])


@register("distance_bucket", operators=("F1",), oracle=with_ctes(["flights_features"], """
SELECT flight_id, DISTANCE, DIST_BUCKET FROM flights_features"""))
def distance_bucket(spark, sf):
    return _engineered(spark, sf).select("flight_id", "DISTANCE", "DIST_BUCKET")


@register("calendar_flags", operators=("F2", "F3", "F4", "F5"), oracle=with_ctes(["flights_features"], """
SELECT flight_id, DAY_OF_WEEK, HOUR, MONTH, IS_WEEKEND, IS_PEAK_HOUR, SEASON, DEP_DELAY
FROM flights_features"""))
def calendar_flags(spark, sf):
    return _engineered(spark, sf).select("flight_id", "DAY_OF_WEEK", "HOUR", "MONTH", "IS_WEEKEND",
                                         "IS_PEAK_HOUR", "SEASON", "DEP_DELAY")


@register("encoder_dictionary", operators=("F6", "F8", "S9"), oracle=with_ctes(["encoder_dictionary"], """
SELECT column_name, value, code FROM encoder_dictionary"""))
def encoder_dictionary(spark, sf):
    return FE.fit_dictionary(_engineered(spark, sf)).table


@register("encode_transform", operators=("F7",), oracle=with_ctes(["flights_encoded"], """
SELECT flight_id, OP_CARRIER, ORIGIN, DEST, AIRLINE_ENC, ORIGIN_ENC, DEST_ENC FROM flights_encoded"""))
def encode_transform(spark, sf):
    enc, _ = _encoded(spark, sf)
    return enc.select("flight_id", "OP_CARRIER", "ORIGIN", "DEST", "AIRLINE_ENC", "ORIGIN_ENC", "DEST_ENC")


_REQ_VALID = """
req_valid AS (
 SELECT flight_id, upper(trim(airline)) AS airline, upper(trim(origin)) AS origin,
  upper(trim(destination)) AS destination,
  CASE WHEN isnan(departure_delay) THEN 0.0 ELSE coalesce(departure_delay, 0.0) END AS departure_delay,
  CASE WHEN NOT isnan(distance) THEN distance END AS distance, day_of_week, month, coalesce(hour, 12) AS hour,
  concat_ws(';',
   CASE WHEN airline IS NULL THEN 'airline: missing' END,
   CASE WHEN origin IS NULL THEN 'origin: missing' END,
   CASE WHEN destination IS NULL THEN 'destination: missing' END,
   CASE WHEN distance IS NULL THEN 'distance: missing' WHEN isnan(distance) THEN 'distance: not a number' END,
   CASE WHEN day_of_week IS NULL THEN 'day_of_week: missing'
        WHEN day_of_week NOT BETWEEN 1 AND 7 THEN 'day_of_week: out of range' END,
   CASE WHEN month IS NULL THEN 'month: missing'
        WHEN month NOT BETWEEN 1 AND 12 THEN 'month: out of range' END,
   CASE WHEN hour IS NOT NULL AND hour NOT BETWEEN 0 AND 23 THEN 'hour: out of range' END,
   CASE WHEN isnan(departure_delay) THEN 'departure_delay: not a number' END
  ) AS reject_reason
 FROM requests
)"""


@register("request_validate", operators=("P13",), oracle=with_ctes(["requests"], """
SELECT *, reject_reason = '' AS is_valid FROM req_valid""", [_REQ_VALID]))
def request_validate(spark, sf):
    return validate_requests(tables.requests(spark, sf))


_REQ_FEATURES = """
req_features AS (
 SELECT r.flight_id, r.departure_delay AS DEP_DELAY, r.distance AS DISTANCE, r.hour AS HOUR,
  r.day_of_week AS DAY_OF_WEEK, r.month AS MONTH,
  CAST(CASE WHEN distance > 0 AND distance <= 250 THEN 0 WHEN distance > 250 AND distance <= 500 THEN 1
       WHEN distance > 500 AND distance <= 1000 THEN 2 WHEN distance > 1000 AND distance <= 1500 THEN 3
       WHEN distance > 1500 AND distance <= 2000 THEN 4 WHEN distance > 2000 AND distance <= 6000 THEN 5
       ELSE 2 END AS INTEGER) AS DIST_BUCKET,
  CAST(day_of_week IN (6, 7) AS INTEGER) AS IS_WEEKEND,
  CAST(hour BETWEEN 6 AND 9 OR hour BETWEEN 16 AND 20 AS INTEGER) AS IS_PEAK_HOUR,
  CAST(CASE WHEN month IN (12, 1, 2) THEN 0 WHEN month IN (3, 4, 5) THEN 1
       WHEN month IN (6, 7, 8) THEN 2 WHEN month IN (9, 10, 11) THEN 3 ELSE 0 END AS INTEGER) AS SEASON,
  coalesce(a.code, 0) AS AIRLINE_ENC, coalesce(o.code, 0) AS ORIGIN_ENC, coalesce(d.code, 0) AS DEST_ENC
 FROM req_valid r
 LEFT JOIN (SELECT value, code FROM encoder_dictionary WHERE column_name = 'OP_CARRIER') a ON r.airline = a.value
 LEFT JOIN (SELECT value, code FROM encoder_dictionary WHERE column_name = 'ORIGIN') o ON r.origin = o.value
 LEFT JOIN (SELECT value, code FROM encoder_dictionary WHERE column_name = 'DEST') d ON r.destination = d.value
 WHERE r.reject_reason = ''
)"""


def _request_features(spark, sf):
    _, d = _encoded(spark, sf)
    req = validate_requests(tables.requests(spark, sf)).where("is_valid")
    return FE.score_features(req, d)


@register("encode_unseen", operators=("F7", "F13"), oracle=with_ctes(["requests", "encoder_dictionary"], """
SELECT flight_id, AIRLINE_ENC, ORIGIN_ENC, DEST_ENC FROM req_features""", [_REQ_VALID, _REQ_FEATURES]))
def encode_unseen(spark, sf):
    return _request_features(spark, sf).select("flight_id", "AIRLINE_ENC", "ORIGIN_ENC", "DEST_ENC")


@register("score_features", operators=("F13", "F9"), oracle=with_ctes(["requests", "encoder_dictionary"], f"""
SELECT flight_id, {', '.join(ALL_FEATURES)} FROM req_features""", [_REQ_VALID, _REQ_FEATURES]))
def score_features(spark, sf):
    return FE.feature_columns(_request_features(spark, sf), keep=["flight_id"])


@register("vocabulary", operators=("F11",), oracle=with_ctes(["encoder_dictionary"], """
SELECT CASE WHEN column_name = 'OP_CARRIER' THEN 'airline' ELSE 'airport' END AS kind, value
FROM encoder_dictionary WHERE column_name IN ('OP_CARRIER', 'ORIGIN')"""))
def vocabulary(spark, sf):
    _, d = _encoded(spark, sf)
    return FE.vocabulary(spark, d)


@register("feature_matrix", operators=("F9", "F10", "F12"), oracle=with_ctes(["flights_encoded"], f"""
SELECT flight_id, is_delayed, {', '.join(ALL_FEATURES)} FROM flights_encoded
WHERE MONTH IS NOT NULL AND DAY_OF_WEEK IS NOT NULL"""))
def feature_matrix(spark, sf):
    enc, _ = _encoded(spark, sf)
    return FE.feature_columns(enc, keep=["flight_id", "is_delayed"]).where(FE.complete_rows_expr())


@register("feature_stats", operators=("F10",), oracle=with_ctes(["flights_encoded"], """
SELECT count(*) FILTER (WHERE known) AS n_rows, 12 AS n_features, avg(is_delayed) FILTER (WHERE known) AS positive_rate,
 count(*) FILTER (WHERE NOT known) AS rejected_rows
FROM (SELECT *, MONTH IS NOT NULL AND DAY_OF_WEEK IS NOT NULL AS known FROM flights_encoded) e"""))
def feature_stats(spark, sf):
    enc, _ = _encoded(spark, sf)
    return FE.feature_stats(FE.feature_columns(enc, keep=["is_delayed"]))


# ---------------------------------------------------------------- lookups, text
@register("carrier_lookup", operators=("P14",), oracle=with_ctes(["flights_clean"], f"""
SELECT f.flight_id, f.OP_CARRIER, coalesce(t.carrier_name, f.OP_CARRIER) AS carrier_name,
 coalesce(t2.carrier_name, upper(f.OP_CARRIER)) AS carrier_name_upper
FROM flights_clean f LEFT JOIN {CARRIER_VALUES} ON f.OP_CARRIER = t.carrier_code
LEFT JOIN (SELECT * FROM {CARRIER_VALUES}) t2 ON upper(f.OP_CARRIER) = t2.carrier_code"""))
def carrier_lookup(spark, sf):
    df = C.clean(tables.flights_raw(spark, sf)).select("flight_id", "OP_CARRIER")
    df = with_carrier_name(df)
    df = df.withColumn("_up", F.upper("OP_CARRIER"))
    df = with_carrier_name(df, "_up", "carrier_name_upper").drop("_up")
    return df


@register("day_month_names", operators=("P15",), oracle=with_ctes(["flights_clean"], f"""
SELECT f.flight_id, f.DAY_OF_WEEK, f.MONTH, d.name AS day_name, m.name AS month_name,
 CAST(d.num AS INTEGER) AS day_back, CAST(m.num AS INTEGER) AS month_back
FROM flights_clean f LEFT JOIN {DAY_VALUES.replace(' AS t(', ' AS d(')} ON f.DAY_OF_WEEK = d.num
LEFT JOIN {MONTH_VALUES.replace(' AS t(', ' AS m(')} ON f.MONTH = m.num"""))
def day_month_names(spark, sf):
    df = C.clean(tables.flights_raw(spark, sf))
    named = df.select("flight_id", "DAY_OF_WEEK", "MONTH", S.day_name(F.col("DAY_OF_WEEK")).alias("day_name"),
                      S.month_name(F.col("MONTH")).alias("month_name"))
    return named.withColumns({"day_back": S.day_number(F.col("day_name")).cast("int"),
                              "month_back": S.month_number(F.col("month_name")).cast("int")})


@register("route_text", operators=("P16",), oracle=with_ctes(["flights_clean"], """
SELECT flight_id, ORIGIN || '→' || DEST AS route, ORIGIN || '-' || DEST AS route_key FROM flights_clean"""))
def route_text(spark, sf):
    df = C.clean(tables.flights_raw(spark, sf))
    return df.select("flight_id", S.route(F.col("ORIGIN"), F.col("DEST")).alias("route"),
                     S.route(F.col("ORIGIN"), F.col("DEST"), "-").alias("route_key"))


@register("percent_text", operators=("P17",), oracle=with_ctes(["flights_scored"], """
SELECT flight_id, probability, pct, CAST(replace(pct, '%', '') AS DOUBLE) / 100 AS pct_back
FROM (SELECT flight_id, probability,
        printf('%.1f%%', round(CAST(CAST(probability * 100 AS VARCHAR) AS DECIMAL(38, 17)), 1)) AS pct
      FROM flights_scored) t"""))
def percent_text(spark, sf):
    df = tables.flights_scored(spark, sf).select("flight_id", "probability")
    df = df.withColumn("pct", S.percent_text(F.col("probability")))
    return df.withColumn("pct_back", S.percent_value(F.col("pct")))


@register("airline_from_label", operators=("P18",), oracle=with_ctes(["flights_clean"], f"""
SELECT f.flight_id, f.OP_CARRIER || ' — ' || coalesce(t.carrier_name, f.OP_CARRIER) AS label,
 trim(split_part(f.OP_CARRIER || ' — ' || coalesce(t.carrier_name, f.OP_CARRIER), ' — ', 1)) AS airline_code
FROM flights_clean f LEFT JOIN {CARRIER_VALUES} ON f.OP_CARRIER = t.carrier_code"""))
def airline_from_label(spark, sf):
    df = with_carrier_name(C.clean(tables.flights_raw(spark, sf)).select("flight_id", "OP_CARRIER"))
    lab = F.concat(F.col("OP_CARRIER"), F.lit(" — "), F.col("carrier_name"))
    return df.select("flight_id", lab.alias("label"), S.airline_code_from_label(lab).alias("airline_code"))
