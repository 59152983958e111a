"""DuckDB twins of the registered queries.

Each twin is plain SQL over the driver's views (``events`` ...). The flight
projection is a shared CTE; every query adds its own CTEs and final SELECT.
Aggregates are cast to the types the Spark side produces (DuckDB widens
integer sums to HUGEINT), and dates/timestamps are emitted as ISO text.
"""

from __future__ import annotations

FLIGHTS_RAW = """
flights_raw AS (
 SELECT event_id AS flight_id, ts,
  CASE WHEN event_id % 103 <> 0 THEN CAST(ts AS DATE) + CAST(event_id % 12 * 30 AS INTEGER) END AS FL_DATE,
  CASE WHEN event_id % 59 <> 0 THEN ['AA', 'DL', 'WN', 'UA', 'b6', 'ZZ'][k % 6 + 1] END AS OP_CARRIER,
  CASE WHEN event_id % 71 <> 0 THEN 'A' || CAST(user_id % 25 AS VARCHAR) END AS ORIGIN,
  'A' || CAST(k % 25 AS VARCHAR) AS DEST,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE hour(ts)*100 + minute(ts) END AS DEP_TIME,
  CASE WHEN event_id % 89 = 0 THEN NULL ELSE (v100 - 2000) / CAST(100 AS DOUBLE) END AS DEP_DELAY,
  CASE WHEN event_id % 53 = 0 THEN NULL
       WHEN event_id % 211 = 0 THEN (v100 * 40) / CAST(100 AS DOUBLE)
       ELSE ((v100 - 2000)*85 + (k - 50)*4000) / CAST(10000 AS DOUBLE) END AS ARR_DELAY,
  CAST((event_id*7919) % 6400 - 100 AS DOUBLE) AS DISTANCE,
  CASE WHEN event_id % 10 = 0 THEN CAST(k AS DOUBLE) END AS WEATHER_DELAY,
  CASE WHEN event_id % 8 = 0 THEN CAST(k AS DOUBLE) END AS CARRIER_DELAY,
  CASE WHEN event_id % 9 = 0 THEN CAST(k AS DOUBLE) END AS NAS_DELAY,
  CASE WHEN event_id % 101 = 0 THEN CAST(k AS DOUBLE) END AS SECURITY_DELAY,
  CASE WHEN event_id % 7 = 0 THEN CAST(k AS DOUBLE) END AS LATE_AIRCRAFT_DELAY
 FROM (SELECT *, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k,
              CAST(round(value*100) AS BIGINT) AS v100 FROM events) e
)"""

FLIGHTS_SCORED = """
flights_scored AS (
 SELECT flight_id, ts, OP_CARRIER, ORIGIN, DEST, DISTANCE,
  CASE WHEN ARR_DELAY > 15 THEN 1 ELSE 0 END AS label,
  round(1/(1+exp(-(coalesce(DEP_DELAY,0)-15)/20)),4) AS probability
 FROM flights_raw WHERE ARR_DELAY > -120 AND ARR_DELAY < 600
)"""

FLIGHTS_TEXT = """
flights_text AS (
 SELECT flight_id,
  CASE flight_id % 8 WHEN 0 THEN '1e3' WHEN 1 THEN ' 12 ' WHEN 2 THEN 'abc' WHEN 3 THEN ''
    WHEN 4 THEN 'NA' WHEN 5 THEN '12d' ELSE CAST(flight_id AS VARCHAR) END AS num_text,
  CASE WHEN flight_id % 6 = 0 THEN '2023-02-30'
    WHEN flight_id % 7 = 0 THEN month(FL_DATE) || '/' || day(FL_DATE) || '/' || year(FL_DATE) || ' 12:00:00 AM'
    WHEN flight_id % 7 = 1 THEN month(FL_DATE) || '/' || day(FL_DATE) || '/' || year(FL_DATE)
    WHEN flight_id % 7 = 2 THEN CAST(FL_DATE AS VARCHAR) || ' 00:00:00.0'
    WHEN flight_id % 7 = 3 THEN CAST(FL_DATE AS VARCHAR) || 'T00:00:00Z'
    WHEN flight_id % 7 = 4 THEN strftime(FL_DATE, '%Y%m%d')
    ELSE CAST(FL_DATE AS VARCHAR) END AS date_text,
  CASE WHEN flight_id % 6 <> 0 THEN FL_DATE END AS date_true
 FROM flights_raw
)"""

REQUESTS = """
requests AS (
 SELECT flight_id, ' ' || lower(OP_CARRIER) || ' ' AS airline, CASE WHEN flight_id % 37 = 0 THEN 'xq1' ELSE lower(ORIGIN) END AS origin,
  CASE WHEN flight_id % 39 = 0 THEN 'xq2' ELSE lower(DEST) END AS destination,
  CASE WHEN flight_id % 5 = 0 THEN NULL WHEN flight_id % 47 = 0 THEN CAST('nan' AS DOUBLE) ELSE DEP_DELAY END AS departure_delay,
  CASE WHEN flight_id % 41 = 0 THEN CAST('nan' AS DOUBLE) WHEN flight_id % 43 = 0 THEN NULL ELSE DISTANCE END AS distance,
  CAST(1 + flight_id % 9 AS INTEGER) AS day_of_week, CAST(1 + flight_id % 14 AS INTEGER) AS month,
  CAST(flight_id % 26 AS INTEGER) AS hour
 FROM flights_raw
)"""

# cleaned flights (rules of the cleaning operators, written out)
FLIGHTS_CLEAN = """
flights_clean AS (
 SELECT flight_id, ts, FL_DATE, OP_CARRIER, ORIGIN, DEST,
  CAST(DEP_TIME AS DOUBLE) AS DEP_TIME, coalesce(DEP_DELAY, 0.0) AS DEP_DELAY, ARR_DELAY, DISTANCE,
  coalesce(WEATHER_DELAY, 0.0) AS WEATHER_DELAY, coalesce(CARRIER_DELAY, 0.0) AS CARRIER_DELAY,
  coalesce(NAS_DELAY, 0.0) AS NAS_DELAY, coalesce(SECURITY_DELAY, 0.0) AS SECURITY_DELAY,
  coalesce(LATE_AIRCRAFT_DELAY, 0.0) AS LATE_AIRCRAFT_DELAY,
  CAST(ARR_DELAY > 15 AS INTEGER) AS is_delayed,
  CAST(month(FL_DATE) AS INTEGER) AS MONTH,
  CAST(isodow(FL_DATE) AS INTEGER) AS DAY_OF_WEEK,
  CAST(CASE WHEN DEP_TIME IS NULL OR isinf(CAST(DEP_TIME AS DOUBLE)) THEN 12
       ELSE least(greatest(floor(DEP_TIME / 100.0), 0), 23) END AS INTEGER) AS HOUR
 FROM flights_raw
 WHERE ARR_DELAY IS NOT NULL AND ARR_DELAY > -120 AND ARR_DELAY < 600
)"""

# engineered features on the cleaned flights
FLIGHTS_FEATURES = """
flights_features AS (
 SELECT *,
  CAST(CASE WHEN DISTANCE > 0 AND DISTANCE <= 250 THEN 0
       WHEN DISTANCE > 250 AND DISTANCE <= 500 THEN 1
       WHEN DISTANCE > 500 AND DISTANCE <= 1000 THEN 2
       WHEN DISTANCE > 1000 AND DISTANCE <= 1500 THEN 3
       WHEN DISTANCE > 1500 AND DISTANCE <= 2000 THEN 4
       WHEN DISTANCE > 2000 AND DISTANCE <= 6000 THEN 5
       ELSE 2 END AS INTEGER) AS DIST_BUCKET,
  CAST(coalesce(DAY_OF_WEEK IN (6, 7), false) AS INTEGER) AS IS_WEEKEND,
  CAST(coalesce(HOUR BETWEEN 6 AND 9 OR HOUR BETWEEN 16 AND 20, false) AS INTEGER) AS IS_PEAK_HOUR,
  CAST(CASE WHEN MONTH IN (12, 1, 2) THEN 0 WHEN MONTH IN (3, 4, 5) THEN 1
       WHEN MONTH IN (6, 7, 8) THEN 2 WHEN MONTH IN (9, 10, 11) THEN 3 ELSE 0 END AS INTEGER) AS SEASON
 FROM flights_clean
)"""

# encoder dictionary: per column, distinct text values in code-point order
ENCODER_DICTIONARY = """
encoder_dictionary AS (
 SELECT column_name, value, CAST(row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS INTEGER) AS code
 FROM (SELECT DISTINCT 'OP_CARRIER' AS column_name, coalesce(OP_CARRIER, 'nan') AS value FROM flights_features
       UNION SELECT DISTINCT 'ORIGIN', coalesce(ORIGIN, 'nan') FROM flights_features
       UNION SELECT DISTINCT 'DEST', coalesce(DEST, 'nan') FROM flights_features) d
)"""

FLIGHTS_ENCODED = """
flights_encoded AS (
 SELECT f.*,
  coalesce(a.code, 0) AS AIRLINE_ENC, coalesce(o.code, 0) AS ORIGIN_ENC, coalesce(d.code, 0) AS DEST_ENC
 FROM flights_features f
 LEFT JOIN (SELECT value, code FROM encoder_dictionary WHERE column_name = 'OP_CARRIER') a
   ON coalesce(f.OP_CARRIER, 'nan') = a.value
 LEFT JOIN (SELECT value, code FROM encoder_dictionary WHERE column_name = 'ORIGIN') o
   ON coalesce(f.ORIGIN, 'nan') = o.value
 LEFT JOIN (SELECT value, code FROM encoder_dictionary WHERE column_name = 'DEST') d
   ON coalesce(f.DEST, 'nan') = d.value
)"""

INFERENCE_LOG = """
inference_log AS (
 SELECT flight_id, ts AS "timestamp", OP_CARRIER AS airline, ORIGIN AS origin, DEST AS destination,
  DISTANCE AS distance,
  CASE WHEN flight_id % 61 = 0 THEN NULL WHEN probability >= 0.5 THEN 'Delayed'
       WHEN probability IS NOT NULL THEN 'On Time' END AS prediction,
  probability
 FROM flights_scored
)"""

_ORDER = [("flights_raw", FLIGHTS_RAW), ("flights_scored", FLIGHTS_SCORED),
          ("flights_text", FLIGHTS_TEXT), ("requests", REQUESTS),
          ("flights_clean", FLIGHTS_CLEAN), ("flights_features", FLIGHTS_FEATURES),
          ("encoder_dictionary", ENCODER_DICTIONARY), ("flights_encoded", FLIGHTS_ENCODED),
          ("inference_log", INFERENCE_LOG)]
_DEPS = {
    "flights_raw": [], "flights_scored": ["flights_raw"], "flights_text": ["flights_raw"],
    "requests": ["flights_raw"], "flights_clean": ["flights_raw"],
    "flights_features": ["flights_clean"], "encoder_dictionary": ["flights_features"],
    "flights_encoded": ["encoder_dictionary", "flights_features"],
    "inference_log": ["flights_scored"],
}


def with_ctes(uses: list[str], body: str, extra: list[str] | None = None) -> str:
    """Prefix ``body`` with the shared CTEs it uses (and their dependencies),
    followed by ``extra`` CTE definitions."""
    need: set[str] = set()

    def add(n):
        if n not in need:
            need.add(n)
            for d in _DEPS[n]:
                add(d)

    for u in uses:
        add(u)
    parts = [sql for name, sql in _ORDER if name in need]
    parts += [e for e in (extra or [])]
    if not parts:
        return body
    return "WITH " + ",".join(p.strip() if i else p.lstrip() for i, p in enumerate(parts)) + "\n" + body
