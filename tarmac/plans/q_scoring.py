"""Registered queries: decisions, bands, responses, ids, batch scoring and
the log projection (I1-I9, A6), on the rule-scored flights and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import scoring as SC
from tarmac.operators.features import fit_dictionary, engineer
from tarmac.operators.clean import clean
from tarmac.operators.requests import validate_requests
from tarmac.plans.oracle import with_ctes
from tarmac.plans.q_features import _REQ_VALID
from tarmac.plans.registry import register
from tarmac.sources import tables

RESPONSE_TS = "2024-01-31T00:00:00"

_BANDS_SQL = """
 CASE WHEN probability >= 0.5 THEN 'Delayed' WHEN probability IS NOT NULL THEN 'On Time' END AS prediction,
 CASE WHEN probability < 0.3 THEN 'LOW' WHEN probability < 0.5 THEN 'MODERATE'
      WHEN probability < 0.7 THEN 'HIGH' WHEN probability IS NOT NULL THEN 'VERY HIGH' END AS risk_level"""

_CONF_SQL = """
 CASE WHEN abs(probability - 0.5) > 0.35 THEN 'HIGH' WHEN abs(probability - 0.5) > 0.2 THEN 'MEDIUM'
      WHEN probability IS NOT NULL THEN 'LOW' END AS confidence"""


@register("decision_risk_confidence", operators=("I1", "I2", "I3", "I4", "I5"),
          oracle=with_ctes(["flights_scored"], f"""
SELECT flight_id, probability, {_BANDS_SQL}, {_CONF_SQL},
 CASE WHEN probability < 0.25 THEN 'LOW RISK' WHEN probability < 0.45 THEN 'MODERATE RISK'
      WHEN probability < 0.65 THEN 'HIGH RISK' WHEN probability IS NOT NULL THEN 'VERY HIGH RISK' END AS risk_level_b,
 CASE WHEN probability < 0.25 THEN 'This flight has a low probability of delay.'
      WHEN probability < 0.45 THEN 'Some chance of delay. Monitor flight status.'
      WHEN probability < 0.65 THEN 'Significant chance of delay. Allow buffer time.'
      WHEN probability IS NOT NULL THEN 'Very likely to be delayed. Plan accordingly.' END AS risk_advice,
 CASE WHEN probability >= 0.5 THEN 'HIGH' WHEN probability IS NOT NULL THEN 'LOW' END AS risk_two_way
FROM flights_scored"""))
def decision_risk_confidence(spark, sf):
    s = tables.flights_scored(spark, sf).select("flight_id", "probability")
    return SC.with_bands(s)


@register("inference_ids", operators=("I7",), oracle=with_ctes(["flights_scored"], """
SELECT flight_id, CAST(ts AS VARCHAR) AS ts,
 printf('INF-%06d', row_number() OVER (ORDER BY ts, flight_id)) AS inference_id
FROM flights_scored"""))
def inference_ids(spark, sf):
    s = tables.flights_scored(spark, sf).select("flight_id", "ts")
    return SC.inference_ids(s, "ts", "flight_id", start=1).select(
        "flight_id", F.col("ts").cast("string").alias("ts"), "inference_id")


@register("respond", operators=("I6", "I7"), oracle=with_ctes(["flights_scored"], f"""
SELECT flight_id, {_BANDS_SQL}, {_CONF_SQL}, round(probability, 4) AS delay_probability,
 'rule' AS model_name, printf('INF-%06d', row_number() OVER (ORDER BY ts, flight_id)) AS inference_id,
 '{RESPONSE_TS}' AS "timestamp"
FROM flights_scored"""))
def respond(spark, sf):
    s = tables.flights_scored(spark, sf).select("flight_id", "ts", "probability")
    r = SC.respond(s, "probability", "rule", RESPONSE_TS, ts_col="ts", key_col="flight_id")
    return r.select("flight_id", "prediction", "risk_level", "confidence", "delay_probability",
                    "model_name", "inference_id", F.col("response_ts").alias("timestamp"))


@register("log_projection", operators=("I9", "S5"), oracle=with_ctes(["flights_scored"], """
SELECT flight_id, CAST(ts AS VARCHAR) AS "timestamp", OP_CARRIER AS airline, ORIGIN AS origin,
 DEST AS destination, DISTANCE AS distance,
 CASE WHEN probability >= 0.5 THEN 'Delayed' WHEN probability IS NOT NULL THEN 'On Time' END AS prediction,
 round(probability, 4) AS probability
FROM flights_scored"""))
def log_projection(spark, sf):
    s = tables.flights_scored(spark, sf)
    r = SC.respond(s, "probability", "rule", F.col("ts").cast("string"))
    return SC.log_rows(r, keep=["flight_id"])


def _rule(feats):
    return tables.rule_probability(F.col("DEP_DELAY"))


def _batch(spark, sf):
    d = fit_dictionary(engineer(clean(tables.flights_raw(spark, sf))))
    req = validate_requests(tables.requests(spark, sf)).where("is_valid")
    return SC.batch_score(req, d, rule=_rule)


_BATCH_SQL = """
batch AS (
 SELECT flight_id, airline, origin || '→' || destination AS route,
  CASE WHEN p >= 0.5 THEN 'Delayed' ELSE 'On Time' END AS prediction, round(p, 4) AS delay_probability,
  CASE WHEN p < 0.3 THEN 'LOW' WHEN p < 0.5 THEN 'MODERATE' WHEN p < 0.7 THEN 'HIGH' ELSE 'VERY HIGH' END AS risk_level
 FROM (SELECT *, round(1/(1+exp(-(coalesce(departure_delay, 0)-15)/20)),4) AS p FROM req_valid
       WHERE reject_reason = '') v
)"""


@register("batch_score_rule", operators=("I8", "F13", "P13"), oracle=with_ctes(["requests"], """
SELECT * FROM batch""", [_REQ_VALID, _BATCH_SQL]))
def batch_score_rule(spark, sf):
    return _batch(spark, sf)


@register("batch_counts", operators=("A6",), oracle=with_ctes(["requests"], """
SELECT count(*) AS total, count(*) FILTER (WHERE prediction = 'Delayed') AS delayed,
 count(*) FILTER (WHERE prediction = 'On Time') AS on_time FROM batch""", [_REQ_VALID, _BATCH_SQL]))
def batch_counts(spark, sf):
    return SC.batch_counts(_batch(spark, sf))
