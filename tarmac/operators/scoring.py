"""Scoring: decision, bands, response assembly, inference ids, log rows and
batch scoring. One pass per table; no per-row Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.bands import confidence, decision, risk_advice, risk_level
from tarmac.functions.scalar import percent_text, route
from tarmac.operators.features import Dictionary, feature_columns, score_features
from tarmac.operators.ranking import global_row_number
from tarmac.schema import DELAYED, ON_TIME

ID_FORMAT = "INF-%06d"


def with_bands(df: DataFrame, prob_col: str = "probability") -> DataFrame:
    """prediction (>= .5), risk level (scheme A), scheme B with advice,
    two-way risk, confidence."""
    p = F.col(prob_col)
    return df.withColumns({
        "prediction": decision(p),
        "risk_level": risk_level(p, "A"),
        "risk_level_b": risk_level(p, "B"),
        "risk_two_way": risk_level(p, "two-way"),
        "confidence": confidence(p),
    }).withColumn("risk_advice", risk_advice(F.col("risk_level_b")))


def inference_ids(df: DataFrame, ts_col: str, key_col: str, start: int = 1,
                  out_col: str = "inference_id") -> DataFrame:
    """Running ids ``INF-000001``... in (timestamp, key) order from ``start``."""
    key = F.unix_micros(F.col(ts_col).cast("timestamp"))
    ranked = global_row_number(df, key, F.col(key_col), "_seq", start=start)
    return ranked.withColumn(out_col, F.format_string(ID_FORMAT, F.col("_seq"))).drop("_seq")


def respond(df: DataFrame, prob_col: str, model_name: str, timestamp: str | Column,
            ts_col: str | None = None, key_col: str | None = None, id_start: int = 1,
            risk_scheme: str = "A") -> DataFrame:
    """Response rows: prediction, delay_probability (4 places), confidence,
    risk_level, model_name, inference_id, timestamp. The timestamp is an
    argument so runs are repeatable."""
    p = F.col(prob_col)
    out = df.withColumns({
        "prediction": decision(p),
        "delay_probability": F.round(p, 4),
        "confidence": confidence(p),
        "risk_level": risk_level(p, risk_scheme),
        "model_name": F.lit(model_name),
        "response_ts": timestamp if isinstance(timestamp, Column) else F.lit(timestamp),
    })
    if ts_col and key_col:
        out = inference_ids(out, ts_col, key_col, id_start)
    return out


def log_rows(resp: DataFrame, ts_col: str = "response_ts", keep=()) -> DataFrame:
    """Response -> inference-log row (the values, not empty columns)."""
    return resp.select(
        *keep, F.col(ts_col).alias("timestamp"), F.col("OP_CARRIER").alias("airline"),
        F.col("ORIGIN").alias("origin"), F.col("DEST").alias("destination"),
        F.col("DISTANCE").alias("distance"), "prediction",
        F.col("delay_probability").alias("probability"))


def batch_score(valid_requests: DataFrame, dictionary: Dictionary | None, model=None,
                rule=None, keep=("flight_id",), risk_scheme: str = "A", percent: bool = False) -> DataFrame:
    """Validated request rows in -> airline, route, prediction, probability,
    risk; one output row per input row. ``model`` is a fitted PipelineModel;
    ``rule`` a Column function of the feature row (model-free score);
    ``risk_scheme`` is A, B or two-way; ``percent`` writes the probability as
    percent text."""
    feats = score_features(valid_requests, dictionary)
    if model is not None:
        from tarmac.operators.learn import score
        cols = feature_columns(feats, keep=[k for k in keep] + ["OP_CARRIER", "ORIGIN", "DEST"])
        scored = score(model, cols)
    else:
        scored = feats.withColumn("probability", rule(feats))
    p = F.col("probability")
    return scored.select(
        *keep,
        F.col("OP_CARRIER").alias("airline"),
        route(F.col("ORIGIN"), F.col("DEST")).alias("route"),
        decision(p).alias("prediction"),
        (percent_text(p) if percent else F.round(p, 4)).alias("delay_probability"),
        risk_level(p, risk_scheme).alias("risk_level"),
    )


def batch_counts(scored: DataFrame) -> DataFrame:
    """Total, delayed, on time (one aggregation)."""
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("prediction") == DELAYED, 1)).alias("delayed"),
        F.count(F.when(F.col("prediction") == ON_TIME, 1)).alias("on_time"),
    )
