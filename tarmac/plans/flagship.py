"""The flagship plan: flights -> clean -> features + dictionary -> logistic
model -> scored requests -> counts per risk band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import learn as L
from tarmac.operators import scoring as SC
from tarmac.operators.requests import validate_requests
from tarmac.plans.q_learn import labelled_features
from tarmac.sources import tables


def risk_band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf, d = labelled_features(spark, sf_dir)
    res = L.train_all(spark, tf, L.Presets(), models=["LogisticRegression"], evaluate=False)
    req = validate_requests(tables.requests(spark, sf_dir)).where("is_valid")
    scored = SC.batch_score(req, d, model=res.models["LogisticRegression"])
    return scored.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("flights"),
        F.round(F.avg("delay_probability"), 4).alias("avg_probability"))
