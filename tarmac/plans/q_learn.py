"""Registered queries backed by Spark ML: training and selection, stored runs,
scaler, importance, model scoring and full evaluation (M2-M7, M13-M17, A7, I8).

Long fits are beyond SQL, so the twins check numbers that the data alone
decide: the split and its sizes, the scaler's parameters, the log-odds and
loss of the empty model, the root splits of the first tree, and the scores,
importances and evaluation of a boosted model of one tree with one split,
which goes through the same training, storage and scoring as the full ones.
The tests hold the full models against direct solves and hand-walked trees."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tarmac.operators import boosting as B
from tarmac.operators import clean as C
from tarmac.operators import features as FE
from tarmac.operators import learn as L
from tarmac.operators import runs as R
from tarmac.operators import scoring as SC
from tarmac.operators.metrics import full_evaluation
from tarmac.operators.requests import validate_requests
from tarmac.plans import pipelines as P
from tarmac.plans.oracle import with_ctes
from tarmac.plans.q_features import _REQ_FEATURES, _REQ_VALID
from tarmac.plans.registry import register
from tarmac.schema import ALL_FEATURES
from tarmac.session import work_dir
from tarmac.sources import tables
from tarmac.streaming import streams as ST

METRICS = ["roc_auc", "accuracy", "precision", "recall", "f1"]

# The labelled rows, and the md5 split: per class the first round(n / 5) rows in hash order are test.
_SPLIT = """
labelled AS (SELECT * FROM flights_encoded WHERE MONTH IS NOT NULL AND DAY_OF_WEEK IS NOT NULL),
split AS (SELECT *, row_number() OVER (PARTITION BY is_delayed ORDER BY md5('42:' || CAST(flight_id AS VARCHAR)))
    <= floor(count(*) OVER (PARTITION BY is_delayed) * 0.2 + 0.5) AS test FROM labelled),
sizes AS (SELECT count(*) FILTER (WHERE NOT test) AS train_size, count(*) FILTER (WHERE test) AS test_size,
    CAST(coalesce(sum(is_delayed) FILTER (WHERE test), 0) AS BIGINT) AS test_positives FROM split)"""
_MODELS = "(VALUES (0, 'LogisticRegression'), (1, 'RandomForest'), (2, 'GBT_A'), (3, 'GBT_B')) AS m(position, model)"


def labelled_features(spark, sf, flights=None):
    """The labelled rows and the dictionary. Both pass over the flights (``flights``, if at hand), which are stored first."""
    enc, d = FE.build_features(C.clean(tables.stored_flights(spark, sf) if flights is None else flights))
    return L.training_frame(enc), d


# One tree with one split, grown on all training rows and features.
STUMP = L.Presets(gbt_rounds=1, gbt_depth=1, gbt_step=1.0, gbt_subsample=1.0, gbt_feature_fraction=1.0)


def stump_sql(rows: str, bins: int = STUMP.gbt_bins, step: float = STUMP.gbt_step, g: B.Growth = B.LEVEL_WISE) -> str:
    """CTEs root_splits (best split of each feature at the root, over ``rows``)
    and stump (the best of them with both leaf values and the log-odds)."""
    values = " UNION ALL ".join(f"SELECT {i} AS position, '{f}' AS feature, CAST({f} AS DOUBLE) AS v, is_delayed AS y FROM {rows}"
                                for i, f in enumerate(ALL_FEATURES))
    return f"""
boost_values AS ({values}),
boost_ranks AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY v) AS rk, count(*) OVER (PARTITION BY position) AS n,
    max(v) OVER (PARTITION BY position) AS top FROM boost_values),
boost_cuts AS (SELECT DISTINCT position, feature, v AS cut FROM boost_ranks
    WHERE v < top AND floor(rk * {bins}.0 / n) BETWEEN 1 AND {bins - 1} AND ceil(floor(rk * {bins}.0 / n) * n / {bins}.0) = rk),
boost_sums AS (SELECT position, v, sum(count(*)) OVER (PARTITION BY position ORDER BY v) AS ln, sum(sum(y)) OVER (PARTITION BY position ORDER BY v) AS lp
    FROM boost_values GROUP BY position, v),
boost_all AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(is_delayed) AS DOUBLE) AS p, CAST(sum(is_delayed) AS DOUBLE) / count(*) AS rate FROM {rows}),
boost_sides AS (SELECT position, feature, cut, n, p, rate, CAST(ln AS DOUBLE) AS ln, rate * ln - lp AS lg, rate * (1 - rate) * ln AS lh,
    rate * (n - ln) - (p - lp) AS rg, rate * (1 - rate) * (n - ln) AS rh
    FROM boost_cuts JOIN boost_sums s USING (position) CROSS JOIN boost_all WHERE s.v = cut),
boost_gains AS (SELECT *, lg * lg / (lh + {g.l2}) + rg * rg / (rh + {g.l2}) - (lg + rg) * (lg + rg) / (lh + rh + {g.l2}) AS gain
    FROM boost_sides WHERE lh >= {g.min_hessian} AND rh >= {g.min_hessian}),
root_splits AS (SELECT * FROM boost_gains WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY position ORDER BY gain DESC, cut) = 1),
stump AS (SELECT feature, cut, ln(rate / (1 - rate)) AS base, -{step} * lg / (lh + {g.l2}) AS lv, -{step} * rg / (rh + {g.l2}) AS rv
    FROM root_splits ORDER BY gain DESC, position LIMIT 1)"""


_SIDE = "CASE stump.feature " + " ".join(f"WHEN '{f}' THEN CAST({{t}}.{f} AS DOUBLE)" for f in ALL_FEATURES) + " END"


def _stump_probability(t: str) -> str:
    return f"1 / (1 + exp(-(base + CASE WHEN {_SIDE.format(t=t)} <= cut THEN lv ELSE rv END)))"


def _stump(spark, tf, evaluate: bool = False):
    return L.train_all(spark, tf, STUMP, models=["GBT_A"], evaluate=evaluate)


@register("boost_root_splits", operators=("M5", "M6"), oracle=with_ctes(["flights_encoded"], """
SELECT CAST(position AS INTEGER) AS position, feature, cut, round(gain, 5) AS gain, CAST(ln AS BIGINT) AS left_rows, CAST(n - ln AS BIGINT) AS right_rows
FROM root_splits""", [_SPLIT, stump_sql("labelled")]))
def boost_root_splits(spark, sf):
    """Best split of every feature at the root of the first boosted tree, over all labelled rows."""
    tf, _ = labelled_features(spark, sf)
    return B.root_splits(tf, ALL_FEATURES, "label").select("position", "feature", "cut", F.round("gain", 5).alias("gain"),
                                                           "left_rows", "right_rows")


@register("train_models", operators=("M2", "M3", "M4", "M5", "M6", "M7", "M13", "M14", "M15"),
          oracle=with_ctes(["flights_encoded"], f"""
SELECT CAST(position AS INTEGER) AS position, model, 'FlightDelay_' || model AS run_name, CAST(train_size AS VARCHAR) AS train_size,
 CAST(test_size AS VARCHAR) AS test_size, '{len(ALL_FEATURES)}' AS n_features, test_size AS scored_rows, test_positives AS scored_positives,
 round(ln(rate / (1 - rate)), 6) AS empty_log_odds, round(-(rate * ln(rate) + (1 - rate) * ln(1 - rate)), 6) AS empty_loss
FROM {_MODELS}, sizes, (SELECT avg(is_delayed) AS rate FROM split WHERE NOT test) r""", [_SPLIT]))
def train_models(spark, sf):
    """All four models with the full presets, the runs stored and read back:
    one row per model, with the numbers of the model without features."""
    tf, _ = labelled_features(spark, sf)
    res = L.train_all(spark, tf, L.Presets())
    root = work_dir(spark, "runs")
    L.record_runs(spark, res, f"{root}/runs", f"{root}/models")
    runs = R.read_runs(spark, f"{root}/runs")
    counts = res.scored.groupBy("model").agg(F.count(F.lit(1)).alias("scored_rows"),
                                             F.sum("label").cast("bigint").alias("scored_positives"))
    rate = F.col("params")["train_positive_rate"].cast("double")
    out = runs.join(counts, "model").join(res.metrics.select("position", "model"), "model")
    return out.select(
        "position", "model", "run_name", F.col("params")["train_size"].alias("train_size"),
        F.col("params")["test_size"].alias("test_size"), F.col("params")["n_features"].alias("n_features"),
        "scored_rows", "scored_positives", F.round(F.log(rate / (1 - rate)), 6).alias("empty_log_odds"),
        F.round(-(rate * F.log(rate) + (1 - rate) * F.log(1 - rate)), 6).alias("empty_loss"))


@register("scaler_parameters", operators=("M2",), oracle=with_ctes(["flights_encoded"], " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS sd FROM split WHERE NOT test"
    for f in ALL_FEATURES), [_SPLIT]))
def scaler_parameters(spark, sf):
    """Mean and standard deviation of every feature on the training rows."""
    tf, _ = labelled_features(spark, sf)
    res = L.train_all(spark, tf, L.Presets(lr_max_iter=1), models=["LogisticRegression"], evaluate=False)
    rows = L.scaler_parameters(res.models["LogisticRegression"])
    return spark.createDataFrame(rows, "feature string, mean double, sd double").select(
        "feature", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@register("top_correlations", operators=("A7",), oracle=with_ctes(["flights_encoded"], f"""
SELECT feature, round(importance, 6) AS importance FROM ({" UNION ALL ".join(
    f"SELECT '{f}' AS feature, abs(corr({f}, is_delayed)) AS importance FROM labelled" for f in ALL_FEATURES)}) c
WHERE importance IS NOT NULL AND NOT isnan(importance) ORDER BY importance DESC, feature LIMIT 5""", [_SPLIT]))
def top_correlations(spark, sf):
    """The five features that correlate most with the label."""
    tf, _ = labelled_features(spark, sf)
    c = L.abs_correlations(tf).where("importance IS NOT NULL AND NOT isnan(importance)")
    return L.top_importances(c, 5).select("feature", F.round("importance", 6).alias("importance"))


@register("feature_importance", operators=("M16", "M5"), oracle=with_ctes(["flights_encoded"], f"""
SELECT f.feature, CASE WHEN f.feature = stump.feature THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance
FROM (VALUES {", ".join(f"('{f}')" for f in ALL_FEATURES)}) AS f(feature), stump""", [_SPLIT, stump_sql("(SELECT * FROM split WHERE NOT test)")]))
def feature_importance(spark, sf):
    """Importances of the boosted model of one split: its feature has all of it."""
    tf, _ = labelled_features(spark, sf)
    return L.feature_importance(spark, _stump(spark, tf).models["GBT_A"])


@register("batch_score_model", operators=("I8", "M5", "M7", "F13"), oracle=with_ctes(["requests", "flights_encoded"], f"""
SELECT flight_id, airline, route, CASE WHEN p >= 0.5 THEN 'Delayed' ELSE 'On Time' END AS prediction, round(p, 4) AS delay_probability,
 CASE WHEN p < 0.3 THEN 'LOW' WHEN p < 0.5 THEN 'MODERATE' WHEN p < 0.7 THEN 'HIGH' ELSE 'VERY HIGH' END AS risk_level
FROM (SELECT r.flight_id, v.airline, v.origin || '→' || v.destination AS route, {_stump_probability("r")} AS p
      FROM req_features r JOIN req_valid v USING (flight_id) CROSS JOIN stump) s""",
          [_REQ_VALID, _REQ_FEATURES, _SPLIT, stump_sql("(SELECT * FROM split WHERE NOT test)")]))
def batch_score_model(spark, sf):
    """Valid requests scored by the boosted model of one split, trained on the flights."""
    flights = tables.stored_flights(spark, sf)
    tf, d = labelled_features(spark, sf, flights)
    req = validate_requests(tables.requests(spark, sf, flights)).where("is_valid")
    return SC.batch_score(req, d, model=_stump(spark, tf).models["GBT_A"])


@register("model_roundtrip", operators=("S10", "M7"), oracle=with_ctes(["requests"], """
SELECT count(*) AS requests, count(*) AS equal_scores FROM req_valid WHERE reject_reason = ''""", [_REQ_VALID]))
def model_roundtrip(spark, sf):
    """A model saved and loaded scores every request as before."""
    flights = tables.stored_flights(spark, sf)
    tf, d = labelled_features(spark, sf, flights)
    model = L.train_all(spark, tf, L.Presets(), models=["LogisticRegression"], evaluate=False).models["LogisticRegression"]
    loaded = L.load_model(L.save_model(model, f"{work_dir(spark, 'model')}/model"))
    feats = FE.feature_columns(FE.score_features(validate_requests(tables.requests(spark, sf, flights)).where("is_valid"), d),
                               keep=["flight_id"])
    before = L.score(model, feats).withColumnsRenamed({"probability": "p1", "prediction": "y1"})
    both = L.score(loaded, before)
    return both.agg(F.count(F.lit(1)).alias("requests"),
                    F.count(F.when((F.col("p1") == F.col("probability")) & (F.col("y1") == F.col("prediction")), 1)).alias("equal_scores"))


@register("runs_roundtrip", operators=("S11", "M14"), oracle=with_ctes(["flights_encoded"], f"""
SELECT model, 'FlightDelay_' || model AS run_name, is_best, CAST(test_size AS VARCHAR) AS test_size,
 'accuracy,f1,precision,recall,roc_auc' AS metric_names, CAST({len(ALL_FEATURES)} AS INTEGER) AS feature_count, true AS model_loads
FROM (VALUES ('LogisticRegression', true)) AS m(model, is_best), sizes""", [_SPLIT]))
def runs_roundtrip(spark, sf):
    """A run stored and found again as the best one, with a model that loads."""
    tf, _ = labelled_features(spark, sf)
    res = L.train_all(spark, tf, L.Presets(), models=["LogisticRegression"])
    root = work_dir(spark, "runs")
    L.record_runs(spark, res, f"{root}/runs", f"{root}/models")
    best = L.best_run(spark, f"{root}/runs")
    loads = len(L.load_model(best.first()["model_path"]).stages) == 3
    runs = R.read_runs(spark, f"{root}/runs").select("model", "run_name", "is_best", F.col("params")["test_size"].alias("test_size"))
    return runs.join(best.drop("params"), "model").select(
        "model", "run_name", "is_best", "test_size", F.array_join(F.array_sort(F.map_keys("metrics")), ",").alias("metric_names"),
        "feature_count", F.lit(loads).alias("model_loads"))


_EVALUATED = f"""
evaluated AS (SELECT is_delayed AS y, {_stump_probability("t")} AS p FROM split t CROSS JOIN stump WHERE t.test),
cells AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
    count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn FROM evaluated),
by_score AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM evaluated GROUP BY p),
auc AS (SELECT CAST(sum(pos * (coalesce(below, 0) + neg / 2.0)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) AS auc FROM (
    SELECT pos, neg, sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM by_score) b),
shown(part, name, value) AS (
  SELECT 'comparison', 'roc_auc', auc FROM auc
  UNION ALL SELECT 'comparison', 'accuracy', (tp + tn) / CAST(n AS DOUBLE) FROM cells
  UNION ALL SELECT 'comparison', 'precision', coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) FROM cells
  UNION ALL SELECT 'comparison', 'recall', coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) FROM cells
  UNION ALL SELECT 'comparison', 'f1', coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) FROM cells
  UNION ALL SELECT 'confusion', 'actual 0 predicted 0', CAST(tn AS DOUBLE) FROM cells
  UNION ALL SELECT 'confusion', 'actual 0 predicted 1', CAST(fp AS DOUBLE) FROM cells
  UNION ALL SELECT 'confusion', 'actual 1 predicted 0', CAST(fn AS DOUBLE) FROM cells
  UNION ALL SELECT 'confusion', 'actual 1 predicted 1', CAST(tp AS DOUBLE) FROM cells
  UNION ALL SELECT 'roc', 'points', CAST(count(*) + 1 AS DOUBLE) FROM by_score
  UNION ALL SELECT 'report', 'On Time support', CAST(tn + fp AS DOUBLE) FROM cells
  UNION ALL SELECT 'report', 'Delayed support', CAST(tp + fn AS DOUBLE) FROM cells)"""


@register("full_evaluation", operators=("M17", "M8", "M9", "M11", "M12", "M15"), oracle=with_ctes(
    ["flights_encoded"], "SELECT part, name, round(value, 4) AS value FROM shown",
    [_SPLIT, stump_sql("(SELECT * FROM split WHERE NOT test)"), _EVALUATED]))
def full_evaluation_tables(spark, sf):
    """The evaluation tables of the boosted model of one split on the test rows, with their values."""
    tf, _ = labelled_features(spark, sf)
    res = _stump(spark, tf, evaluate=True)
    t = full_evaluation(res.scored, "GBT_A")

    def rows(part, name, value, table):
        return table.select(F.lit(part).alias("part"), name.alias("name"), F.round(value.cast("double"), 4).alias("value"))

    cell = F.format_string("actual %d predicted %d", F.col("actual"), F.col("predicted"))
    report = t["report"].where(F.col("label").isin("On Time", "Delayed"))
    return (rows("comparison", F.col("metric"), F.col("value"), t["comparison"])
            .unionByName(rows("confusion", cell, F.col("n"), t["confusion"]))
            .unionByName(rows("roc", F.lit("points"), F.col("n"), t["roc"].agg(F.count(F.lit(1)).alias("n"))))
            .unionByName(rows("report", F.concat("label", F.lit(" support")), F.col("support"), report)))


WRITERS = 4


@register("runs_versions", operators=("S11", "M14"), oracle=with_ctes(["flights_encoded"], f"""
SELECT version, 'GBT_A' AS model, round(value, 4) AS roc_auc, version = {WRITERS} AS is_current
FROM generate_series(1, {WRITERS}) AS v(version), shown WHERE name = 'roc_auc'""",
    [_SPLIT, stump_sql("(SELECT * FROM split WHERE NOT test)"), _EVALUATED]))
def runs_versions(spark, sf):
    """Trainings that end together: each gets a version of its own, and one is the current best."""
    tf, _ = labelled_features(spark, sf)
    res = _stump(spark, tf, evaluate=True)
    root = work_dir(spark, "runs")
    with ThreadPoolExecutor(WRITERS) as pool:
        for done in [pool.submit(L.record_runs, spark, res, f"{root}/runs", f"{root}/models/{i}") for i in range(WRITERS)]:
            done.result()
    best = L.best_run(spark, f"{root}/runs").select("version", F.lit(True).alias("is_current"))
    return R.read_runs(spark, f"{root}/runs").join(best, "version", "left").select(
        "version", "model", F.round(F.col("metrics")["roc_auc"], 4).alias("roc_auc"),
        F.coalesce("is_current", F.lit(False)).alias("is_current"))


def _stored_stump(spark, tf, d) -> P.Artifacts:
    """The boosted model of one split, trained, evaluated and stored as a training run keeps it."""
    art = P.Artifacts(f"{work_dir(spark, 'artifacts')}/artifacts")
    res = _stump(spark, tf, evaluate=True)
    FE.save_dictionary(d, art.dictionary)
    L.record_runs(spark, res, art.runs, art.models)
    return art


@register("model_info", operators=("S10", "S11", "F11", "M14"), oracle=with_ctes(["flights_encoded", "encoder_dictionary"], f"""
SELECT 'model' AS kind, 'GBT_A' AS name, CAST(NULL AS DOUBLE) AS value
UNION ALL SELECT 'metric', name, round(value, 4) FROM shown WHERE part = 'comparison'
UNION ALL SELECT 'feature', name, value FROM (VALUES {", ".join(f"('{f}', {i}.0::DOUBLE)" for i, f in enumerate(ALL_FEATURES))}) AS f(name, value)
UNION ALL SELECT CASE WHEN column_name = 'OP_CARRIER' THEN 'airline' ELSE 'airport' END, value, NULL
FROM encoder_dictionary WHERE column_name IN ('OP_CARRIER', 'ORIGIN')""",
    [_SPLIT, stump_sql("(SELECT * FROM split WHERE NOT test)"), _EVALUATED]))
def model_info(spark, sf):
    """What the current model is: its metrics, its features, the airlines and airports it knows."""
    info = P.model_info(spark, _stored_stump(spark, *labelled_features(spark, sf)))
    return info.withColumn("value", F.round("value", 4))


@register("stream_score_model", operators=("T1", "I6", "I8", "M7"), oracle=with_ctes(["requests", "flights_encoded"], f"""
SELECT flight_id, CASE WHEN p >= 0.5 THEN 'Delayed' ELSE 'On Time' END AS prediction, round(p, 4) AS delay_probability,
 CASE WHEN p < 0.3 THEN 'LOW' WHEN p < 0.5 THEN 'MODERATE' WHEN p < 0.7 THEN 'HIGH' ELSE 'VERY HIGH' END AS risk_level, 'GBT_A' AS model_name
FROM (SELECT r.flight_id, {_stump_probability("r")} AS p FROM req_features r CROSS JOIN stump) s""",
          [_REQ_VALID, _REQ_FEATURES, _SPLIT, stump_sql("(SELECT * FROM split WHERE NOT test)")]))
def stream_score_model(spark, sf):
    """The live path with the stored best model: request files are scored by it and written as responses."""
    flights = tables.stored_flights(spark, sf)
    art = _stored_stump(spark, *labelled_features(spark, sf, flights))
    src, sink, ckpt = ST.fresh_paths(spark, "stream-model")
    req = tables.requests(spark, sf, flights).withColumn("request_ts", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    ST.stage_as_files(req, src)
    for q in P.start_scoring_stream(spark, src, req.schema, art, f"{sink}/log", ckpt, trigger_seconds=None,
                                    responses_path=f"{sink}/responses"):
        q.awaitTermination()
    return spark.read.parquet(f"{sink}/responses").select("flight_id", "prediction", "delay_probability", "risk_level", "model_name")
