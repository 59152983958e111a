"""Registered queries: split and evaluation on the rule-scored flights
(M1, M8-M12, M15, A9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import learn as L
from tarmac.operators import metrics as M
from tarmac.plans.oracle import with_ctes
from tarmac.plans.registry import register
from tarmac.sources import tables


def _scored(spark, sf):
    return tables.flights_scored(spark, sf)


def _two_scorers(spark, sf):
    """The rule score and a coarse version of it, as two 'models'."""
    s = _scored(spark, sf).select("label", "probability")
    coarse = s.select(F.lit("rule_coarse").alias("model"), "label",
                      (F.floor(F.col("probability") * 10) / 10).alias("probability"))
    return s.select(F.lit("rule").alias("model"), "label", "probability").unionByName(coarse)


_TWO = """
two_scorers AS (
 SELECT 'rule' AS model, label, probability FROM flights_scored
 UNION ALL SELECT 'rule_coarse', label, floor(probability * 10) / 10 FROM flights_scored
)"""

_AUC = """
auc_g AS (SELECT {by} probability AS score, sum(label) AS pos, count(*) - sum(label) AS neg
          FROM {src} GROUP BY {by} probability),
auc_c AS (SELECT *, sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
          FROM auc_g),
auc AS (SELECT {by} CAST(sum(pos * (2 * cum_neg - neg)) AS DOUBLE)
          / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS roc_auc FROM auc_c {group})"""

_CM = """
cm AS (SELECT {by}
  count(*) FILTER (WHERE label = 1 AND probability > 0.5) AS tp,
  count(*) FILTER (WHERE label = 0 AND probability > 0.5) AS fp,
  count(*) FILTER (WHERE label = 0 AND NOT probability > 0.5) AS tn,
  count(*) FILTER (WHERE label = 1 AND NOT probability > 0.5) AS fn
 FROM {src} {group})"""


def _auc(src, by=""):
    return _AUC.format(src=src, by=f"{by}, " if by else "", part=f"PARTITION BY {by}" if by else "",
                       group=f"GROUP BY {by}" if by else "")


def _cm(src, by=""):
    return _CM.format(src=src, by=f"{by}, " if by else "", group=f"GROUP BY {by}" if by else "")


_METRIC_SELECT = """
 round(roc_auc, 4) AS roc_auc,
 round(CASE WHEN tp + fp + tn + fn = 0 THEN 0 ELSE (tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE) END, 4) AS accuracy,
 round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 4) AS precision,
 round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 4) AS recall,
 round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 4) AS f1"""


@register("roc_auc_exact", operators=("M9",), oracle=with_ctes(["flights_scored"], """
SELECT roc_auc FROM auc""", [_auc("flights_scored").strip()]))
def roc_auc_exact(spark, sf):
    return M.roc_auc(_scored(spark, sf))


@register("binary_metrics", operators=("M8", "M9"), oracle=with_ctes(["flights_scored"], f"""
SELECT {_METRIC_SELECT} FROM cm, auc""", [_cm("flights_scored").strip(), _auc("flights_scored").strip()]))
def binary_metrics(spark, sf):
    return M.binary_metrics(_scored(spark, sf))


@register("roc_points", operators=("M10",), oracle=with_ctes(["flights_scored"], """
SELECT threshold, fps / CAST(n AS DOUBLE) AS fpr, tps / CAST(p AS DOUBLE) AS tpr FROM roc_d
WHERE m <= 2 OR i = 1 OR i = m OR (fp2 - 2 * fps + fp0) <> 0 OR (tp2 - 2 * tps + tp0) <> 0
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""", ["""
roc_g AS (SELECT probability AS threshold, sum(label) AS pos, count(*) - sum(label) AS neg
          FROM flights_scored GROUP BY probability),
roc_c AS (SELECT threshold,
   sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
   sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
   row_number() OVER (ORDER BY threshold DESC) AS i, count(*) OVER () AS m,
   sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM roc_g),
roc_d AS (SELECT *, lag(tps) OVER (ORDER BY i) AS tp0, lead(tps) OVER (ORDER BY i) AS tp2,
   lag(fps) OVER (ORDER BY i) AS fp0, lead(fps) OVER (ORDER BY i) AS fp2 FROM roc_c)"""]))
def roc_points(spark, sf):
    return M.roc_points(_scored(spark, sf))


@register("confusion_matrix", operators=("M11",), oracle=with_ctes(["flights_scored"], """
SELECT a.actual, a.predicted, CAST(count(s.label) AS BIGINT) AS n
FROM (SELECT * FROM (VALUES (0), (1)) x(actual), (VALUES (0), (1)) y(predicted)) a
LEFT JOIN (SELECT label, CAST(probability > 0.5 AS INTEGER) AS pred FROM flights_scored) s
  ON s.label = a.actual AND s.pred = a.predicted
GROUP BY a.actual, a.predicted"""))
def confusion_matrix(spark, sf):
    return M.confusion_matrix(_scored(spark, sf))


@register("classification_report", operators=("M12",), oracle=with_ctes(["flights_scored"], """
SELECT label, precision, recall, f1_score, support FROM (
 SELECT 'On Time' AS label, round(p0, 4) AS precision, round(r0, 4) AS recall, round(f0, 4) AS f1_score, s0 AS support FROM per
 UNION ALL SELECT 'Delayed', round(p1, 4), round(r1, 4), round(f1, 4), s1 FROM per
 UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 4), n FROM per
 UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 4), round((r0 + r1) / 2, 4), round((f0 + f1) / 2, 4), n FROM per
 UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / CAST(n AS DOUBLE), 4),
   round((r0 * s0 + r1 * s1) / CAST(n AS DOUBLE), 4), round((f0 * s0 + f1 * s1) / CAST(n AS DOUBLE), 4), n FROM per
) t""", [_cm("flights_scored").strip(), """
per AS (SELECT
  CASE WHEN tn + fn = 0 THEN 0 ELSE tn / CAST(tn + fn AS DOUBLE) END AS p0,
  CASE WHEN tn + fp = 0 THEN 0 ELSE tn / CAST(tn + fp AS DOUBLE) END AS r0,
  CASE WHEN 2 * tn + fn + fp = 0 THEN 0 ELSE 2 * tn / CAST(2 * tn + fn + fp AS DOUBLE) END AS f0,
  CAST(tn + fp AS BIGINT) AS s0,
  CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p1,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r1,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1,
  CAST(tp + fn AS BIGINT) AS s1, CAST(tp + fp + tn + fn AS BIGINT) AS n,
  CASE WHEN tp + fp + tn + fn = 0 THEN 0 ELSE (tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE) END AS acc
 FROM cm)"""]))
def classification_report(spark, sf):
    return M.classification_report(_scored(spark, sf))


@register("model_comparison", operators=("M15",), oracle=with_ctes(["flights_scored"], f"""
SELECT model, metric, value FROM (
 SELECT cm.model, {_METRIC_SELECT} FROM cm JOIN auc ON cm.model = auc.model) w
UNPIVOT (value FOR metric IN (roc_auc, accuracy, precision, recall, f1))""",
    [_TWO.strip(), _cm("two_scorers", "model").strip(), _auc("two_scorers", "model").strip()]))
def model_comparison(spark, sf):
    wide = M.binary_metrics(_two_scorers(spark, sf), by=["model"])
    return M.model_comparison(wide)


_SPLIT = """
split AS (
 SELECT flight_id, label,
  CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(flight_id AS VARCHAR)))
            <= round(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split
 FROM flights_scored
)"""


@register("stratified_split", operators=("M1",), oracle=with_ctes(["flights_scored"], """
SELECT flight_id, label, split FROM split""", [_SPLIT.strip()]))
def stratified_split(spark, sf):
    s = _scored(spark, sf).select("flight_id", "label")
    return L.stratified_split(s, "label", "flight_id", 0.2, 42)


@register("split_stats", operators=("M1", "A9"), oracle=with_ctes(["flights_scored"], """
SELECT count(*) FILTER (WHERE split = 'train') AS train_size,
 count(*) FILTER (WHERE split = 'test') AS test_size,
 avg(CAST(label AS DOUBLE)) AS positive_rate,
 avg(CAST(label AS DOUBLE)) FILTER (WHERE split = 'train') AS train_positive_rate,
 avg(CAST(label AS DOUBLE)) FILTER (WHERE split = 'test') AS test_positive_rate
FROM split""", [_SPLIT.strip()]))
def split_stats(spark, sf):
    s = _scored(spark, sf).select("flight_id", "label")
    return L.split_stats(L.stratified_split(s, "label", "flight_id", 0.2, 42), "label")


@register("auc_bounds", operators=("M9",), oracle=with_ctes(["flights_scored"], """
SELECT model, round(CAST(sum(pos * b) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE), 6) AS lower,
 round(CAST(sum(pos * (b + neg)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE), 6) AS upper,
 CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, true AS holds_exact
FROM below GROUP BY model""", [_TWO, """
cells AS (SELECT model, CAST(least(greatest(floor(probability * 1000), 0), 999) AS INTEGER) AS bin, sum(label) AS pos, sum(1 - label) AS neg
          FROM two_scorers GROUP BY ALL),
below AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cells)"""]))
def auc_bounds(spark, sf):
    """Bounds of the AUC from mergeable bin counts; the exact value lies between them."""
    s = _two_scorers(spark, sf)
    exact = M.roc_auc(s, by=["model"])
    b = M.auc_bounds(s, by=["model"]).join(exact, "model")
    return b.select("model", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "positives", "negatives",
                    (F.col("roc_auc").between(F.col("lower") - 1e-12, F.col("upper") + 1e-12)).alias("holds_exact"))
