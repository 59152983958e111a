"""Evaluation of a scored table (label 0/1, probability of class 1) as Spark
aggregations: exact ROC-AUC, ROC points, confusion matrix, classification
report, the five headline metrics and a long model comparison.

Every metric takes ``by`` columns (e.g. ``model``) and is computed per group
in the same jobs. Counts come from one aggregation with map-side partial
aggregation; the rank statistic runs over grouped distinct scores with the
bucketed prefix sums of ``ranking`` (no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.bands import DECISION_CUT, predicted_class
from tarmac.operators.ranking import prefix_sums
from tarmac.session import work_dir

METRIC_NAMES = ["roc_auc", "accuracy", "precision", "recall", "f1"]
CLASS_NAMES = ["On Time", "Delayed"]
DIGITS = 4
# Consecutive ROC points that one window partition holds.
ROC_BLOCK = 100_000


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (zero division -> 0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_counts(scored: DataFrame, label_col: str = "label", prob_col: str = "probability",
                     by: list[str] = (), pred_col: str | None = None,
                     cut: float = DECISION_CUT) -> DataFrame:
    """tp, fp, tn, fn, P, N per group in one aggregation."""
    y = F.col(label_col)
    yhat = F.col(pred_col) if pred_col else predicted_class(F.col(prob_col), cut)
    t = scored.select(*by, y.alias("_y"), yhat.alias("_p"))
    one = F.lit(1)
    return t.groupBy(*by).agg(
        F.count(F.when((F.col("_y") == 1) & (F.col("_p") == 1), one)).alias("tp"),
        F.count(F.when((F.col("_y") == 0) & (F.col("_p") == 1), one)).alias("fp"),
        F.count(F.when((F.col("_y") == 0) & (F.col("_p") == 0), one)).alias("tn"),
        F.count(F.when((F.col("_y") == 1) & (F.col("_p") == 0), one)).alias("fn"),
    )


def score_groups(scored: DataFrame, label_col: str, prob_col: str, by: list[str]) -> DataFrame:
    """Distinct scores per group with their positive and negative counts."""
    y = F.col(label_col)
    return scored.where(F.col(prob_col).isNotNull()).groupBy(*by, F.col(prob_col).alias("score")).agg(
        F.sum(y).cast("bigint").alias("pos"),
        F.sum(F.lit(1) - y).cast("bigint").alias("neg"),
    )


def auc_bounds(scored: DataFrame, label_col: str = "label", prob_col: str = "probability", by: list[str] = (),
               bins: int = 1000) -> DataFrame:
    """(*by, lower, upper, positives, negatives): bounds of the exact ROC-AUC
    from one aggregation into score bins, whose counts of positives and
    negatives add up over partitions, days or tables. Pairs in different bins
    are ordered; pairs in one bin count not at all (lower) or whole (upper),
    so the exact value lies between. NULL with a single class."""
    by = list(by)
    p = F.col(prob_col)
    place = F.least(F.greatest(F.floor(p * bins), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")
    y = F.col(label_col)
    cells = scored.where(p.isNotNull()).groupBy(*by, place).agg(F.sum(y).cast("bigint").alias("pos"),
                                                               F.sum(F.lit(1) - y).cast("bigint").alias("neg"))
    return auc_bounds_of(cells, by)


def auc_bounds_of(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """Bounds from stored bin counts (*by, bin, pos, neg), several rows of a
    bin added up; the window runs over at most ``bins`` rows of a group."""
    by, dec = list(by), "decimal(38,0)"
    cells = cells.groupBy(*by, "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    terms = cells.withColumn("_sure", F.col("pos").cast(dec) * below.cast(dec)) \
                 .withColumn("_open", F.col("pos").cast(dec) * F.col("neg").cast(dec))
    agg = terms.groupBy(*by).agg(F.sum("_sure").alias("_sure"), F.sum("_open").alias("_open"),
                                 F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    den = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return agg.select(*by, F.try_divide(F.col("_sure").cast("double"), den).alias("lower"),
                      F.try_divide((F.col("_sure") + F.col("_open")).cast("double"), den).alias("upper"), "positives", "negatives")


def roc_auc(scored: DataFrame, label_col: str = "label", prob_col: str = "probability",
            by: list[str] = ()) -> DataFrame:
    """Exact ROC-AUC per group: the rank statistic with ties counted half,
    sum(pos * (neg below + neg at the same score / 2)) / (P * N).
    NULL with a single class."""
    by = list(by)
    g = score_groups(scored, label_col, prob_col, by)
    c = prefix_sums(g, "score", ["neg"], partition=by)
    dec = "decimal(38,0)"
    # 2 * (negatives strictly below) + negatives at the score, exact integers
    term = F.col("pos").cast(dec) * (F.lit(2) * F.col("cum_neg") - F.col("neg")).cast(dec)
    agg = c.groupBy(*by).agg(F.sum(term).alias("_num"), F.sum("pos").alias("P"),
                             F.sum("neg").alias("N"))
    den = F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double")
    return agg.select(*by, F.try_divide(F.col("_num").cast("double"), den).alias("roc_auc"))


def binary_metrics(scored: DataFrame, label_col: str = "label", prob_col: str = "probability",
                   by: list[str] = (), pred_col: str | None = None,
                   cut: float = DECISION_CUT) -> DataFrame:
    """roc_auc, accuracy, precision, recall, f1 per group, 4 places."""
    by = list(by)
    cm = confusion_counts(scored, label_col, prob_col, by, pred_col, cut)
    auc = roc_auc(scored, label_col, prob_col, by)
    j = cm.join(auc, by, "left") if by else cm.crossJoin(auc)  # one row each without groups
    tp, fp, tn, fn = (F.col(c) for c in ["tp", "fp", "tn", "fn"])
    r = lambda c: F.round(c, DIGITS)
    return j.select(
        *by,
        r(F.col("roc_auc")).alias("roc_auc"),
        r(_ratio(tp + tn, tp + fp + tn + fn)).alias("accuracy"),
        r(_ratio(tp, tp + fp)).alias("precision"),
        r(_ratio(tp, tp + fn)).alias("recall"),
        r(_ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn)).alias("f1"),
    )


def roc_points(scored: DataFrame, label_col: str = "label", prob_col: str = "probability",
               by: list[str] = (), drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, descending, plus the origin
    at threshold +inf; points in the middle of a straight run are dropped."""
    by = list(by)
    g = score_groups(scored, label_col, prob_col, by)
    # stored once (one row per distinct score): totals, boundaries and points read it, not the scores
    path = work_dir(g.sparkSession, "roc")
    prefix_sums(g, "score", ["pos", "neg"], descending=True, index_col="i", partition=by) \
        .select(*by, "score", "i", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps")).write.parquet(path)
    c = g.sparkSession.read.parquet(path)
    tot = c.groupBy(*by).agg(F.max("i").alias("m"), F.max("tps").alias("P"), F.max("fps").alias("N"))
    # totals: one row per group
    pts = c.join(F.broadcast(tot), by, "left") if by else c.crossJoin(F.broadcast(tot))
    if drop_intermediate:
        # blocks of consecutive points; a block also gets a copy of the point before and after it
        block = F.floor((F.col("i") - 1) / ROC_BLOCK)
        at = (F.col("i") - 1) % ROC_BLOCK
        own = pts.withColumn("at", F.explode(F.array_compact(F.array(
            block, F.when((at == 0) & (block > 0), block - 1), F.when(at == ROC_BLOCK - 1, block + 1)))))
        w = Window.partitionBy(*by, "at").orderBy("i")
        near = {f"{c}{k}": (F.lag(c).over(w) if k == 0 else F.lead(c).over(w)) for c in ("tps", "fps") for k in (0, 2)}
        pts = own.withColumns(near).where(F.col("at") == block)
        bend = ((F.col("fps2") - F.lit(2) * F.col("fps") + F.col("fps0")) != 0) | \
               ((F.col("tps2") - F.lit(2) * F.col("tps") + F.col("tps0")) != 0)
        keep = (F.col("m") <= 2) | (F.col("i") == 1) | (F.col("i") == F.col("m")) | F.coalesce(bend, F.lit(False))
        pts = pts.where(keep)
    out = pts.select(*by, F.col("score").alias("threshold"),
                     F.try_divide(F.col("fps").cast("double"), F.col("N")).alias("fpr"),
                     F.try_divide(F.col("tps").cast("double"), F.col("P")).alias("tpr"))
    origin = tot.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                        F.lit(0.0).alias("tpr"))
    return out.unionByName(origin)


def confusion_matrix(scored: DataFrame, label_col: str = "label", prob_col: str = "probability",
                     pred_col: str | None = None, cut: float = DECISION_CUT) -> DataFrame:
    """2x2 cells (actual, predicted, n); empty cells present with n = 0."""
    cm = confusion_counts(scored, label_col, prob_col, [], pred_col, cut)
    return cm.select(F.explode(F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("n")),
    )).alias("c")).select("c.actual", "c.predicted", F.col("c.n").cast("bigint").alias("n"))


def classification_report(scored: DataFrame, label_col: str = "label", prob_col: str = "probability",
                          pred_col: str | None = None, cut: float = DECISION_CUT) -> DataFrame:
    """Per class precision/recall/f1/support, accuracy, macro and weighted
    averages; one row each, 4 places."""
    cm = confusion_counts(scored, label_col, prob_col, [], pred_col, cut)
    tp, fp, tn, fn = (F.col(c) for c in ["tp", "fp", "tn", "fn"])
    per = cm.select(
        _ratio(tn, tn + fn).alias("p0"), _ratio(tn, tn + fp).alias("r0"),
        _ratio(F.lit(2) * tn, F.lit(2) * tn + fn + fp).alias("f0"), (tn + fp).alias("s0"),
        _ratio(tp, tp + fp).alias("p1"), _ratio(tp, tp + fn).alias("r1"),
        _ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"), (tp + fn).alias("s1"),
        (tp + fp + tn + fn).alias("n"), _ratio(tp + tn, tp + fp + tn + fn).alias("acc"),
    )
    r = lambda c: F.round(c, DIGITS)
    s0, s1, n = F.col("s0"), F.col("s1"), F.col("n")

    def wavg(a, b):
        return F.coalesce(F.try_divide(F.col(a) * s0 + F.col(b) * s1, n.cast("double")), F.lit(0.0))

    rows = F.array(
        F.struct(F.lit(CLASS_NAMES[0]).alias("label"), r(F.col("p0")).alias("precision"),
                 r(F.col("r0")).alias("recall"), r(F.col("f0")).alias("f1_score"), s0.alias("support")),
        F.struct(F.lit(CLASS_NAMES[1]).alias("label"), r(F.col("p1")).alias("precision"),
                 r(F.col("r1")).alias("recall"), r(F.col("f1")).alias("f1_score"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), r(F.col("acc")).alias("f1_score"),
                 n.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), r((F.col("p0") + F.col("p1")) / 2).alias("precision"),
                 r((F.col("r0") + F.col("r1")) / 2).alias("recall"),
                 r((F.col("f0") + F.col("f1")) / 2).alias("f1_score"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), r(wavg("p0", "p1")).alias("precision"),
                 r(wavg("r0", "r1")).alias("recall"), r(wavg("f0", "f1")).alias("f1_score"),
                 n.alias("support")),
    )
    return per.select(F.explode(rows).alias("x")).select(
        "x.label", "x.precision", "x.recall", "x.f1_score", F.col("x.support").cast("bigint").alias("support"))


def model_comparison(metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """Wide metrics (one row per model) -> long (model, metric, value)."""
    return metrics.select(model_col, *METRIC_NAMES).unpivot(
        [model_col], METRIC_NAMES, "metric", "value")


def full_evaluation(scored_by_model, best: str, label_col: str = "label",
                    prob_col: str = "probability", pred_col: str | None = "prediction") -> dict:
    """All evaluation tables of a training run from one scored test table
    (columns model, label, probability, prediction): the long comparison of
    every model, and ROC points, confusion cells and the classification
    report of the best model. Lazy DataFrames; the caller may cache
    ``scored_by_model`` once if it materialises several of them."""
    wide = binary_metrics(scored_by_model, label_col, prob_col, by=["model"], pred_col=pred_col)
    one = scored_by_model.where(F.col("model") == F.lit(best))
    return {
        "metrics": wide,
        "comparison": model_comparison(wide),
        "roc": roc_points(one, label_col, prob_col),
        "confusion": confusion_matrix(one, label_col, prob_col, pred_col),
        "report": classification_report(one, label_col, prob_col, pred_col),
    }
