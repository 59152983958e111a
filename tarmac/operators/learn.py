"""Learning: stratified split, four classifiers, selection, run tracking,
importance and persistence.

The linear model is Spark ML's, the forest and both boosted models are grown
by ``forest`` and ``boosting`` and kept as Spark ML models. Each fit is a series of
distributed jobs (``treeAggregate`` for the linear model, per-level histogram
sums for trees) over one cached training frame; nothing is collected but
sums and model parameters.
"""

from __future__ import annotations

import datetime as dt
import math
import uuid
from dataclasses import dataclass, field, replace
from decimal import ROUND_HALF_UP, Decimal

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import boosting, forest
from tarmac.operators import runs as run_table
from tarmac.operators.features import complete_rows_expr, feature_columns
from tarmac.operators.metrics import binary_metrics
from tarmac.operators.ranking import first_n_per_group
from tarmac.schema import ALL_FEATURES
from tarmac.session import work_dir

MODEL_ORDER = ["LogisticRegression", "RandomForest", "GBT_A", "GBT_B"]

# Training rows r are read through ceil(sqrt(r / this)) partitions while those
# hold fewer than TRAIN_PARTITION_ROWS rows (4 for 30,000 rows, 100 for 20
# million), and through r / TRAIN_PARTITION_ROWS from there. A rule of the row
# count alone: the models do not depend on the cluster.
TRAIN_PARTITION_SCALE = 2_000
TRAIN_PARTITION_ROWS = 200_000


def train_partitions(n_rows: int) -> int:
    return max(1, math.ceil(math.sqrt(n_rows / TRAIN_PARTITION_SCALE)), math.ceil(n_rows / TRAIN_PARTITION_ROWS))


# ---------------------------------------------------------------- split
def split_hash(id_col: str, seed: int = 42):
    """Stable per-row hash: md5 of 'seed:id' (same text in any engine)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def class_quota(n: int, fraction: float) -> int:
    """round(n * fraction), half up, in decimal arithmetic."""
    return int((Decimal(n) * Decimal(str(fraction))).quantize(Decimal(1), rounding=ROUND_HALF_UP))


def stratified_split(df: DataFrame, label_col: str, id_col: str, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``split`` ('train'/'test'): per class, the round(fraction * n_c)
    rows first in hash order are test — exact class proportions, membership
    decided by the hash, independent of partitioning."""
    counts = {r[0]: r[1] for r in df.groupBy(label_col).count().collect()}  # one row per class
    quota = None
    for k, n in counts.items():
        q = F.lit(class_quota(n, test_fraction))
        cond = F.col(label_col).isNull() if k is None else (F.col(label_col) == F.lit(k))
        quota = F.when(cond, q) if quota is None else quota.when(cond, q)
    base = df.withColumn("_h", split_hash(id_col, seed)).withColumn("_q", quota if quota is not None else F.lit(0))
    marked = first_n_per_group(base, label_col, "_h", "_q", "_test", n_rows=sum(counts.values()),
                               n_groups=len(counts))
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_h", "_q", "_test")


def split_stats(split_df: DataFrame, label_col: str) -> DataFrame:
    """Sizes and positive rates of the split, one row."""
    tr, te = F.col("split") == "train", F.col("split") == "test"
    y = F.col(label_col)
    return split_df.agg(
        F.count(F.when(tr, 1)).alias("train_size"),
        F.count(F.when(te, 1)).alias("test_size"),
        F.avg(y.cast("double")).alias("positive_rate"),
        F.avg(F.when(tr, y.cast("double"))).alias("train_positive_rate"),
        F.avg(F.when(te, y.cast("double"))).alias("test_positive_rate"),
    )


# ---------------------------------------------------------------- models
@dataclass
class Presets:
    """Model sizes; the defaults are the full configurations."""
    lr_c: float = 0.1
    lr_max_iter: int = 1000
    rf_trees: int = 200
    rf_depth: int = 10
    rf_min_leaf: int = 5
    gbt_rounds: int = 300
    gbt_depth: int = 6
    gbt_step: float = 0.05
    gbt_subsample: float = 0.8
    gbt_feature_fraction: float = 0.8
    gbt_bins: int = 64
    gbt_leaves: int = 31                # of the leaf-wise model
    tree_memory_mb: int = 1024          # not read since the forest grows by histograms of bounded blocks
    max_fit_rows: int | None = None     # bound of the rows used to fit, chosen by the split's hash; None: all
    seed: int = 42


def _memory_mb(spark: SparkSession) -> int:
    """Memory of one executor (the driver in local mode), in MB."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local")
    text = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").strip().lower()
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    try:
        if text[-1] in units:
            return int(float(text[:-1]) * units[text[-1]])
        return int(float(text) / (1 << 20))
    except ValueError:
        return 1024


def node_memory_mb(spark: SparkSession, requested: int) -> int:
    """Tree node-statistics budget: at most 1/8 of an executor's memory, not
    below Spark's default 256 MB."""
    return max(256, min(requested, _memory_mb(spark) // 8))


def make_classifiers(p: Presets, n_train: int, id_col: str | None = None) -> dict:
    """The four classifiers, in the fixed comparison order."""
    # L2 with C: sum(loss) * C + |w|^2 / 2  ==  mean(loss) + |w|^2 / (2 C n)
    lr = LogisticRegression(labelCol="label", featuresCol="features", maxIter=p.lr_max_iter,
                            regParam=1.0 / (p.lr_c * max(1, n_train)), elasticNetParam=0.0,
                            standardization=False)
    lr.setPredictionCol("lr_prediction").setProbabilityCol("lr_probability").setRawPredictionCol("lr_raw")  # own columns: one pass scores all
    rf = forest.HistogramForest(forest.Forest(p.rf_trees, p.rf_depth, p.rf_min_leaf, p.gbt_bins, p.seed), "rf", id_col)
    own = {"rounds": p.gbt_rounds, "depth": p.gbt_depth, "step": p.gbt_step, "feature_share": p.gbt_feature_fraction,
           "bins": p.gbt_bins}
    level = replace(boosting.LEVEL_WISE, row_share=p.gbt_subsample, seed=p.seed, **own)
    leaf = replace(boosting.LEAF_WISE, leaves=p.gbt_leaves, seed=p.seed + 1, **own)
    gbt_a = boosting.HistogramBooster(level, "gbt_a", id_col)
    gbt_b = boosting.HistogramBooster(leaf, "gbt_b", id_col)
    return {"LogisticRegression": lr, "RandomForest": rf, "GBT_A": gbt_a, "GBT_B": gbt_b}


def scaler_pipeline() -> Pipeline:
    """Feature vector + standardisation (zero mean, unit variance)."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=ALL_FEATURES, outputCol="raw_features", handleInvalid="error"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)])


def training_frame(features: DataFrame, label_col: str = "is_delayed", id_col: str = "flight_id") -> DataFrame:
    """Fixed feature columns + ``label`` + id, complete rows only."""
    t = feature_columns(features, keep=[id_col, label_col]).where(complete_rows_expr())
    return t.withColumnRenamed(label_col, "label") if label_col != "label" else t


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``probability`` = P(class 1) as a double and ``prediction`` (int)."""
    clf = model.stages[-1]
    out = model.transform(df)
    drop = [c for c in ("raw_features", "features", clf.getRawPredictionCol(), clf.getProbabilityCol(),
                        clf.getPredictionCol()) if c not in df.columns]
    p, y = vector_to_array(F.col(clf.getProbabilityCol())).getItem(1), F.col(clf.getPredictionCol()).cast("int")
    return out.withColumns({"_p": p, "_y": y}).drop(*drop).withColumnsRenamed({"_p": "probability", "_y": "prediction"})


def score_all(classifiers: dict, vectors: DataFrame, keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """(model, *keep, probability, prediction): every classifier on every row
    of ``vectors``, in one pass over the rows."""
    out = vectors
    for m in classifiers.values():
        out = m.transform(out)
    rows = F.array(*[F.struct(F.lit(name).alias("model"),
                              vector_to_array(F.col(m.getProbabilityCol())).getItem(1).alias("probability"),
                              F.col(m.getPredictionCol()).cast("int").alias("prediction"))
                     for name, m in classifiers.items()])
    return out.select(*keep, F.explode(rows).alias("s")).select("s.model", *keep, "s.probability", "s.prediction")


@dataclass
class TrainResult:
    models: dict                # name -> PipelineModel (vector, scaler, classifier)
    metrics: DataFrame | None   # one row per model, comparison order
    best_name: str | None
    runs: list = field(default_factory=list)
    scored: DataFrame | None = None   # model, label, probability, prediction of the test rows (stored)

    def scored_test(self) -> DataFrame:
        """model, label, probability, prediction for every model on the test rows."""
        return self.scored


def train_all(spark: SparkSession, labelled: DataFrame, presets: Presets = Presets(),
              models: list[str] = MODEL_ORDER, test_fraction: float = 0.2, seed: int = 42,
              id_col: str = "flight_id", parallelism: int = 4, evaluate: bool = True) -> TrainResult:
    """Split, standardise once (fitted on train only), fit the classifiers
    concurrently on one persisted vector frame (``parallelism`` jobs at a
    time, as Spark ML's tuning does), evaluate on test and pick the best:
    strictly greater AUC wins, the first in comparison order wins a tie, no
    winner if every AUC is 0. ``evaluate=False`` returns the fitted models
    without the test-set metrics.

    ``presets.max_fit_rows`` bounds the rows that fit the models (by the hash
    of the id); the test rows are never cut."""
    from concurrent.futures import ThreadPoolExecutor

    # the split makes several passes (class counts, bucket totals, rows):
    # they read the stored feature rows, not the upstream pipeline
    root = work_dir(spark, "train")
    labelled.write.parquet(f"{root}/labelled")
    stratified_split(spark.read.parquet(f"{root}/labelled"), "label", id_col, test_fraction, seed) \
        .write.parquet(f"{root}/split")
    split = spark.read.parquet(f"{root}/split")
    sizes = split_stats(split, "label").first()
    n_train = int(sizes["train_size"])
    train_rows = split.where(F.col("split") == "train")
    if presets.max_fit_rows is not None and n_train > presets.max_fit_rows:
        share = F.conv(F.substring(F.md5(F.concat(F.lit("fit:"), F.col(id_col).cast("string"))), 1, 8), 16, 10)
        train_rows = train_rows.where(share.cast("double") < F.lit(float(1 << 32) * presets.max_fit_rows / n_train))
    prep = scaler_pipeline().fit(train_rows)
    # placed and ordered by the id: the trees' row samples do not depend on the input's layout
    train = prep.transform(train_rows).select(id_col, "label", "features") \
                .repartition(train_partitions(n_train), F.col(id_col)).sortWithinPartitions(id_col) \
                .persist(StorageLevel.MEMORY_AND_DISK)
    n_fit = train.count()
    clfs = make_classifiers(presets, n_fit, id_col)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        trees = [name for name in models if hasattr(clfs[name], "fit_binned")]
        # cut into codes once for all models of trees (they have one number of bins)
        rows = pool.submit(boosting.bin_rows, train, presets.gbt_bins, id_col=id_col) if trees else None
        futures = {name: pool.submit(lambda c: c.fit_binned(rows.result()), clfs[name]) if name in trees else pool.submit(clfs[name].fit, train)
                   for name in models}
        fitted_clf = {name: f.result() for name, f in futures.items()}
    if rows is not None:
        rows.result().blocks.unpersist()
    train.unpersist()
    fitted = {name: PipelineModel(stages=[*prep.stages, m]) for name, m in fitted_clf.items()}
    if not evaluate:  # fitted models only; the first in comparison order is returned as best
        return TrainResult(fitted, None, models[0], [], None)
    test = prep.transform(split.where(F.col("split") == "test")).select("label", "features")
    score_all(fitted_clf, test).write.parquet(f"{root}/scored")
    scored = spark.read.parquet(f"{root}/scored")
    metrics = binary_metrics(scored, by=["model"], pred_col="prediction")
    rows = {r["model"]: r.asDict() for r in metrics.collect()}  # one row per model
    best, best_auc, runs = None, 0.0, []
    for name in models:
        auc = rows[name]["roc_auc"] or 0.0
        if auc > best_auc:
            best, best_auc = name, auc
        runs.append({
            "run_id": uuid.uuid4().hex, "run_name": f"FlightDelay_{name}", "model": name,
            "params": {"model_type": name, "train_size": str(n_train),
                       "test_size": str(int(sizes["test_size"])), "n_features": str(len(ALL_FEATURES)),
                       "positive_rate": str(sizes["positive_rate"]),
                       "train_positive_rate": str(sizes["train_positive_rate"])},
            "metrics": {k: float(rows[name][k]) for k in ["roc_auc", "accuracy", "precision", "recall", "f1"]
                        if rows[name][k] is not None},
        })
    metrics_df = spark.createDataFrame(
        [(i, n, *[rows[n][k] for k in ["roc_auc", "accuracy", "precision", "recall", "f1"]])
         for i, n in enumerate(models)],
        "position int, model string, roc_auc double, accuracy double, precision double, recall double, f1 double")
    return TrainResult(fitted, metrics_df, best, runs, scored)


# ---------------------------------------------------------------- importance
def feature_importance(spark: SparkSession, model: PipelineModel, names=ALL_FEATURES) -> DataFrame:
    """(feature, importance) sorted descending: tree importances, else the
    absolute coefficients; empty if the model has neither."""
    clf = model.stages[-1]
    if hasattr(clf, "featureImportances"):
        vals = clf.featureImportances.toArray().tolist()
    elif hasattr(clf, "coefficients"):
        vals = [abs(v) for v in clf.coefficients.toArray().tolist()]
    else:
        return spark.createDataFrame([], "feature string, importance double")
    rows = list(zip(names, [float(v) for v in vals]))
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.desc("importance"), F.asc("feature"))


def abs_correlations(features: DataFrame, label_col: str = "label", names=ALL_FEATURES) -> DataFrame:
    """(feature, importance): absolute correlation of each feature with the
    label, from one aggregation; NULL for a constant feature."""
    row = features.agg(*[F.abs(F.corr(F.col(f).cast("double"), F.col(label_col).cast("double"))).alias(f) for f in names])
    return row.unpivot([], list(names), "feature", "importance")


def scaler_parameters(model: PipelineModel, names=ALL_FEATURES) -> list[tuple[str, float, float]]:
    """(feature, mean, standard deviation) of a fitted model's scaler."""
    scaler = model.stages[1]
    return [(f, float(m), float(d)) for f, m, d in zip(names, scaler.mean.toArray(), scaler.std.toArray())]


def top_importances(fi: DataFrame, n: int = 10) -> DataFrame:
    return fi.orderBy(F.desc("importance"), F.asc("feature")).limit(n)


# ---------------------------------------------------------------- persistence
def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"nothing to load at {path}: train and save a model before scoring") from e


def record_runs(spark: SparkSession, result: TrainResult, runs_path: str, model_root: str) -> DataFrame:
    """Store the trained models and add one row for each to the ``runs`` table,
    as a version of its own (see ``runs``); returns the rows."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = []
    for r in result.runs:
        path = f"{model_root.rstrip('/')}/{r['run_id']}"
        save_model(result.models[r["model"]], path)
        rows.append((r["run_id"], r["run_name"], r["model"], r["params"], r["metrics"], path, now,
                     r["model"] == result.best_name))
    version = run_table.add_runs(spark, runs_path, rows)
    return run_table.read_runs(spark, runs_path).where(F.col("version") == version)


def best_run(spark: SparkSession, runs_path: str) -> DataFrame:
    """Best run of the newest training: model name, metrics, feature count, model path, version."""
    return run_table.newest_best(run_table.read_runs(spark, runs_path)).select(
        "run_id", "model", "params", "metrics", F.lit(len(ALL_FEATURES)).alias("feature_count"), "model_path", "version")
