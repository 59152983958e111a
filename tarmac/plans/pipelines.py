"""End-to-end plans: a training run, batch scoring of an uploaded file, the
monitoring run and the live scoring stream. Each reads and writes tables in
the given folders (shared storage on a cluster)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import clean as C
from tarmac.operators import features as FE
from tarmac.operators import learn as L
from tarmac.operators import monitor as MO
from tarmac.operators import scoring as SC
from tarmac.operators.metrics import full_evaluation
from tarmac.session import input_bytes, size_shuffles
from tarmac.sources import io
from tarmac.streaming import streams as ST


@dataclass
class Artifacts:
    """Where a training run keeps its outputs."""
    root: str

    @property
    def dictionary(self) -> str:
        return f"{self.root}/dictionary"

    @property
    def runs(self) -> str:
        return f"{self.root}/runs"

    @property
    def evaluation(self) -> str:
        return f"{self.root}/evaluation"

    @property
    def models(self) -> str:
        return f"{self.root}/models"


def training_run(spark: SparkSession, raw: DataFrame, artifacts: Artifacts,
                 presets: L.Presets = L.Presets(), id_col: str = "flight_id") -> L.TrainResult:
    """clean -> validate -> features + dictionary -> train all -> runs table,
    evaluation tables (comparison, ROC points, confusion, report), data
    summary and cleaning report."""
    size_shuffles(spark, input_size(raw))
    cleaned = C.clean(raw)
    ok, message = C.validate(cleaned).first()
    if not ok:
        raise ValueError(message)
    enc, d = FE.build_features(cleaned)
    own = FE.save_dictionary(d, f"{artifacts.dictionary}-{uuid.uuid4().hex}")     # kept with the runs that were trained on it
    FE.save_dictionary(d, artifacts.dictionary)
    res = L.train_all(spark, L.training_frame(enc, id_col=id_col), presets, id_col=id_col)
    for run in res.runs:
        run["params"]["dictionary"] = own
    L.record_runs(spark, res, artifacts.runs, artifacts.models)
    tables = full_evaluation(res.scored, res.best_name)
    tables |= {"summary": C.data_summary(cleaned), "cleaning": C.cleaning_report(raw)}
    for name, table in tables.items():
        io.save_parquet(table, f"{artifacts.evaluation}/{name}")
    return res


def input_size(df: DataFrame) -> int:
    """Bytes of the files that a table reads, 0 if it reads none."""
    files = df.inputFiles()
    folders = {f.rsplit("/", 1)[0] for f in files}
    return sum(input_bytes(df.sparkSession, f) for f in folders)


def batch_score_file(spark: SparkSession, csv_path: str, artifacts: Artifacts, out_path: str,
                     id_col: str | None = None, risk_scheme: str = "two-way", percent: bool = True) -> DataFrame:
    """Uploaded CSV -> typed requests -> scored with the latest best model ->
    written to ``out_path``; rejected rows are written next to it."""
    best = L.best_run(spark, artifacts.runs).first()
    model = L.load_model(best["model_path"])
    d = FE.load_dictionary(spark, best["params"].get("dictionary") or artifacts.dictionary)
    req = io.read_batch_requests(spark, csv_path)
    keep = [id_col] if id_col else []
    scored = SC.batch_score(req.where("is_valid"), d, model=model, keep=tuple(keep),
                            risk_scheme=risk_scheme, percent=percent)
    io.save_csv(scored, out_path)
    io.save_csv(req.where(~F.col("is_valid")), out_path + "_rejected")
    return spark.read.option("header", True).csv(out_path)


def monitoring_run(spark: SparkSession, log_path: str, as_of, report_path: str) -> DataFrame:
    """Inference log -> report rows (stats + drift) -> report file."""
    log = io.load_inference_log(spark, log_path)
    report = MO.monitoring_report(log, as_of)
    io.write_report(report, report_path)
    return report


class CurrentModel:
    """The latest best run of a runs table: its model and the dictionary that
    it was trained with, loaded when the run changes."""

    def __init__(self, spark: SparkSession, artifacts: Artifacts):
        self.spark, self.artifacts = spark, artifacts
        self.version = self.name = self.model = self.dictionary = None

    def refresh(self) -> CurrentModel:
        best = L.best_run(self.spark, self.artifacts.runs).first()          # one row
        if best["run_id"] != self.version:
            self.model = L.load_model(best["model_path"])
            self.dictionary = FE.load_dictionary(self.spark, best["params"].get("dictionary") or self.artifacts.dictionary)
            self.version, self.name = best["run_id"], best["model"]
        return self


def score_batch(batch: DataFrame, current: CurrentModel, log_path: str, key: str = "flight_id",
                responses_path: str | None = None, rejects_path: str | None = None, risk_scheme: str = "A") -> None:
    """One micro-batch of requests, scored by the run that is best now and
    added to the log (and to the dated response and reject tables). What an
    earlier attempt of the batch has written is not written again."""
    now = current.refresh()
    resp = ST.responses_stream(batch, now.dictionary, now.name, model=now.model, key=key, risk_scheme=risk_scheme)
    resp = resp.withColumn("model_version", F.lit(now.version)).persist()
    try:
        if responses_path:
            out = resp.select(key, "inference_id", "prediction", "delay_probability", "confidence", "risk_level",
                              "model_name", "model_version", "response_ts")
            ST.append_once(out, responses_path, key="inference_id", ts_col="response_ts")
        ST.append_once(SC.log_rows(resp, keep=[key]), log_path, key=key)
        if rejects_path:
            ST.append_once(ST.rejected_requests_stream(batch), rejects_path, key=key, ts_col="request_ts")
    finally:
        resp.unpersist()


def start_scoring_stream(spark: SparkSession, requests_dir: str, schema, artifacts: Artifacts,
                         log_path: str, checkpoint: str, trigger_seconds: int | None = 10,
                         key: str = "flight_id", responses_path: str | None = None,
                         rejects_path: str | None = None, risk_scheme: str = "A") -> list:
    """Live path: request files -> validated, scored responses -> appended to
    the inference log, with the request key; responses (id, confidence, risk,
    model and its version) and rejected requests (with reasons) go to their
    own dated tables if paths are given.

    The best run is looked up for every micro-batch: a new training takes over
    at the next batch, without a restart, with its own dictionary."""
    current = CurrentModel(spark, artifacts)
    requests = ST.read_stream(spark, requests_dir, schema)
    w = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: score_batch(batch, current, log_path, key, responses_path, rejects_path, risk_scheme))
    w = w.trigger(processingTime=f"{trigger_seconds} seconds") if trigger_seconds else w.trigger(availableNow=True)
    return [w.start()]


def model_info(spark: SparkSession, artifacts: Artifacts) -> DataFrame:
    """Rows (kind, name, value): the best model, its metrics, the feature
    list, and the known airlines and airports."""
    from tarmac.schema import ALL_FEATURES
    best = L.best_run(spark, artifacts.runs)
    model = best.select(F.lit("model").alias("kind"), F.col("model").alias("name"), F.lit(None).cast("double").alias("value"))
    metrics = best.select(F.lit("metric").alias("kind"), F.explode("metrics").alias("name", "value"))
    feats = spark.createDataFrame([("feature", f, float(i)) for i, f in enumerate(ALL_FEATURES)],
                                  "kind string, name string, value double")
    own = best.first()["params"].get("dictionary")
    d = FE.vocabulary(spark, FE.load_dictionary(spark, own or artifacts.dictionary))
    known = d.select("kind", F.col("value").alias("name"), F.lit(None).cast("double").alias("value"))
    return model.unionByName(metrics).unionByName(feats).unionByName(known)


def start_drift_stream(spark: SparkSession, log_path: str, out_path: str, checkpoint: str,
                       trigger_seconds: int | None = 60):
    """Continuous drift: the (date-partitioned) inference log as a stream ->
    7-day windows sliding by a day -> appended once the watermark closes them."""
    from tarmac.schema import INFERENCE_LOG_SCHEMA
    from pyspark.sql import types as T
    schema = T.StructType(INFERENCE_LOG_SCHEMA.fields + [T.StructField("log_date", T.DateType())])
    windows = ST.drift_windows(ST.read_stream(spark, log_path, schema))
    w = (windows.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", out_path))
    w = w.trigger(processingTime=f"{trigger_seconds} seconds") if trigger_seconds else w.trigger(availableNow=True)
    return w.start()
