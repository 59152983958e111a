"""Feature operators: calendar/distance flags, category dictionary, feature
matrix. Train-time and score-time features run through the same code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tarmac.functions.scalar import distance_bucket, is_peak_hour, is_weekend, season
from tarmac.operators.lookup import BROADCAST_MAX_ROWS, lookup_join
from tarmac.schema import (ALL_FEATURES, ENCODED_COLUMNS, FALLBACK_AIRLINES,
                           FALLBACK_AIRPORTS, MISSING_CATEGORY)
from tarmac.session import work_dir

# Integer-valued features (the rest are doubles).
INT_FEATURES = {"HOUR", "DAY_OF_WEEK", "MONTH", "DIST_BUCKET", "IS_WEEKEND",
                "IS_PEAK_HOUR", "SEASON", "AIRLINE_ENC", "ORIGIN_ENC", "DEST_ENC"}

# Leading characters that group dictionary values for the ranking.
HEAD_CHARS = 4


def engineer(df: DataFrame) -> DataFrame:
    """DIST_BUCKET, IS_WEEKEND, IS_PEAK_HOUR, SEASON; HOUR and DEP_DELAY filled."""
    cols = set(df.columns)
    hour = F.col("HOUR") if "HOUR" in cols else F.lit(None).cast("int")
    new = {
        "DIST_BUCKET": distance_bucket(F.col("DISTANCE")),
        "IS_WEEKEND": is_weekend(F.col("DAY_OF_WEEK")),
        # the peak flag reads HOUR before it is filled: a missing hour is not peak
        "IS_PEAK_HOUR": is_peak_hour(hour),
        "SEASON": season(F.col("MONTH")),
        "HOUR": F.coalesce(hour, F.lit(12)).cast("int"),
    }
    if "DEP_DELAY" in cols:
        new["DEP_DELAY"] = F.coalesce(F.col("DEP_DELAY"), F.lit(0.0))
    return df.withColumns(new)


def category_text(c) -> F.Column:
    """A category as dictionary text; a missing value is its own class."""
    return F.coalesce(c.cast("string"), F.lit(MISSING_CATEGORY))


@dataclass
class Dictionary:
    """Category dictionary: rows (column_name, value, code), codes in
    code-point order of the value per column."""
    table: DataFrame
    n_rows: int
    columns: tuple[str, ...]

    def for_column(self, name: str) -> DataFrame:
        return self.table.where(F.col("column_name") == name).select("value", "code")

    def values(self, name: str) -> DataFrame:
        return self.for_column(name).orderBy("value").select("value")


def fit_dictionary(df: DataFrame) -> Dictionary:
    """Distinct values of OP_CARRIER / ORIGIN / DEST -> codes 0..n-1, for any
    number of values.

    Distinct runs with map-side partial aggregation, so a hot category costs
    nothing extra. The values of a column are ranked in two levels: counts per
    first characters, an offset from the preceding ones, and a window among
    the values that share them; so a column with very many values is not
    sorted by one task."""
    present = [c for c, _ in ENCODED_COLUMNS if c in df.columns]
    spark = df.sparkSession
    if not present:
        empty = spark.createDataFrame([], "column_name string, value string, code int")
        return Dictionary(empty, 0, ())
    # one scan: each row yields its (column, value) pairs; distinct runs with
    # map-side partial aggregation before the shuffle
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), category_text(F.col(c)).alias("value"))
                      for c in present])
    distinct = df.select(F.explode(pairs).alias("kv")).select("kv.column_name", "kv.value").distinct()
    distinct = distinct.withColumn("head", F.substring("value", 1, HEAD_CHARS))
    heads = distinct.groupBy("column_name", "head").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("column_name").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("column_name", "head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("column_name", "head").orderBy("value")
    table = (distinct.withColumn("pos", F.row_number().over(inside)).join(heads, ["column_name", "head"])
             .select("column_name", "value", (F.col("offset") + F.col("pos") - 1).cast("int").alias("code")))
    # ranked and written once; the count, the lookups and the caller read the stored table
    path = work_dir(spark, "dictionary")
    table.write.parquet(path)
    stored = spark.read.schema(table.schema).parquet(path)
    return Dictionary(stored, stored.count(), tuple(present))


def encode(df: DataFrame, dictionary: Dictionary | None,
           max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Category -> code; unseen value or absent column -> 0."""
    out = df
    for col, enc in ENCODED_COLUMNS:
        if dictionary is None or col not in df.columns or col not in dictionary.columns:
            out = out.withColumn(enc, F.lit(0))
            continue
        dim = dictionary.for_column(col).withColumnRenamed("value", "_v").withColumnRenamed("code", "_c")
        out = lookup_join(out.withColumn("_k", category_text(F.col(col))), dim,
                          F.col("_k") == F.col("_v"), dim_rows=dictionary.n_rows,
                          max_broadcast_rows=max_broadcast_rows)
        out = out.withColumn(enc, F.coalesce(F.col("_c"), F.lit(0)).cast("int")).drop("_k", "_v", "_c")
    return out


def decode(df: DataFrame, dictionary: Dictionary,
           max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Codes back to category text (the inverse of ``encode`` on known
    values): adds ``<column>_DECODED`` for each encoded column present."""
    out = df
    for col, enc in ENCODED_COLUMNS:
        if enc not in df.columns or col not in dictionary.columns:
            continue
        dim = dictionary.for_column(col).select(F.col("code").alias("_c"), F.col("value").alias("_v"))
        out = lookup_join(out, dim, F.col(enc) == F.col("_c"), dim_rows=dictionary.n_rows,
                          max_broadcast_rows=max_broadcast_rows)
        out = out.withColumnRenamed("_v", f"{col}_DECODED").drop("_c")
    return out


def feature_columns(df: DataFrame, keep=()) -> DataFrame:
    """The 12 features in fixed order (absent -> 0), plus ``keep`` columns."""
    cols = set(df.columns)
    sel = [F.col(k) for k in keep]
    for f in ALL_FEATURES:
        c = F.col(f) if f in cols else F.lit(0)
        sel.append(c.cast("int" if f in INT_FEATURES else "double").alias(f))
    return df.select(*sel)


def complete_rows_expr():
    """Predicate: every feature known (MONTH is NULL for a bad date)."""
    cond = None
    for f in ALL_FEATURES:
        c = F.col(f).isNotNull()
        cond = c if cond is None else cond & c
    return cond


def feature_stats(features: DataFrame, label_col: str = "is_delayed") -> DataFrame:
    """Rows, feature count, positive rate, rows rejected for a missing feature."""
    ok = complete_rows_expr()
    return features.agg(
        F.count(F.when(ok, 1)).alias("n_rows"),
        F.lit(len(ALL_FEATURES)).alias("n_features"),
        F.try_divide(F.sum(F.when(ok, F.col(label_col))).cast("double"),
                     F.count(F.when(ok, 1))).alias("positive_rate"),
        F.count(F.when(~ok, 1)).alias("rejected_rows"),
    )


def build_features(cleaned: DataFrame, dictionary: Dictionary | None = None):
    """engineer -> fit (unless given) -> encode -> fixed feature columns.
    Returns (table with features and the scalar columns, dictionary)."""
    eng = engineer(cleaned)
    d = dictionary if dictionary is not None else fit_dictionary(eng)
    return encode(eng, d), d


def vocabulary(spark: SparkSession, dictionary: Dictionary | None) -> DataFrame:
    """Known airlines and airports, sorted; fixed fallbacks without a dictionary."""
    if dictionary is None or not dictionary.columns:
        rows = [("airline", v) for v in FALLBACK_AIRLINES] + \
               [("airport", v) for v in FALLBACK_AIRPORTS]
        return spark.createDataFrame(rows, "kind string, value string")
    t = dictionary.table
    return t.where(F.col("column_name").isin("OP_CARRIER", "ORIGIN")).select(
        F.when(F.col("column_name") == "OP_CARRIER", "airline").otherwise("airport").alias("kind"),
        "value").orderBy("kind", "value")


def request_record(req: DataFrame) -> DataFrame:
    """Validated requests -> the flight record a model scores (score-time
    features: no cleaning filter, HOUR given, DEP_TIME = hour*100)."""
    keep = [c for c in req.columns if c not in
            {"airline", "origin", "destination", "departure_delay", "distance",
             "day_of_week", "month", "hour"}]
    return req.select(
        *keep,
        F.col("airline").alias("OP_CARRIER"),
        F.col("origin").alias("ORIGIN"),
        F.col("destination").alias("DEST"),
        F.col("departure_delay").cast("double").alias("DEP_DELAY"),
        F.col("distance").cast("double").alias("DISTANCE"),
        F.col("day_of_week").cast("int").alias("DAY_OF_WEEK"),
        F.col("month").cast("int").alias("MONTH"),
        F.col("hour").cast("int").alias("HOUR"),
        (F.col("hour") * 100).cast("double").alias("DEP_TIME"),
    )


def score_features(req: DataFrame, dictionary: Dictionary | None) -> DataFrame:
    """Score-time feature pipeline on any number of request rows."""
    return encode(engineer(request_record(req)), dictionary)


def save_dictionary(dictionary: Dictionary, path: str) -> str:
    """Persist the dictionary as a small parquet table."""
    dictionary.table.write.mode("overwrite").parquet(path)
    return path


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    table = spark.read.parquet(path)
    cols = tuple(sorted({r[0] for r in table.select("column_name").distinct().collect()}))  # <= 3 rows
    return Dictionary(table, table.count(), cols)
