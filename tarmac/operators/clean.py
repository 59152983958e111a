"""Cleaning: coercion, target filters, fills, label and calendar columns.

``clean`` is one lazy projection/filter chain; Catalyst collapses it into a
single whole-stage-codegen span over the scan. Schema decisions ("if the
column exists") are taken at plan-build time and cost nothing at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.coerce import DEFAULT_DATE_FORMATS, coerce_columns, to_int
from tarmac.functions.scalar import hour_from_dep_time, iso_weekday
from tarmac.schema import (ARR_DELAY_HIGH, ARR_DELAY_LOW, CAUSE_COLUMNS,
                           DELAY_THRESHOLD, NUMERIC_COLUMNS)


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip white space around column names."""
    stripped = [c.strip() for c in df.columns]
    return df if stripped == df.columns else df.toDF(*stripped)


def coerce(df: DataFrame, formats=DEFAULT_DATE_FORMATS) -> DataFrame:
    """Header trim, date and numeric coercion (NaN -> NULL, bad text -> NULL)."""
    df = trim_headers(df)
    df = coerce_columns(df, NUMERIC_COLUMNS, "FL_DATE" if "FL_DATE" in df.columns else None, formats)
    if "DAY_OF_WEEK" in df.columns:
        dtype = df.schema["DAY_OF_WEEK"].dataType
        df = df.withColumn("DAY_OF_WEEK", to_int(F.col("DAY_OF_WEEK"), dtype))
    return df


def in_range(arr_delay, low=ARR_DELAY_LOW, high=ARR_DELAY_HIGH):
    """Known target inside the open interval (low, high)."""
    return arr_delay.isNotNull() & (arr_delay > F.lit(low)) & (arr_delay < F.lit(high))


def label(arr_delay, threshold=DELAY_THRESHOLD):
    """1 when the arrival delay is strictly above the threshold."""
    return (arr_delay > F.lit(threshold)).cast("int")


def derive(df: DataFrame, threshold=DELAY_THRESHOLD) -> DataFrame:
    """Fills, label, MONTH / DAY_OF_WEEK / HOUR on an already filtered table."""
    cols = set(df.columns)
    out = df
    fills = {c: 0.0 for c in CAUSE_COLUMNS if c in cols}
    if "DEP_DELAY" in cols:
        fills["DEP_DELAY"] = 0.0
    if fills:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})
    new = {"is_delayed": label(F.col("ARR_DELAY"), threshold)}
    if "FL_DATE" in cols:
        # MONTH is always taken from the date (NULL for a bad date)
        new["MONTH"] = F.month("FL_DATE").cast("int")
        if "DAY_OF_WEEK" not in cols:
            new["DAY_OF_WEEK"] = iso_weekday(F.col("FL_DATE"))
    elif "MONTH" not in cols:
        new["MONTH"] = F.lit(1)
    new["HOUR"] = hour_from_dep_time(F.col("DEP_TIME")) if "DEP_TIME" in cols else F.lit(12)
    return out.withColumns(new)


def clean(df: DataFrame, threshold=DELAY_THRESHOLD, formats=DEFAULT_DATE_FORMATS) -> DataFrame:
    """Raw flights -> cleaned flights with ``is_delayed``, ``MONTH``, ``HOUR``.

    On numeric input the target-range filter runs on the raw column, before
    coercion, so it reaches the Parquet scan as pushed filters; the result is
    the same (NaN sorts above every number, so ``NaN < high`` is false)."""
    df = trim_headers(df)
    if isinstance(df.schema["ARR_DELAY"].dataType, T.NumericType):
        return derive(coerce(df.where(in_range(F.col("ARR_DELAY"))), formats), threshold)
    typed = coerce(df, formats)
    kept = typed.where(in_range(F.col("ARR_DELAY")))
    return derive(kept, threshold)


def cleaning_report(df: DataFrame, threshold=DELAY_THRESHOLD, formats=DEFAULT_DATE_FORMATS) -> DataFrame:
    """One row: rows in, rows with a target, rows kept, removed, removed share,
    delay rate of the kept rows. One aggregation over the raw table."""
    typed = coerce(df, formats)
    arr = F.col("ARR_DELAY")
    keep = in_range(arr)
    agg = typed.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count(arr).alias("rows_with_target"),
        F.count(F.when(keep, 1)).alias("rows_kept"),
        F.count(F.when(keep & (arr > F.lit(threshold)), 1)).alias("delayed_kept"),
    )
    removed = F.col("rows_in") - F.col("rows_kept")
    return agg.select(
        "rows_in", "rows_with_target", "rows_kept",
        removed.alias("rows_removed"),
        F.try_divide(removed.cast("double"), F.col("rows_in")).alias("removed_share"),
        F.try_divide(F.col("delayed_kept").cast("double"), F.col("rows_kept")).alias("delay_rate"),
    )


def validate(df: DataFrame) -> DataFrame:
    """One row (ok, message) after ordered checks: required columns, non-empty,
    two classes. The schema check runs at plan-build time; the data checks are
    one aggregation."""
    spark = df.sparkSession
    # fixed values: the texts below are the result's
    for c in ["ARR_DELAY", "is_delayed", "DAY_OF_WEEK", "MONTH"]:
        if c not in df.columns:
            return spark.createDataFrame([(False, f"Missing required column: {c}")],
                                         "ok boolean, message string")
    stats = df.agg(F.count(F.lit(1)).alias("n"),
                   F.count_distinct("is_delayed").alias("classes"))
    n, k = F.col("n"), F.col("classes")
    return stats.select(
        ((n > 0) & (k >= 2)).alias("ok"),
        F.when(n == 0, F.lit("DataFrame is empty after cleaning"))
         .when(k < 2, F.lit("Target column has only one class — check data"))
         .otherwise(F.lit("Validation passed")).alias("message"),
    )


def data_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """Totals, delay rate, mean arrival delay, distinct carriers and routes.

    A route with a missing end is not a route. ``approx`` switches the
    distinct counts to HyperLogLog sketches (no exact-distinct shuffle)."""
    cols = set(df.columns)
    distinct = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    airlines = distinct(F.col("OP_CARRIER")) if "OP_CARRIER" in cols else F.lit(0)
    routes = (distinct(F.concat(F.col("ORIGIN"), F.lit("-"), F.col("DEST")))
              if {"ORIGIN", "DEST"} <= cols else F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.coalesce(F.sum("is_delayed"), F.lit(0)).cast("bigint").alias("delayed_flights"),
        F.avg("is_delayed").alias("delay_rate"),
        F.avg("ARR_DELAY").alias("avg_arr_delay"),
        airlines.cast("bigint").alias("airlines"),
        routes.cast("bigint").alias("routes"),
    )
