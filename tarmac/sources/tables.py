"""Reading the driver's tables and projecting them onto the flight data model.

The driver's tables hold no flights; ``events`` is projected onto the raw
flight schema (one flight per event, ``event_id`` as the key). The projection
keeps delays in integer hundredths until the final division so every engine
produces the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions.bands import decision
from tarmac.session import work_dir


# Carriers of the projected flights: known codes, a lower-case one and one that no lookup knows.
CARRIER_CYCLE = ("AA", "DL", "WN", "UA", "b6", "ZZ")

# Rows of one file of the stored flights.
FILE_ROWS = 250_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _every(n: int):
    return (F.col("event_id") % F.lit(n)) == F.lit(0)


def flights_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flights: flight_id, ts, FL_DATE, OP_CARRIER, ORIGIN, DEST, DEP_TIME,
    DEP_DELAY, ARR_DELAY, DISTANCE and the five delay-cause columns."""
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.regexp_extract("props", "([0-9]+)", 1).try_cast("int").alias("k"),
        F.round(F.col("value") * F.lit(100)).cast("bigint").alias("v100"),
    )
    k, v100 = F.col("k"), F.col("v100")
    hundredths = lambda c: c / F.lit(100.0)

    def cause(n):
        return F.when(_every(n), k.cast("double"))

    return ev.select(
        F.col("event_id").alias("flight_id"),
        F.col("ts"),
        F.when(~_every(103), F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 12 * 30).cast("int"))).alias("FL_DATE"),
        F.when(~_every(59), F.element_at(F.array(*[F.lit(c) for c in CARRIER_CYCLE]),
                                         (k % len(CARRIER_CYCLE) + 1).cast("int"))).alias("OP_CARRIER"),
        F.when(~_every(71), F.concat(F.lit("A"), (F.col("user_id") % 25).cast("string"))).alias("ORIGIN"),
        F.concat(F.lit("A"), (k % 25).cast("string")).alias("DEST"),
        F.when(~_every(97), F.hour("ts") * 100 + F.minute("ts")).alias("DEP_TIME"),
        F.when(~_every(89), hundredths(v100 - 2000)).alias("DEP_DELAY"),
        F.when(_every(53), F.lit(None).cast("double"))
         .when(_every(211), hundredths(v100 * 40))
         .otherwise(((v100 - 2000) * 85 + (k - 50) * 4000) / F.lit(10000.0)).alias("ARR_DELAY"),
        ((F.col("event_id") * 7919) % 6400 - 100).cast("double").alias("DISTANCE"),
        cause(10).alias("WEATHER_DELAY"),
        cause(8).alias("CARRIER_DELAY"),
        cause(9).alias("NAS_DELAY"),
        cause(101).alias("SECURITY_DELAY"),
        cause(7).alias("LATE_AIRCRAFT_DELAY"),
    )


def stored_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flights_raw`` projected once and read back, for queries that pass over
    the flights several times: a filter on a projected column goes to the scan
    instead of repeating the projection, and files of at most FILE_ROWS rows
    spread over the cores however few row groups the events have."""
    raw = flights_raw(spark, sf_dir)
    path = work_dir(spark, "flights")
    raw.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(raw.schema).parquet(path)


def rule_probability(dep_delay):
    """A model-free delay score: logistic in the departure delay, 4 places."""
    z = -(F.coalesce(dep_delay, F.lit(0.0)) - F.lit(15)) / F.lit(20)
    return F.round(F.lit(1) / (F.lit(1) + F.exp(z)), 4)


def flights_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights in range with a label and the rule score."""
    raw = flights_raw(spark, sf_dir)
    arr = F.col("ARR_DELAY")
    return raw.where((arr > -120) & (arr < 600)).select(
        "flight_id", "ts", "OP_CARRIER", "ORIGIN", "DEST", "DISTANCE",
        F.when(arr > 15, 1).otherwise(0).alias("label"),
        rule_probability(F.col("DEP_DELAY")).alias("probability"),
    )


def flights_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text inputs for the coercion operators."""
    raw = flights_raw(spark, sf_dir)
    fid = F.col("flight_id")
    m8 = fid % 8
    num_text = (F.when(m8 == 0, "1e3").when(m8 == 1, " 12 ").when(m8 == 2, "abc")
                .when(m8 == 3, "").when(m8 == 4, "NA").when(m8 == 5, "12d")
                .otherwise(fid.cast("string")))
    spell = lambda f: F.date_format(F.col("FL_DATE"), f)
    m7 = fid % 7
    date_text = (F.when(fid % 6 == 0, F.lit("2023-02-30")).when(m7 == 0, spell("M/d/yyyy h:mm:ss a"))
                 .when(m7 == 1, spell("M/d/yyyy")).when(m7 == 2, spell("yyyy-MM-dd HH:mm:ss.S"))
                 .when(m7 == 3, spell("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(m7 == 4, spell("yyyyMMdd"))
                 .otherwise(F.col("FL_DATE").cast("string")))
    return raw.select("flight_id", num_text.alias("num_text"), date_text.alias("date_text"))


def requests(spark: SparkSession, sf_dir: str, flights: DataFrame | None = None) -> DataFrame:
    """Scoring requests, including invalid rows (weekday 8-9, month 13-14,
    hour 24-25, NaN and missing numbers), airports never seen before, and
    lower-case, padded codes. ``flights``: the raw flights, if at hand."""
    raw = flights_raw(spark, sf_dir) if flights is None else flights
    fid = F.col("flight_id")
    return raw.select(
        fid,
        F.concat(F.lit(" "), F.lower("OP_CARRIER"), F.lit(" ")).alias("airline"),
        F.when(fid % 37 == 0, F.lit("xq1")).otherwise(F.lower("ORIGIN")).alias("origin"),
        F.when(fid % 39 == 0, F.lit("xq2")).otherwise(F.lower("DEST")).alias("destination"),
        F.when(fid % 5 == 0, F.lit(None).cast("double")).when(fid % 47 == 0, F.lit(float("nan")))
         .otherwise(F.col("DEP_DELAY")).alias("departure_delay"),
        F.when(fid % 41 == 0, F.lit(float("nan"))).when(fid % 43 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("DISTANCE")).alias("distance"),
        (F.lit(1) + fid % 9).cast("int").alias("day_of_week"),
        (F.lit(1) + fid % 14).cast("int").alias("month"),
        (fid % 26).cast("int").alias("hour"),
    )


def inference_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inference log as the scoring service writes it: one row per scored
    flight, stamped with the event time; some rows have no prediction."""
    s = flights_scored(spark, sf_dir)
    return s.select(
        "flight_id",
        F.col("ts").alias("timestamp"),
        F.col("OP_CARRIER").alias("airline"),
        F.col("ORIGIN").alias("origin"),
        F.col("DEST").alias("destination"),
        F.col("DISTANCE").alias("distance"),
        F.when(F.col("flight_id") % 61 != 0, decision(F.col("probability"))).alias("prediction"),
        F.col("probability"),
    )
