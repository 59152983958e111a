"""Schemas, feature order and the fixed domain values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must stay exactly as listed (names, order, spelling).
# ---------------------------------------------------------------------------

# Columns of a raw on-time record, in file order.
RAW_COLUMNS = [
    "FL_DATE", "OP_CARRIER", "ORIGIN", "DEST",
    "DEP_TIME", "DEP_DELAY", "ARR_DELAY",
    "DISTANCE", "DAY_OF_WEEK",
    "WEATHER_DELAY", "CARRIER_DELAY", "NAS_DELAY",
    "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY",
]

# Columns coerced to numbers by cleaning.
NUMERIC_COLUMNS = [
    "DEP_DELAY", "ARR_DELAY", "DISTANCE", "DEP_TIME",
    "WEATHER_DELAY", "CARRIER_DELAY", "NAS_DELAY",
    "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY",
]

# Delay-cause columns; missing means "no delay of that type".
CAUSE_COLUMNS = [
    "WEATHER_DELAY", "CARRIER_DELAY", "NAS_DELAY",
    "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY",
]

# Model features, in the fixed order of the feature vector.
ALL_FEATURES = [
    "DEP_DELAY", "DISTANCE", "HOUR",
    "DAY_OF_WEEK", "MONTH", "DIST_BUCKET", "IS_WEEKEND", "IS_PEAK_HOUR", "SEASON",
    "AIRLINE_ENC", "ORIGIN_ENC", "DEST_ENC",
]

# Category column -> encoded feature column.
ENCODED_COLUMNS = [("OP_CARRIER", "AIRLINE_ENC"), ("ORIGIN", "ORIGIN_ENC"),
                   ("DEST", "DEST_ENC")]

# Carrier code -> carrier name.
CARRIER_NAMES = [
    ("AA", "American Airlines"),
    ("DL", "Delta Air Lines"),
    ("UA", "United Airlines"),
    ("WN", "Southwest Airlines"),
    ("B6", "JetBlue Airways"),
    ("AS", "Alaska Airlines"),
    ("NK", "Spirit Airlines"),
    ("F9", "Frontier Airlines"),
    ("G4", "Allegiant Air"),
    ("HA", "Hawaiian Airlines"),
    ("9E", "Endeavor Air"),
    ("MQ", "Envoy Air"),
    ("OH", "PSA Airlines"),
    ("OO", "SkyWest Airlines"),
    ("YX", "Republic Airways"),
    ("YV", "Mesa Airlines"),
]

# Carrier shares used by the synthetic generator (same order as CARRIER_NAMES).
CARRIER_WEIGHTS = [0.15, 0.14, 0.12, 0.13, 0.06, 0.05, 0.05, 0.04,
                   0.03, 0.03, 0.04, 0.04, 0.04, 0.04, 0.02, 0.02]

# Airports of the synthetic generator.
AIRPORTS = ["ATL", "ORD", "DFW", "DEN", "LAX", "CLT", "LAS", "PHX",
            "MCO", "SEA", "MSP", "DTW", "BOS", "EWR", "JFK", "SFO",
            "LGA", "FLL", "IAD", "IAH", "MIA", "MDW", "PHL", "BWI", "SLC"]

# Route distance centres and their probabilities (synthetic generator).
DISTANCE_CENTRES = [150, 300, 500, 750, 1000, 1200, 1500, 2000, 2500]
DISTANCE_WEIGHTS = [0.08, 0.15, 0.20, 0.18, 0.15, 0.10, 0.07, 0.05, 0.02]

# Departure hours 5..23 and their (unnormalised) weights (synthetic generator).
HOUR_WEIGHTS = [0.04, 0.06, 0.08, 0.09, 0.09, 0.08, 0.07, 0.06,
                0.05, 0.05, 0.05, 0.05, 0.05, 0.04, 0.04, 0.04, 0.04, 0.03, 0.02]

# Vocabulary fallbacks when no dictionary has been fitted.
FALLBACK_AIRLINES = ["AA", "DL", "UA", "WN", "B6", "AS", "NK", "F9"]
FALLBACK_AIRPORTS = ["ATL", "ORD", "DFW", "LAX", "JFK", "SFO", "SEA", "DEN"]

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
             "Saturday", "Sunday"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]

# Text values a CSV reader treats as missing (pandas defaults).
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN",
              "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
              "None", "n/a", "nan", "null"]

# Spelling of a missing category when it is encoded as a class.
MISSING_CATEGORY = "nan"

# Prediction labels.
DELAYED = "Delayed"
ON_TIME = "On Time"

# Default thresholds of the data model.
DELAY_THRESHOLD = 15
ARR_DELAY_LOW = -120
ARR_DELAY_HIGH = 600
DRIFT_BASELINE = 0.22
DRIFT_THRESHOLD = 0.1
DRIFT_WINDOW_DAYS = 7
DRIFT_MIN_ROWS = 50
HIGH_RISK_PROBABILITY = 0.7

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

REQUEST_SCHEMA = T.StructType([
    T.StructField("airline", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("departure_delay", T.DoubleType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("hour", T.IntegerType()),
])

INFERENCE_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("airline", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("probability", T.DoubleType()),
])
