"""Scoring-request validation and normalisation.

A request table is checked row by row: normalised codes, defaults for absent
optional values, and a ``reject_reason`` listing every failed rule ('' when
valid). Bad rows are kept apart instead of failing the whole batch.

Only an absent or empty optional value takes its default. A value that is
there but is no finite number (NaN, infinity, other text) rejects its row.
Whole-number fields drop their fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.coerce import na_text_to_null, to_double
from tarmac.functions.scalar import strip_upper

TEXT_FIELDS = ("airline", "origin", "destination")
# Field -> (required, whole number, low, high); None = no range rule.
NUMBER_FIELDS = {
    "distance": (True, False, None, None),
    "day_of_week": (True, True, 1, 7),
    "month": (True, True, 1, 12),
    "hour": (False, True, 0, 23),
    "departure_delay": (False, False, None, None),
}
DEFAULTS = {"departure_delay": 0.0, "hour": 12}
REQUIRED = (*TEXT_FIELDS, *(f for f, rule in NUMBER_FIELDS.items() if rule[0]))
MAX_INT = 2147483647.0


def _present(c: Column, dtype: T.DataType) -> Column:
    """A value was given (an empty or missing-marker text was not)."""
    if isinstance(dtype, T.StringType):
        text = na_text_to_null(F.trim(c))
        return text.isNotNull()
    return c.isNotNull()


def _number(c: Column, dtype: T.DataType, whole: bool) -> Column:
    """Finite number, fraction dropped if ``whole``; anything else NULL."""
    d = to_double(c, dtype)
    d = F.when(F.abs(d) < F.lit(float("inf")), d)
    return F.when(F.abs(d) <= F.lit(MAX_INT), d.cast("int")) if whole else d


def _checked(req: DataFrame, ranges: bool, codes) -> DataFrame:
    """Numbers are read once, in a projection of their own; rules and results
    refer to them."""
    types = {f.name: f.dataType for f in req.schema.fields}
    known = {*TEXT_FIELDS, *NUMBER_FIELDS}
    given = [f for f in NUMBER_FIELDS if f in types]
    values = {f: f"_value_{f}" for f in given}
    read = req.withColumns({values[f]: _number(F.col(f), types[f], NUMBER_FIELDS[f][1]) for f in given})
    numbers, reasons = {}, [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in TEXT_FIELDS]
    for field, (required, _, low, high) in NUMBER_FIELDS.items():
        if field not in types:
            numbers[field] = F.lit(DEFAULTS[field])
            continue
        value, present = F.col(values[field]), _present(F.col(field), types[field])
        bad = F.when(present & value.isNull(), F.lit(f"{field}: not a number"))
        if required:
            bad = F.when(~present, F.lit(f"{field}: missing")).otherwise(bad)
        if ranges and low is not None:
            bad = F.coalesce(bad, F.when(~value.between(low, high), F.lit(f"{field}: out of range")))
        reasons.append(bad)
        numbers[field] = F.coalesce(value, F.lit(DEFAULTS[field])) if field in DEFAULTS else value
    return read.select(
        *[c for c in req.columns if c not in known],
        *[codes(F.col(c)).alias(c) for c in TEXT_FIELDS],
        *[v.cast("int" if NUMBER_FIELDS[f][1] else "double").alias(f) for f, v in numbers.items()],
        F.concat_ws(";", *reasons).alias("reject_reason"),
    ).withColumn("is_valid", F.col("reject_reason") == F.lit(""))


def validate_requests(req: DataFrame) -> DataFrame:
    """Normalise and validate; adds ``reject_reason`` and ``is_valid``."""
    return _checked(req, True, strip_upper)


def batch_requests(raw: DataFrame) -> DataFrame:
    """Batch upload (all text columns): required airline, origin, destination,
    distance, day_of_week, month; absent departure_delay -> 0, absent hour -> 12;
    codes upper-cased; numbers coerced. A required value that is missing, or any
    value that is no number, rejects only its own row."""
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"upload lacks required columns {missing}")
    return _checked(raw, False, lambda c: F.upper(c.cast("string")))
