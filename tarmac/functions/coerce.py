"""Missing-value and number rules, fixed once for the whole library.

1. NaN becomes NULL at coercion; later code only sees NULL.
2. Casting text never fails the job (``try_cast`` / ``try_to_timestamp``).
3. Text is a number only if it is written as a plain decimal or scientific
   number (or inf / nan); Spark's cast would also accept ``12d``, ``12f`` and
   hexadecimal floats, which a CSV reader treats as missing.
4. Dates are parsed by an explicit, ordered list of formats, so the result of a
   row never depends on other rows.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.schema import NA_STRINGS

# A number as a CSV reader accepts it: sign, digits with an optional fraction,
# optional exponent; or inf / infinity / nan in any case. Surrounding white
# space is allowed.
NUMBER_PATTERN = (r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
                  r"|(?i:inf|infinity|nan))\s*$")

# Tried in this order; the first that fits the whole text wins.
DEFAULT_DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",
                        "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][XXX]",
                        "M/d/yyyy", "M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "yyyyMMdd")


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def na_text_to_null(c: Column) -> Column:
    """Map the CSV missing markers to NULL."""
    return F.when(c.isin(*NA_STRINGS), F.lit(None).cast("string")).otherwise(c)


def to_double(c: Column, dtype: T.DataType) -> Column:
    """Coerce a column of any type to DOUBLE; bad text -> NULL, NaN -> NULL."""
    if isinstance(dtype, T.StringType):
        text = na_text_to_null(c)
        num = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
        return nan_to_null(num)
    if isinstance(dtype, T.BooleanType):
        # a CSV reader turns True/False into booleans, which to_numeric keeps
        return c.cast("double")
    if isinstance(dtype, (T.NumericType,)):
        return nan_to_null(c.cast("double"))
    return nan_to_null(c.try_cast("double"))


def to_int(c: Column, dtype: T.DataType) -> Column:
    """Coerce to INT: non-integral or bad values -> NULL."""
    d = to_double(c, dtype)
    return F.when((d == F.floor(d)) & (F.abs(d) <= F.lit(2147483647.0)),
                  d.cast("int"))


def to_date(c: Column, dtype: T.DataType,
            formats: Iterable[str] = DEFAULT_DATE_FORMATS) -> Column:
    """Coerce to DATE; a value no format parses -> NULL."""
    if isinstance(dtype, (T.DateType,)):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    text = F.trim(na_text_to_null(c.cast("string")))
    parsed = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*parsed).cast("date")


def coerce_columns(df: DataFrame, numeric: Iterable[str], date_col: str | None = None,
                   formats: Iterable[str] = DEFAULT_DATE_FORMATS) -> DataFrame:
    """Coerce the listed columns that exist; keep column order."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = set(numeric)
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name in numeric:
            out.append(to_double(c, types[name]).alias(name))
        elif date_col is not None and name == date_col:
            out.append(to_date(c, types[name], formats).alias(name))
        else:
            out.append(c)
    return df.select(*out)
