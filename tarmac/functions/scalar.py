"""Row-level expressions of the data model, all JVM-side (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.schema import DAY_NAMES, MONTH_NAMES

# Fixed values of the data model.
# Distance bucket edges: (0,250] -> 0, (250,500] -> 1, ..., (2000,6000] -> 5.
# Anything else (<= 0, > 6000, missing) falls in the default bucket 2.
DISTANCE_EDGES = [0, 250, 500, 1000, 1500, 2000, 6000]
DISTANCE_DEFAULT_BUCKET = 2

# Rush hours, both ends inclusive.
PEAK_HOURS = [(6, 9), (16, 20)]


def distance_bucket(distance: Column) -> Column:
    """Right-closed intervals (pandas ``cut``); not ``Bucketizer``, which is
    left-closed."""
    expr = None
    for i in range(len(DISTANCE_EDGES) - 1):
        lo, hi = DISTANCE_EDGES[i], DISTANCE_EDGES[i + 1]
        cond = (distance > lo) & (distance <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(DISTANCE_DEFAULT_BUCKET))


def is_weekend(day_of_week: Column) -> Column:
    return F.coalesce(day_of_week.isin(6, 7), F.lit(False)).cast("int")


def is_peak_hour(hour: Column) -> Column:
    cond = None
    for lo, hi in PEAK_HOURS:
        c = hour.between(lo, hi)
        cond = c if cond is None else (cond | c)
    return F.coalesce(cond, F.lit(False)).cast("int")


def season(month: Column) -> Column:
    """Winter 0 (December to February), spring 1, summer 2, autumn 3; winter
    for anything that is no month."""
    quarter = F.floor(month % 12 / F.lit(3)).cast("int")
    return F.when(month.between(1, 12), quarter).otherwise(F.lit(0))


def hour_from_dep_time(dep_time: Column) -> Column:
    """HHMM -> hour: floor(t / 100) clipped to 0..23; missing or infinite -> 12.

    The fill comes before the clip: ``greatest``/``least`` skip NULLs.
    """
    h = F.floor(dep_time / F.lit(100.0))
    bad = dep_time.isNull() | F.isnan(dep_time) | (F.abs(dep_time) == F.lit(float("inf")))
    return F.when(bad, F.lit(12)).otherwise(
        F.least(F.greatest(h, F.lit(0)), F.lit(23))).cast("int")


def iso_weekday(date: Column) -> Column:
    """Monday = 1 ... Sunday = 7 (``dayofweek`` would give Sunday = 1)."""
    return (F.weekday(date) + F.lit(1)).cast("int")


def day_name(day: Column) -> Column:
    return F.when(day.between(1, 7), F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), day))


def month_name(month: Column) -> Column:
    return F.when(month.between(1, 12), F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), month))


def day_number(name: Column) -> Column:
    """Inverse of ``day_name``: the first day whose name occurs in the text."""
    expr = None
    for i, n in enumerate(DAY_NAMES, start=1):
        cond = F.instr(name, n) > 0
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def month_number(name: Column) -> Column:
    expr = None
    for i, n in enumerate(MONTH_NAMES, start=1):
        cond = F.instr(name, n) > 0
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def route(origin: Column, dest: Column, sep: str = "→") -> Column:
    """``ORIGIN→DEST``; NULL if either end is missing."""
    return F.concat(origin, F.lit(sep), dest)


def percent_text(p: Column) -> Column:
    """0.4567 -> '45.7%'. Rounds half up on the decimal value of p*100."""
    return F.format_string("%.1f%%", F.round(p * F.lit(100.0), 1))


def percent_value(text: Column) -> Column:
    """'45.7%' -> 0.457."""
    return F.regexp_replace(text, "%", "").try_cast("double") / F.lit(100.0)


def airline_code_from_label(label: Column) -> Column:
    """'AA — American Airlines' -> 'AA'."""
    return F.trim(F.split(label, " — ").getItem(0))


def strip_upper(c: Column) -> Column:
    """Upper case after removing leading/trailing white space of any kind
    (``trim`` only removes spaces)."""
    return F.upper(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
