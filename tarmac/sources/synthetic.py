"""Synthetic flight generator.

Every random draw is a hash of (seed, column, row id) — never ``rand()`` or
row order — so a row's values do not depend on partitioning and the table
can be generated in parallel from any id column (``spark.range`` or the ids
of an existing table). Distributions: departure delay is a mixture of a
normal (on time) and a shifted exponential (late); arrival follows departure
plus noise; distance, hour and carrier are weighted choices; airports are
uniform, with the destination drawn from the other airports.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.schema import (AIRPORTS, CARRIER_NAMES, CARRIER_WEIGHTS, DISTANCE_CENTRES,
                           DISTANCE_WEIGHTS, HOUR_WEIGHTS)

# ---------------------------------------------------------------------------
# Distribution parameters.
# ---------------------------------------------------------------------------
ON_TIME_SHARE = 0.75
ON_TIME_MEAN, ON_TIME_SD = -2.0, 8.0
LATE_SCALE, LATE_SHIFT = 25.0, 15.0
DEP_CLIP = (-30.0, 300.0)
ARR_FACTOR, ARR_NOISE_SD = 0.85, 10.0
ARR_CLIP = (-60.0, 360.0)
DISTANCE_NOISE_SD = 50.0
DISTANCE_CLIP = (50.0, 5000.0)
FIRST_HOUR = 5
START_DATE = "2023-01-01"
# cause column -> (probability of a delay of that type, exponential scale)
CAUSES = {
    "WEATHER_DELAY": (0.08, 15.0),
    "CARRIER_DELAY": (0.12, 20.0),
    "NAS_DELAY": (0.10, 12.0),
    "SECURITY_DELAY": (0.01, 5.0),
    "LATE_AIRCRAFT_DELAY": (0.15, 18.0),
}

_MASK53 = (1 << 53) - 1


def uniform(seed: int, name: str, id_col: Column) -> Column:
    """U[0,1) from a 64-bit hash of (seed, name, id)."""
    h = F.xxhash64(F.lit(seed), F.lit(name), id_col)
    return F.shiftright(h, 11).bitwiseAND(F.lit(_MASK53)).cast("double") / F.lit(float(1 << 53))


def normal(seed: int, name: str, id_col: Column, mean: float, sd: float) -> Column:
    """Box-Muller on two hashed uniforms."""
    u1 = F.lit(1.0) - uniform(seed, name + ".u1", id_col)   # (0, 1]
    u2 = uniform(seed, name + ".u2", id_col)
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
    return F.lit(mean) + F.lit(sd) * z


def exponential(seed: int, name: str, id_col: Column, scale: float) -> Column:
    return F.lit(-scale) * F.log(F.lit(1.0) - uniform(seed, name, id_col))


def weighted_choice(u: Column, values: list, weights: list[float]) -> Column:
    """Inverse CDF of a discrete distribution as a CASE over cumulative weights."""
    total = float(sum(weights))
    acc, expr = 0.0, None
    for v, w in zip(values[:-1], weights[:-1]):
        acc += w / total
        expr = F.when(u < F.lit(acc), F.lit(v)) if expr is None else expr.when(u < F.lit(acc), F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def generate_from_ids(ids: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """One synthetic raw flight per row of ``ids``."""
    i = F.col(id_col)
    dep = F.when(uniform(seed, "mix", i) < F.lit(ON_TIME_SHARE), normal(seed, "dep", i, ON_TIME_MEAN, ON_TIME_SD)) \
           .otherwise(exponential(seed, "late", i, LATE_SCALE) + F.lit(LATE_SHIFT))
    dep = F.round(_clip(dep, *DEP_CLIP), 1)
    arr = F.round(_clip(F.lit(ARR_FACTOR) * dep + normal(seed, "arr", i, 0.0, ARR_NOISE_SD), *ARR_CLIP), 1)
    centre = weighted_choice(uniform(seed, "dist", i), DISTANCE_CENTRES, DISTANCE_WEIGHTS)
    dist = F.round(_clip(centre + normal(seed, "dist.noise", i, 0.0, DISTANCE_NOISE_SD), *DISTANCE_CLIP), 0)
    hours = list(range(FIRST_HOUR, FIRST_HOUR + len(HOUR_WEIGHTS)))
    hour = weighted_choice(uniform(seed, "hour", i), hours, HOUR_WEIGHTS)
    minute = F.floor(uniform(seed, "minute", i) * 60).cast("int")
    n_ap = len(AIRPORTS)
    o_idx = F.floor(uniform(seed, "origin", i) * n_ap).cast("int")
    # destination: one of the other airports, uniformly
    d_off = F.floor(uniform(seed, "dest", i) * (n_ap - 1)).cast("int") + 1
    d_idx = (o_idx + d_off) % n_ap
    airports = F.array(*[F.lit(a) for a in AIRPORTS])
    carriers = [c for c, _ in CARRIER_NAMES]
    cols = {
        "FL_DATE": F.date_add(F.lit(START_DATE).cast("date"), (i / 1440).cast("int")),
        "OP_CARRIER": weighted_choice(uniform(seed, "carrier", i), carriers, CARRIER_WEIGHTS),
        "ORIGIN": F.element_at(airports, o_idx + 1),
        "DEST": F.element_at(airports, d_idx + 1),
        "DEP_TIME": (hour * 100 + minute).cast("int"),
        "DEP_DELAY": dep,
        "ARR_DELAY": arr,
        "DISTANCE": dist,
        "DAY_OF_WEEK": (F.floor(uniform(seed, "dow", i) * 7) + 1).cast("int"),
    }
    for name, (p, scale) in CAUSES.items():
        cols[name] = F.when(uniform(seed, name + ".hit", i) < F.lit(p),
                            F.round(exponential(seed, name, i, scale), 1)).otherwise(F.lit(0.0))
    return ids.select(i.alias("flight_id"), *[c.alias(n) for n, c in cols.items()])


def generate(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``n`` synthetic raw flights."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return generate_from_ids(ids, "id", seed)
