"""Dictionary lookups as joins, broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.schema import CARRIER_NAMES

# A dimension up to this many rows is shipped to every task (a few MB);
# beyond it the lookup is a shuffle join, which AQE can split when the fact
# side has a hot key.
BROADCAST_MAX_ROWS = 200_000


def lookup_join(fact: DataFrame, dim: DataFrame, on, how: str = "left",
                dim_rows: int | None = None,
                max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join ``fact`` to a dimension; broadcast it only if its row count (given,
    or counted here — dimensions are small) is within the bound."""
    n = dim.count() if dim_rows is None else dim_rows
    side = F.broadcast(dim) if n <= max_broadcast_rows else dim
    return fact.join(side, on, how)


def carrier_dim(spark) -> DataFrame:
    return spark.createDataFrame(CARRIER_NAMES, "carrier_code string, carrier_name string")


def with_carrier_name(df: DataFrame, code_col: str = "OP_CARRIER",
                      out_col: str = "carrier_name") -> DataFrame:
    """Code -> carrier name; an unknown code stands for itself."""
    dim = carrier_dim(df.sparkSession).withColumnRenamed("carrier_name", "_name")
    joined = lookup_join(df, dim, F.col(code_col) == F.col("carrier_code"),
                         dim_rows=len(CARRIER_NAMES))
    return joined.withColumn(out_col, F.coalesce(F.col("_name"), F.col(code_col))) \
                 .drop("carrier_code", "_name")
