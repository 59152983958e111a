"""Connected components of an edge table, with Spark joins only.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"): every round replaces the edges by edges
towards the smallest known neighbour until nothing changes. Each round is
written to the shared folder, so the lineage stays short and a lost executor
costs one round at most. The minima are map-side combined and joined back, so
adaptive execution can split the join partition of a star's centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarmac.llm.common import materialise


def _stats(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum((F.xxhash64("u", "v") % F.lit(1 << 40)).cast("decimal(20,0)")).alias("h")).first()
    return int(r["n"]), int(r["h"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; ``component`` is the
    smallest node reachable. ``edges``: long columns src and dst, in any
    direction, repeats and self-loops allowed; rows with a NULL end are not
    edges. Nodes without edges do not appear."""
    cur = materialise(
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "edges")
    seen = _stats(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        cur = materialise(small, "edges")
        now = _stats(cur)
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
