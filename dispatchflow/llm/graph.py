"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """node, root for every node of ``edges`` (a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn, each table in the shared folder, until the edges stay the same.
    Edges of a node with itself and edges with a null end are left out. Node types must be ordered.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        purpose,
    )
    before = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("low"))
        least = least.select("at", F.least("low", "at").alias("m"))
        upward = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = _relinked(upward.join(least, F.col("u") == F.col("at"))).distinct()
        lowest = large.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
        small = _relinked(large.join(lowest, F.col("u") == F.col("at")).where("v <> m"))
        small = small.unionByName(lowest.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct()
        now = stored(small, purpose)


def _relinked(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("v").alias("u"), F.col("m").alias("v"))
