"""Connected components: of a table by alternating large-star and small-star rounds, and of arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (id, root): every vertex of an edge with the smallest vertex of its component. Loops and NULLs are dropped.

    Both rounds are one window each; the edge set is written to the shared checkpoint folder between rounds and never
    grows. Rounds end when the set no longer changes, after about log(longest path) of them.
    """
    now = materialise(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.union(now.select("v", "u"))
        low = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.withColumn("m", low).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # each u points only at smaller vertices here
        low = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", low).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = materialise(small.where(F.col("u") != F.col("v")).distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The roots of all rows after the pairs are linked; parent: roots before."""
    while True:
        u, v = parent[i], parent[j]
        apart = u != v
        if not apart.any():
            return parent
        i, j, u, v = i[apart], j[apart], u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
