"""Connected components by alternating large-star / small-star rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    mins = e.groupBy("u").agg(F.min("v").alias("m"))
    links = e.join(mins, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.union(mins.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", vertices: DataFrame | None = None,
                         max_rounds: int = 60) -> DataFrame:
    """(node, component) with component = smallest node id.  Chains of length n settle in O(log n) rounds; each round is
    written to the checkpoint folder, so lineage stays flat and lost executors replay one round at most.  A hub is never
    gathered: minima are pre-aggregated and the join back to its edges is one that AQE can split."""
    e = edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut_lineage(e)
    marks = lambda e: tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 52)).cast("decimal(38,0)"))).first())
    state = marks(e)  # links that are stars already settle in one round
    for _ in range(max_rounds):
        e = cut_lineage(_small_star(_large_star(e)))
        seen = marks(e)
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = out.union(roots)
    if vertices is None:
        return out
    alone = vertices.select(F.col(vertices.columns[0]).alias("node")).distinct().join(out, "node", "left_anti")
    return out.union(alone.select("node", F.col("node").alias("component")))
