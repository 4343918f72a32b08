"""Connected components over an edge table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a, b: long); component is its smallest vertex.

    Alternates large-star and small-star steps until no edge changes. Each step is
    a minimum by vertex (partially aggregated) and a join; tables are written in
    the shared folder, so lineage stays short.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()

    def saved(df: DataFrame, at: str) -> tuple[DataFrame, tuple]:
        """The table, and a mark of its rows that is taken while they are written."""
        seen = Observation()
        mark = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        df = scratch.save(df.observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("mark")), at)
        return df, (seen.get["n"], seen.get["mark"])

    e, was = saved(e, f"{name}-0")
    k = 0
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{name}-{k}l")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        e, now = saved(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}l", f"{name}-{k - 1}")
        if now == was:
            break
        was = now
    stars = e.select(F.col("u").alias("v"), F.col("v").alias("component"))
    return stars.unionByName(e.select("v", F.col("v").alias("component")).distinct())
