"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

SALTS = 8


def _least(pairs: DataFrame) -> DataFrame:
    """Each u with the smallest of itself and its v, repeated per salt: one u may have a third of all pairs."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_least(pairs: DataFrame) -> DataFrame:
    """Both sides grow with the nodes, so they meet by a shuffle."""
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(_least(pairs).hint("shuffle_merge"), ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down)
    out = moved.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge to another node do not appear.

    Each round's table replaces the one before, which is deleted once the next is whole.
    """
    spark = edges.sparkSession
    now, at = written(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        now, then = written(_small_star(_large_star(now)), "edges")
        discard(spark, at)
        at = then
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(ends.select(F.col("component").alias("node"), "component")).distinct()
