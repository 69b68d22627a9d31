"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is one grouped minimum and one join; nothing but a count comes to
the driver. Each round is written to the shared folder, so a lost executor
costs the current round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import discard, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label): each node of an edge and the least node that it reaches. Nodes are long and not null."""
    now = written(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        old, now = now, written(_small(_large(now)).distinct(), "edges")
        discard(old)
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == before:
            break
        before = sign
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
