"""Connected components as alternating star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.storage import Passes


def _with_least(edges: DataFrame, parts: int) -> DataFrame:
    """Edges ``u, v`` with the least ``v`` of their ``u`` as ``low``.

    A hub's edges are dealt out by ``(u, hash of v)``, so no task holds them
    all: the least is found per part first, then over the parts, and comes back
    to the parts, of which a node has no more than edges.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)))
    by_part = dealt.groupBy("u", "part").agg(F.min("v").alias("low"))
    least = by_part.groupBy("u").agg(F.min("low").alias("low"))
    return dealt.join(by_part.select("u", "part").join(least, "u"), ["u", "part"]).drop("part")


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_least(both, parts).select("u", "v", F.least("u", "low").alias("low"))
    return found.where("v > u AND v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    found = _with_least(down, parts)
    moved = F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v"))
    return found.select(moved.alias("u"), F.col("low").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node of an undirected edge table with the least node it reaches.

    Returns ``node, component``; nodes without a link to another node are not
    in the result. Each round writes its edges to the shared folder and deletes
    those of the round before, so a lost executor repeats one round at most.
    Hubs are safe: their edges are split over as many parts as Spark shuffles
    to. Null ends, self links and repeated links are ignored; an empty table
    gives an empty one. The number of rounds grows with the logarithm of the
    longest path.
    """
    spark = edges.sparkSession
    parts, rounds = int(spark.conf.get("spark.sql.shuffle.partitions")), Passes(spark, "components")
    links = rounds.write(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v"), "links")
    now = rounds.write(_small_star(links, parts), "round-0")
    rounds.drop("links")
    before, number = None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before, number = seen, number + 1
        now = rounds.write(_small_star(_large_star(now, parts), parts), f"round-{number}")
        rounds.drop(f"round-{number - 1}")
