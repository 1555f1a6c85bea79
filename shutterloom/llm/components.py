"""Connected components by alternating star contraction, with checkpoints between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.session import cut


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    pairs = F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m"))))
    return edges.join(low, "a").select(pairs.alias("p")).select(F.col("p.a").alias("a"), F.col("p.m").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
    return edges.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """node, label: for every node of the edges (a, b) with b < a, the smallest node of its component."""
    edges = cut(edges)
    state = _state(edges)
    while state[0]:
        edges = cut(_large_star(_small_star(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
