"""Reciprocal rank fusion of several result lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60.0


def labelled(hits: DataFrame, key: str, position: int, weight: float = 1.0) -> DataFrame:
    """One ranked list (asset_id, rank and, if it has them, snippet, timestamp_ms) with its place in the request."""
    snippet = F.col("snippet") if "snippet" in hits.columns else F.lit(None).cast("string")
    time = F.col("timestamp_ms") if "timestamp_ms" in hits.columns else F.lit(None).cast("long")
    return hits.select("asset_id", "rank", snippet.alias("snippet"), time.alias("timestamp_ms"), F.lit(key).alias("key"), F.lit(position).alias("position"), F.lit(float(weight)).alias("weight"))


def fuse(lists: list[DataFrame], k: float = K, limit: int = 250_000) -> DataFrame:
    """rank, asset_id, score (sum of weight / (k + rank)), first snippet in request order, first known time, sources in order."""
    rows = reduce(DataFrame.unionByName, lists)
    order = F.col("position")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    fused = rows.groupBy("asset_id").agg(
        F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"),
        first("snippet").alias("snippet"),
        first("timestamp_ms").alias("timestamp_ms"),
        F.array_sort(F.collect_list(F.struct("position", "key", "rank"))).alias("sources"),
    )
    fused = fused.withColumn("sources", F.transform("sources", lambda s: F.struct(s["key"].alias("key"), s["rank"].alias("rank"))))
    # the rank is dealt over the rows of the limit only, so its one window stays bounded
    top = fused.orderBy(F.desc(F.round("score", 12)), "asset_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "asset_id")))
