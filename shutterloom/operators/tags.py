"""Zero-shot tags: every tag of a vocabulary against image vectors, less a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.functions.vectors import distance_to


def baselines(tags: DataFrame, mean: list[float]) -> DataFrame:
    """tags with baseline: the cosine to the mean of reference images."""
    return tags.withColumn("baseline", 1 - distance_to(mean)(F.col("embedding")))


def top_tags(tags: DataFrame, image: list[float], per_kind: int = 15, blocked: bool = False) -> DataFrame:
    """kind, term, score, rank: the best of each kind by cosine less baseline. The vocabulary is scanned once; the window
    keeps per_kind rows of a kind in each task before the shuffle."""
    rows = tags if blocked else tags.where(F.col("sensitivity") != "blocked")
    score = 1 - distance_to(image)(F.col("embedding")) - F.coalesce("baseline", F.lit(0.0))
    scored = rows.withColumn("score", F.round(score, 9)).where(F.col("score").isNotNull())
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= per_kind).select("kind", "term", "score", "rank")
