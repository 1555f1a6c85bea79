"""Queries of problems 1 and 3 over the driver's tables, with their SQL (brute force)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.llm import density, neighbours
from shutterloom.session import table

IMAGE_WIDTH = 96


def _image_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "image_embedding_samples").select(F.col("embedding_id").alias("id"), "embedding")


def p1_members(spark: SparkSession, folder: str) -> DataFrame:
    return density.clusters(_image_rows(spark, folder), IMAGE_WIDTH)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_members(spark, folder).select("cluster_id", "embedding_id")


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return density.describe(p1_members(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    # a handful of declared spaces by nature
    widths = {r.space: r.dimensions for r in table(spark, folder, "ocr_embedding_model").select("space", "dimensions").dropna().distinct().limit(1000).collect()}
    texts = table(spark, folder, "ocr_embedding_state").select("space", F.col("asset_id").alias("id"), "embedding")
    rows = _image_rows(spark, folder).select(F.lit("image").alias("space"), "id", "embedding").unionByName(texts.where(F.col("space") != "image"))
    return neighbours.similar_pairs(rows, widths | {"image": IMAGE_WIDTH})


USABLE = "embedding IS NOT NULL AND len(embedding) = width AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
SQL = {
    "p1_found": f"""
WITH usable AS MATERIALIZED (SELECT DISTINCT id, embedding::DOUBLE[{IMAGE_WIDTH}] AS v FROM (SELECT embedding_id AS id, embedding, {IMAGE_WIDTH} AS width FROM image_embedding_samples) WHERE {USABLE}),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.id < b.id WHERE array_cosine_similarity(a.v, b.v) >= 0.78),
ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near UNION ALL SELECT id, id FROM usable),
sets AS (SELECT a, list(b ORDER BY b) AS s FROM ways GROUP BY a)
SELECT s[1] AS cluster_id, a AS embedding_id FROM sets WHERE len(s) >= 3
QUALIFY count(*) OVER (PARTITION BY s) = len(s)""",
    "p3_found": f"""
WITH rows AS (
  SELECT 'image' AS space, embedding_id AS id, embedding, {IMAGE_WIDTH} AS width FROM image_embedding_samples
  UNION ALL SELECT s.space, s.asset_id, s.embedding, m.dimensions FROM ocr_embedding_state s JOIN ocr_embedding_model m ON s.space = m.space),
usable AS MATERIALIZED (SELECT DISTINCT space, id, embedding::DOUBLE[] AS v FROM rows WHERE {USABLE}),
near AS MATERIALIZED (
  SELECT a.space, a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM usable a JOIN usable b ON a.space = b.space AND a.id < b.id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.8999),
ways AS (SELECT space, a, b, s FROM near WHERE s >= 0.9 UNION ALL SELECT space, b, a, s FROM near WHERE s >= 0.9),
ranked AS (SELECT *, row_number() OVER (PARTITION BY space, a ORDER BY s DESC, b) AS rank FROM ways)
SELECT DISTINCT space, least(a, b) AS id_a, greatest(a, b) AS id_b FROM ranked WHERE rank <= 5""",
}
QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p3_found": p3_found}
