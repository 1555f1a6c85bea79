"""Queries of problems 2 and 6 over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.operators import increments, orphans
from shutterloom.session import table

REFERRING = ("image_embedding_state", "ocr_results", "thumbnails")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    tables = {name: table(spark, folder, name) for name in REFERRING}
    assets, pruned = table(spark, folder, "assets"), table(spark, folder, "pruned_assets")
    every = assets.select("asset_id")
    for df in (pruned, *tables.values()):
        every = every.unionByName(df.select("asset_id"))
    keys = every.agg(F.approx_count_distinct("asset_id")).first()[0]  # one column of each table, nothing shuffled
    return orphans.find_orphans(orphans.references(tables), orphans.parents(assets, pruned), keys)


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    names = ("assets", "pruned_assets", "ocr_results", "ocr_embedding_state", "ocr_embedding_model")
    return increments.pending_text_assets(*[table(spark, folder, name) for name in names])


ORPHANS_SQL = """
WITH refs AS (
  SELECT 'image_embedding_state' AS src_table, asset_id, min(written_at) AS w FROM image_embedding_state WHERE asset_id IS NOT NULL GROUP BY asset_id
  UNION ALL SELECT 'ocr_results', asset_id, min(written_at) FROM ocr_results WHERE asset_id IS NOT NULL GROUP BY asset_id
  UNION ALL SELECT 'thumbnails', asset_id, min(written_at) FROM thumbnails WHERE asset_id IS NOT NULL GROUP BY asset_id),
seen AS (SELECT asset_id, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM assets GROUP BY asset_id),
gone AS (SELECT asset_id, max(pruned_at) AS pruned_at FROM pruned_assets GROUP BY asset_id),
found AS (
  SELECT src_table, r.asset_id, CASE
      WHEN s.asset_id IS NULL AND g.asset_id IS NULL THEN 'missing'
      WHEN g.pruned_at IS NOT NULL AND (s.last_seen IS NULL OR g.pruned_at > s.last_seen) THEN 'deleted'
      WHEN s.first_seen > r.w THEN 'late' END AS reason, strftime(r.w, '%Y-%m') AS period
  FROM refs r LEFT JOIN seen s ON r.asset_id = s.asset_id LEFT JOIN gone g ON r.asset_id = g.asset_id)
"""

SQL = {
    "p2_found": ORPHANS_SQL + "SELECT src_table, asset_id, reason, period FROM found WHERE reason IS NOT NULL",
    "p2_report": ORPHANS_SQL
    + "SELECT src_table, period, reason, count(*) AS orphans, min(asset_id) AS first_id, max(asset_id) AS last_id FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p6_found": """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY seen_at DESC, source_modified_ns DESC, source_size DESC) AS rn FROM assets),
gone AS (SELECT asset_id, max(pruned_at) AS pruned_at FROM pruned_assets GROUP BY asset_id)
SELECT m.space, a.asset_id FROM ranked a CROSS JOIN (SELECT DISTINCT space FROM ocr_embedding_model) m LEFT JOIN gone g ON a.asset_id = g.asset_id
WHERE a.rn = 1 AND a.media_kind = 'image' AND a.media_format IN ('png', 'jpeg', 'gif', 'webp') AND (g.pruned_at IS NULL OR g.pruned_at <= a.seen_at)
  AND EXISTS (SELECT 1 FROM ocr_results o WHERE o.asset_id = a.asset_id AND trim(o.content, ' ') <> '')
  AND NOT EXISTS (SELECT 1 FROM ocr_embedding_state s WHERE s.space = m.space AND s.asset_id = a.asset_id AND s.embedding IS NOT NULL
    AND s.source_modified_ns = a.source_modified_ns AND s.source_size = a.source_size)""",
}

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p6_found": p6_found}
