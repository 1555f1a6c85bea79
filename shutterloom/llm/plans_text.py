"""Queries of problems 7, 8 and 9 over the driver's tables, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.llm import abuse, leakage, tokenizer
from shutterloom.session import table

TOKENIZERS = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")


def p7_ids(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return tokenizer.encode_documents(table(spark, folder, "documents"), os.path.join(tokenizers, "byte_bpe_50k.tiktoken"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """The leaked items with the number of documents that hold them."""
    return p8_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.toxic_documents(table(spark, folder, "documents"))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates_by_source(table(spark, folder, "documents"))


LEAKS_SQL = """
WITH item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item_runs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS run FROM item_words, unnest(range(1, len(w) - 8)) t(i) WHERE len(w) >= 10),
doc_runs AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 9], ' ') AS run FROM doc_words, unnest(range(1, len(w) - 8)) t(i) WHERE len(w) >= 10),
found AS (SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (run))
"""

SQL = {
    "p8_found": LEAKS_SQL + "SELECT doc_id, item_id FROM found",
    "p8_items": LEAKS_SQL + "SELECT item_id, count(*) AS documents FROM found GROUP BY item_id",
}
QUERIES = {"p7_ids": p7_ids, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_rates": p9_rates}
