"""Queries of problem 5 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shutterloom.llm import ocrnoise
from shutterloom.session import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return ocrnoise.noise(table(spark, folder, "ocr_results"))


def p5_text(spark: SparkSession, folder: str) -> DataFrame:
    return ocrnoise.repaired(table(spark, folder, "ocr_results"))


SQL: dict[str, str] = {}
QUERIES = {"p5_found": p5_found, "p5_text": p5_text}
