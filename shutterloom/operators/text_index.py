"""A kept full-text index: trigrams of texts (or paths) and their words, as posting tables in Parquet.

Built once for a snapshot of the rows and written into a folder, sorted by gram, so that a search reads the row groups of its own
trigrams only. A search intersects the postings of a phrase's trigrams, joins the few candidates with the rows, and verifies
them there; statistics that a score needs of the whole corpus are one row beside the postings.

Defined cases: null texts and texts of fewer than three characters have no trigrams; grams are in small letters; a phrase of
fewer than three characters has no candidates. One row per id is expected.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.functions.words import tokens


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, in small letters."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))))


def grams_of(phrase: str) -> list[str]:
    low = phrase.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


class TextIndex:
    """Postings (gram, id), words (term, id, n) and statistics (n, average) of a column of texts."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.postings = spark.read.parquet(f"{self.folder}/grams")
        self.words = spark.read.parquet(f"{self.folder}/words")
        self.statistics = spark.read.parquet(f"{self.folder}/statistics").first()

    @classmethod
    def build(cls, rows: DataFrame, folder: str, key: str = "asset_id", text: str = "content") -> TextIndex:
        """Each part is one pass; a hot gram's postings stay spread over the range partitions of (gram, id)."""
        grams = rows.select(key, F.explode(trigrams(F.col(text))).alias("gram"))
        grams.repartitionByRange("gram", key).sortWithinPartitions("gram", key).write.mode("overwrite").parquet(f"{folder}/grams")
        words = rows.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
        words.repartitionByRange("term", key).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/words")
        length = F.greatest(F.length(text) - 2, F.lit(0))
        rows.agg(F.count("*").alias("n"), F.avg(length).alias("average")).write.mode("overwrite").parquet(f"{folder}/statistics")
        return cls(rows.sparkSession, folder, key)

    def candidates(self, phrases: Iterable[str]) -> DataFrame:
        """The ids that hold all trigrams of at least one of the phrases."""
        found = None
        for phrase in phrases:
            grams = grams_of(phrase)
            if not grams:
                continue
            hits = self.postings.where(F.col("gram").isin(grams)).groupBy(self.key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(grams)).select(self.key)
            found = hits if found is None else found.unionByName(hits)
        return self.postings.select(self.key).where(F.lit(False)) if found is None else found.distinct()

    def narrowed(self, rows: DataFrame, phrases: Iterable[str]) -> DataFrame:
        """The rows among the candidates; the phrases themselves are still to be verified."""
        return rows.join(self.candidates(phrases), self.key, "left_semi")
