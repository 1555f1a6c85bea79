"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search over words.

Patterns are all runs of ``span`` consecutive words of the test items. Words are the alphabet: a shift table on
blocks of two words says how far the window may move, blocks that end a pattern have shift 0 and lead to a
bucket by suffix hash, and direct comparison confirms. A document without test words is passed in steps of
span - 1 words.

The items are taken in blocks of bounded size (``BLOCK_BYTES`` of text each), one block at a time: its texts come to the
driver, are broadcast, and are dropped before the next, so what is held is bounded whatever the size of the benchmark. A
worker builds a block's tables once. Documents are read once per block and never shuffled.

Defined cases: null, empty and short texts hold nothing; items shorter than the span have no pattern; a passage
shared by two items counts for both; repeated rows count once; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.llm.texts import words
from shutterloom.session import written

SPAN = 10
BLOCK_BYTES = 8 << 20


class WuManber:
    """A search over word sequences for patterns of one length."""

    def __init__(self, items: list[tuple[int, str]], span: int = SPAN):
        self.span = span
        self.items: dict[tuple[str, ...], set[int]] = {}
        for item, text in items:
            w = words(text)
            for i in range(len(w) - span + 1):
                self.items.setdefault(tuple(w[i : i + span]), set()).add(item)
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[int, list[tuple[str, ...]]] = {}
        for p in self.items:
            for end in range(1, span):
                block = p[end - 1 : end + 1]
                move = span - 1 - end
                if move < self.shift.get(block, span - 1):
                    self.shift[block] = move
            self.bucket.setdefault(hash(p[-3:]), []).append(p)

    def find(self, w: list[str]) -> set[int]:
        """The items of which a pattern occurs in the words."""
        found: set[int] = set()
        i, n, step, shift, span = self.span - 1, len(w), self.span - 1, self.shift.get, self.span
        while i < n:
            move = shift((w[i - 1], w[i]), step)
            if move:
                i += move
                continue
            here = None
            for p in self.bucket.get(hash(tuple(w[i - 2 : i + 1])), ()):
                here = here or tuple(w[i - span + 1 : i + 1])
                if p == here:
                    found |= self.items[p]
                    break
            i += 1
        return found


def _tables(shared, span: int) -> WuManber:
    """The tables of a broadcast block, kept beside it in the worker for further tasks."""
    if getattr(shared, "tables", None) is None:
        shared.tables = WuManber(shared.value, span)
    return shared.tables


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id of every document that holds ``span`` consecutive words of an item."""
    if span < 3:
        raise ValueError("the span is at least 3 words")
    spark = documents.sparkSession
    held = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _tables(shared, span)
            for batch in batches:
                pairs = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in sorted(search.find(words(t)))]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in pairs], pa.int64()), pa.array([i for _, i in pairs], pa.int64())], names=["doc_id", "item_id"])

        return run

    out = None
    for k in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])
        found = texts.mapInArrow(scan(shared), "doc_id long, item_id long")
        if blocks > 1:
            found = written(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out.distinct()
