"""Encoding of documents with a public byte-level BPE vocabulary.

Pre-tokens are merged with a hierarchical-bitmap rank queue: one bucket per merge rank holds the linked-list
positions whose pair has that rank, a three-level bitmap over the ranks gives the next rank by find-first-set,
and entries that no longer hold are skipped when they come up. Each merge costs a constant number of bit
operations, whatever the length of the pre-token. Pre-tokens seen before in a task are looked up.

Defined cases: null and empty texts give an empty list; strings of special tokens in a text are ordinary text;
one row per input row, other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The published pre-token pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens a task remembers; beyond it the memory starts anew.
REMEMBERED = 1 << 17


class RankQueue:
    """Positions by merge rank; pop() gives the lowest rank, leftmost position first."""

    __slots__ = ("low", "mid", "top", "buckets")

    def __init__(self):
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word, block = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.mid[block] = self.mid.get(block, 0) | 1 << (word & 63)
        self.top |= 1 << block

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        block = (self.top & -self.top).bit_length() - 1
        m = self.mid[block]
        word = block << 6 | (m & -m).bit_length() - 1
        w = self.low[word]
        rank = word << 6 | (w & -w).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            self.low[word] = w = w & (w - 1)
            if not w:
                self.mid[block] = m = m & (m - 1)
                if not m:
                    self.top &= self.top - 1
        return rank, position


class BytePairEncoder:
    """A vocabulary of byte strings and their ranks, which are also the ids."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.split = regex.compile(pattern).findall
        self.memory: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # of the token that starts at a position; 0 once it was merged into its left neighbour
        before = list(range(-1, n - 1))
        pair: list[int | None] = [None] * n  # the rank of the token at a position with the next one
        queue = RankQueue()
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if not end[i] or pair[i] != rank:
                continue  # stale
            j = end[i]
            k = end[j]
            end[i], end[j], pair[j] = k, 0, None
            pair[i] = None
            if k < n:
                before[k] = i
                rank = ranks.get(piece[i : end[k]])
                if rank is not None:
                    pair[i] = rank
                    queue.push(rank, i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(piece[h:k])
                pair[h] = rank
                if rank is not None:
                    queue.push(rank, h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens."""
        if not text:
            return []
        memory, ids = self.memory, []
        for piece in self.split(text):
            got = memory.get(piece)
            if got is None:
                got = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = got
            ids += got
        return ids


def encode_documents(documents: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array<int>) of every row. The vocabulary file (under 1 MB, fixed) goes to the executors as a broadcast."""
    with open(vocabulary_path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary file of more than 64 MB is not broadcast")
    shared = documents.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairEncoder(shared.value)
        for batch in batches:
            ids = pa.array([encoder.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    rows = documents.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, ids array<int>")
