"""Requests as checked values, and a whole multi-mode search as one plan."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.functions.vectors import combine
from shutterloom.operators import catalog, fusion, search
from shutterloom.operators.filters import Filters

MODES = ("vector", "image", "path", "name", "ocrSimple", "ocrMatch", "ocrGlob", "regex")
LARGEST_LIMIT, MOST_QUERIES, MOST_COMPONENTS, LONGEST_QUERY = 250_000, 6, 16, 4096


class InvalidRequest(ValueError):
    """A request outside its limits."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise InvalidRequest(what)


@dataclass(frozen=True)
class Component:
    """One part of a composite vector query: exactly one of a vector and an asset."""

    weight: float
    vector: list[float] | None = None
    asset_id: int | None = None

    def __post_init__(self):
        _need(math.isfinite(self.weight) and self.weight != 0 and abs(self.weight) <= 100, "a component's weight is finite, not 0, and 100 at most")
        _need((self.vector is None) != (self.asset_id is None), "a component has exactly one source")


@dataclass(frozen=True)
class Query:
    key: str
    mode: str
    text: str = ""
    components: tuple[Component, ...] = ()
    weight: float = 1.0
    max_distance: float | None = None

    def __post_init__(self):
        _need(bool(self.key.strip()), "a query has a key")
        _need(self.mode in MODES, f"unknown mode {self.mode}")
        vector = self.mode in ("vector", "image")
        if vector:
            _need(0 < len(self.components) <= MOST_COMPONENTS, "a vector query has 1 to 16 components")
        else:
            _need(bool(self.text.strip()) and len(self.text.encode()) <= LONGEST_QUERY, "a query is not blank and 4,096 bytes at most")
        _need(math.isfinite(self.weight) and self.weight > 0, "a weight is finite and positive")
        _need(self.max_distance is None or (vector and 0 <= self.max_distance <= 2), "a largest distance is for vector modes, 0 to 2")


@dataclass(frozen=True)
class SearchRequest:
    queries: tuple[Query, ...]
    limit: int = 50
    k: float = fusion.K
    filters: Filters = field(default_factory=Filters)
    space: str = "ocrText"

    def __post_init__(self):
        _need(0 < len(self.queries) <= MOST_QUERIES, "1 to 6 queries")
        _need(len({q.key for q in self.queries}) == len(self.queries), "keys are unique")
        _need(1 <= self.limit <= LARGEST_LIMIT, "a limit is 1 to 250,000")
        _need(math.isfinite(self.k) and self.k > 0, "k is finite and positive")
        f = self.filters
        _need(len(f.patterns) + len(f.exclude_patterns) <= 32 and len(f.extensions) + len(f.exclude_extensions) <= 32, "32 filters and extensions at most")


class Engine:
    """The stores of one moment: every plan made from it sees the same snapshots.

    assets: one current row per asset; recognised: one text per asset; vectors, samples, state as stored."""

    def __init__(self, assets: DataFrame, recognised: DataFrame, vectors: DataFrame, samples: DataFrame, state: DataFrame):
        self.assets, self.recognised, self.vectors, self.samples, self.state = assets, recognised, vectors, samples, state

    def vector_of(self, query: Query) -> list[float]:
        parts = []
        for c in query.components:
            vector = c.vector
            if vector is None:
                row = search.current_vector(self.samples, self.state, self.assets, c.asset_id).first()
                if row is None:
                    raise InvalidRequest(f"asset {c.asset_id} has no current vector")
                vector = row["embedding"]
            parts.append((c.weight, vector))
        return combine(parts)

    def hits(self, q: Query, request: SearchRequest) -> DataFrame:
        """asset_id, rank (and snippet or timestamp_ms) of one query."""
        limit, where = request.limit, request.filters
        texts = self.recognised.where(where.column(F.col("source_path")))
        files = self.assets.where(where.column(F.col("path")))
        ceiling = search.UNBOUNDED if q.max_distance is None else q.max_distance
        if q.mode == "vector":
            top = search.nearest(search.text_vectors(self.vectors, texts, self.vector_of(q), request.space, ceiling).drop("content"), limit)
            ranked = search.stamp_ranks(top, F.col("distance"), F.desc("source_modified_ns"), F.col("asset_id"))
            return search.late_text(ranked, self.recognised).select("asset_id", "rank", F.col("excerpt").alias("snippet"))
        if q.mode == "image":
            best = search.best_frame(search.image_vectors(self.samples, self.state, files, self.vector_of(q))).where(F.col("distance") <= ceiling)
            top = search.nearest(best, limit)
            return search.stamp_ranks(top, F.col("distance"), F.desc("source_modified_ns"), F.col("asset_id")).select("asset_id", "rank", "timestamp_ms")
        if q.mode in ("path", "name"):
            from shutterloom.functions.paths import file_name, natural_key

            target = file_name(F.col("path")) if q.mode == "name" else F.col("path")
            scope = where.scope or catalog.PathScope.of(["/"])
            rows = catalog.search_files(files, scope, q.text, q.mode, limit) if where.scope else files.where(catalog.path_matches(target, q.text)).orderBy(natural_key(target), "asset_id").limit(limit)
            return search.stamp_ranks(rows.withColumn("_k", natural_key(target)), F.col("_k"), F.col("asset_id")).select("asset_id", "rank")
        find = {"ocrSimple": search.simple, "ocrMatch": search.match, "ocrGlob": search.glob, "regex": search.regex}[q.mode]
        order = {"ocrGlob": [F.desc("matching_words")], "regex": []}.get(q.mode, [F.col("score")])
        top = find(texts, q.text, limit)
        ranked = search.stamp_ranks(top, *order, F.desc("source_modified_ns"), F.col("asset_id"))
        return ranked.select("asset_id", "rank", F.substring("content", 1, 512).alias("snippet"))

    def search(self, request: SearchRequest) -> DataFrame:
        lists = [fusion.labelled(self.hits(q, request), q.key, i, q.weight) for i, q in enumerate(request.queries)]
        return fusion.fuse(lists, request.k, request.limit)
