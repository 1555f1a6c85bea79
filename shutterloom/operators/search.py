"""Search modes over recognised text and vectors. Filters go before the limit; totals are exact and independent of it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterloom.functions import vectors as V
from shutterloom.functions.words import tokens
from shutterloom.operators.text_index import TextIndex

UNBOUNDED = 1000.0


class QuerySyntaxError(ValueError):
    """A query that its mode cannot read."""


# --- currency: a derived row counts only while its fingerprint is the catalog's


def fingerprint() -> list[str]:
    return ["asset_id", "source_modified_ns", "source_size"]


def currently(derived: DataFrame, assets: DataFrame) -> DataFrame:
    """Derived rows of which the fingerprint is the catalog's."""
    return derived.join(assets.select(*fingerprint()).distinct(), fingerprint(), "left_semi")


def media_current() -> Column:
    """A still has sampling version 0 and no time, a video version 4 and a time."""
    still = (F.col("media_kind") == "image") & (F.col("sampling_version") == 0) & F.col("timestamp_ms").isNull()
    return still | ((F.col("media_kind") == "video") & (F.col("sampling_version") == 4) & F.col("timestamp_ms").isNotNull())


def distinct_texts(recognised: DataFrame) -> DataFrame:
    """One row per asset: the latest written, then the largest row."""
    columns = [c for c in recognised.columns if c not in ("asset_id", "written_at")]
    return recognised.groupBy("asset_id").agg(F.max(F.struct("written_at", *columns)).alias("r")).select("asset_id", *[F.col(f"r.{c}").alias(c) for c in columns])


# --- full text


def phrase_count(text: Column, phrase: str) -> Column:
    """Overlapping occurrences, in small letters."""
    p = phrase.lower()
    return F.regexp_count(F.lower(text), F.lit(f"(?={re.escape(p)})"))


def bm25(rows: DataFrame, phrases: list[str], where: Column | None = None, text: str = "content", index: TextIndex | None = None) -> DataFrame:
    """rows (those of ``where``) with score (negative, lower is better): trigram lengths, statistics over all rows.

    The statistics are one row; they come back to the rows as literals, so the scan is not joined with anything.
    Containment decides first, so occurrences are counted in hits only. With an index the number of rows and their average
    length are kept, and both passes read the candidates alone."""
    length = F.greatest(F.length(text) - 2, F.lit(0))
    wanted = [p for p in phrases if len(p) >= 3]
    low = F.lower(text)
    held = [F.count_if(F.contains(low, F.lit(p.lower()))).alias(f"d{i}") for i, p in enumerate(wanted)]
    hits = rows if where is None else rows.where(where)
    if index is not None:
        near = index.narrowed(rows, wanted)
        stats = (near.agg(*held).first().asDict() if held else {}) | {"n": index.statistics["n"], "avg": index.statistics["average"]}
        hits = near if where is None else near.where(where)
    else:
        stats = rows.agg(F.count("*").alias("n"), F.avg(length).alias("avg"), *held).first()
    score = F.lit(0.0)
    for i, p in enumerate(wanted):
        idf = F.log(F.lit((stats["n"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5)))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        f = phrase_count(F.col(text), p).cast("double")
        score = score - idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / F.lit(float(stats["avg"] or 1.0))))
    return hits.withColumn("score", score)


def simple(rows: DataFrame, query: str, limit: int | None = None, text: str = "content", index: TextIndex | None = None) -> DataFrame:
    """The whole query as one phrase (three characters at least; a star stands for backslash-star)."""
    phrase = query.replace("*", "\\*")
    if len(phrase) < 3:
        return rows.where(F.lit(False)).withColumn("score", F.lit(0.0))
    return _ranked(bm25(rows, [phrase], F.contains(F.lower(text), F.lit(phrase.lower())), text, index), limit)


def count_simple(rows: DataFrame, query: str, text: str = "content") -> DataFrame:
    """total: how many rows the mode matches, without scoring them."""
    phrase = query.replace("*", "\\*")
    hits = rows.where(F.contains(F.lower(text), F.lit(phrase.lower())) if len(phrase) >= 3 else F.lit(False))
    return hits.agg(F.count("*").alias("total"))


def count_match(rows: DataFrame, query: str, text: str = "content") -> DataFrame:
    return rows.where(Expression(query).column_of(F.col(text))).agg(F.count("*").alias("total"))


def count_glob(rows: DataFrame, query: str, text: str = "content") -> DataFrame:
    pattern = word_glob_regex(query.lower())
    return rows.where(F.exists(tokens(F.col(text)), lambda w: w.rlike(pattern))).agg(F.count("*").alias("total"))


def count_regex(rows: DataFrame, pattern: str, text: str = "content") -> DataFrame:
    check_regex(pattern)
    return rows.where(F.col(text).rlike(pattern)).agg(F.count("*").alias("total"))


def _ranked(scored: DataFrame, limit: int | None) -> DataFrame:
    ordered = scored.orderBy("score", F.desc("source_modified_ns"), "asset_id")
    return ordered.limit(limit) if limit is not None else ordered


class Expression:
    """phrase, "quoted phrase", phrase*, ^phrase, NEAR(phrase phrase, n), AND (or nothing), OR, NOT, parentheses; NOT binds
    closest, then AND, then OR.

    Texts are indexed by trigrams, so a star after a phrase of three characters or more changes nothing, a caret asks for the text's beginning, and
    NEAR (n is 10 if not given) counts the trigrams between the end of the first phrase and the start of the last."""

    def __init__(self, source: str):
        self.items = re.findall(r'"((?:[^"]|"")*)"|([()])|([^\s()"]+)', source)
        if re.sub(r'"(?:[^"]|"")*"|[()]|[^\s()"]+|\s+', "", source):
            raise QuerySyntaxError(f"unbalanced quotes: {source}")
        self.at, self.phrases = 0, []
        self.column_of = self._or()
        if self.at < len(self.items):
            raise QuerySyntaxError(f"unexpected {self._peek()}")

    def _peek(self) -> str | None:
        if self.at >= len(self.items):
            return None
        quoted, bracket, word = self.items[self.at]
        return bracket or word or f'"{quoted}'

    def _or(self):
        left = self._and()
        while self._peek() == "OR":
            self.at += 1
            a, b = left, self._and()
            left = lambda t, a=a, b=b: a(t) | b(t)
        return left

    def _and(self):
        left = self._not()
        while (p := self._peek()) is not None and p not in ("OR", ")"):
            if p == "AND":
                self.at += 1
            elif p == "NOT":
                break
            a, b = left, self._not()
            left = lambda t, a=a, b=b: a(t) & b(t)
        return left

    def _not(self):
        left = self._unit()
        while self._peek() == "NOT":
            self.at += 1
            a, b = left, self._unit(counts=False)
            left = lambda t, a=a, b=b: a(t) & ~b(t)
        return left

    def _unit(self, counts: bool = True):
        p = self._peek()
        if p is None or p in (")", "AND", "OR", "NOT"):
            raise QuerySyntaxError("a phrase is missing")
        self.at += 1
        if p == "(":
            inner = self._or()
            if self._peek() != ")":
                raise QuerySyntaxError("a parenthesis is not closed")
            self.at += 1
            return inner
        if p == "NEAR" and self._peek() == "(":
            return self._near(counts)
        first = p.startswith("^")
        phrase = self._phrase(p[1:] if first and len(p) > 1 else self._next() if first else p)
        if counts:
            self.phrases.append(phrase)
        folded = phrase.lower()
        if len(folded) < 3:
            return lambda t: F.lit(False)
        return (lambda t: F.lower(t).startswith(folded)) if first else (lambda t: F.contains(F.lower(t), F.lit(folded)))

    def _next(self) -> str:
        p = self._peek()
        if p is None or p in ("(", ")"):
            raise QuerySyntaxError("a phrase is missing")
        self.at += 1
        return p

    def _phrase(self, p: str) -> str:
        """A phrase as it stands at this place; a star that follows goes with it."""
        if p.startswith('"'):
            phrase = p[1:].replace('""', '"')
            if self._peek() == "*":
                self.at += 1
            return phrase
        phrase = p.removeprefix("content:").removesuffix("*")
        if re.search(r"[*^+]", phrase):
            raise QuerySyntaxError(f"not supported: {phrase}")
        return phrase

    def _near(self, counts: bool):
        self.at += 1
        phrases, within = [], 10
        while (p := self._peek()) != ")":
            if p is None:
                raise QuerySyntaxError("a parenthesis is not closed")
            self.at += 1
            comma = not p.startswith('"') and p.endswith(",")
            if p != ",":
                phrases.append(self._phrase(p.rstrip(",") if comma else p))
            if comma:
                number = self._next()
                if not number.isdigit() or self._peek() != ")":
                    raise QuerySyntaxError("NEAR takes one whole number")
                within = int(number)
        self.at += 1
        if not phrases:
            raise QuerySyntaxError("NEAR takes a phrase or more")
        if counts:
            self.phrases += phrases
        folded = [p.lower() for p in phrases]
        if any(len(p) < 3 for p in folded):
            return lambda t: F.lit(False)
        ways = []
        for i, first in enumerate(folded):  # the phrase that begins the group, the others from there on
            reach = len(first) - 2 + within
            ways.append(f"(?={re.escape(first)})" + "".join(f"(?=.{{0,{reach}}}{re.escape(p)})" for j, p in enumerate(folded) if j != i))
        pattern = f"(?s)(?:{'|'.join(ways)})"

        def holds(t: Column) -> Column:
            low = F.lower(t)
            return reduce(lambda a, b: a & b, (F.contains(low, F.lit(p)) for p in folded)) & low.rlike(pattern)

        return holds


def match(rows: DataFrame, query: str, limit: int | None = None, text: str = "content", index: TextIndex | None = None) -> DataFrame:
    """A full-text expression; the score sums over its positive phrases."""
    e = Expression(query)
    # a hit holds a positive phrase; without one of three characters no index helps
    usable = index if any(len(p) >= 3 for p in e.phrases) else None
    return _ranked(bm25(rows, e.phrases, e.column_of(F.col(text)), text, usable), limit)


def postings(rows: DataFrame, text: str = "content") -> DataFrame:
    """asset_id, term, n: the word index, to be kept if many globs are asked."""
    return rows.select("asset_id", F.explode(tokens(F.col(text))).alias("term")).groupBy("asset_id", "term").agg(F.count("*").alias("n"))


def word_glob_regex(pattern: str) -> str:
    """A glob with classes over one whole word."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def glob(rows: DataFrame, query: str, limit: int | None = None, text: str = "content") -> DataFrame:
    """Rows with a whole word that matches, and matching_words, how many do (repeats count). No shuffle: words stay in their row."""
    regex = word_glob_regex(query.lower())
    words = F.size(F.filter(tokens(F.col(text)), lambda w: w.rlike(regex)))
    ordered = rows.withColumn("matching_words", words).where("matching_words > 0").orderBy(F.desc("matching_words"), F.desc("source_modified_ns"), "asset_id")
    return ordered.limit(limit) if limit is not None else ordered


def glob_by_index(index: DataFrame, rows: DataFrame, query: str) -> DataFrame:
    """The same from a kept word index: the vocabulary first, then its postings."""
    hits = index.where(F.col("term").rlike(word_glob_regex(query.lower()))).groupBy("asset_id").agg(F.sum("n").alias("matching_words"))
    return rows.join(hits, "asset_id")


def check_regex(pattern: str) -> None:
    """Only what linear-time engines know: no look-around, no back-references."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?P=|\(\?>|[*+?}]\+", pattern):
        raise QuerySyntaxError("look-around, back-references and possessive repeats are not supported")
    try:
        re.compile(pattern)
    except re.error as x:
        raise QuerySyntaxError(re.sub(r"\s+", " ", str(x))) from x


def regex(rows: DataFrame, pattern: str, limit: int | None = None, text: str = "content") -> DataFrame:
    """Rows of which the text matches anywhere, newest first."""
    check_regex(pattern)
    ordered = rows.where(F.col(text).rlike(pattern)).orderBy(F.desc("source_modified_ns"), "asset_id")
    return ordered.limit(limit) if limit is not None else ordered


# --- vectors


def with_total(hits: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows in order (column names, "-name" for descending), each with the total number of hits; the total is a
    row even without hits.

    One pass: each task keeps the first of its own hits and counts them all, and of those few the first are taken."""
    columns, keep = hits.columns, max(limit, 1)
    keys = [(o.lstrip("-"), "descending" if o.startswith("-") else "ascending") for o in order]

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, n = None, 0
        for batch in batches:
            n += batch.num_rows
            rows = pa.Table.from_batches([batch])
            rows = rows if best is None else pa.concat_tables([best, rows])
            best = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start")[:keep])
        if best is not None and n:
            yield from best.append_column("_hits", pa.array([n] + [0] * (best.num_rows - 1), pa.int64())).combine_chunks().to_batches()

    kept = hits.mapInArrow(firsts, T.StructType([*hits.schema.fields, T.StructField("_hits", T.LongType())]))
    every = Window.partitionBy(F.lit(0))  # at most the limit from each task
    ordered = every.orderBy(*[F.desc(c) if way == "descending" else F.asc(c) for c, way in keys])
    top = kept.withColumns({"total": F.sum("_hits").over(every), "_place": F.row_number().over(ordered)}).where(F.col("_place") <= keep)
    shown = top.select(F.lit(0).alias("_none"), "total", *[c if limit else F.lit(None).cast(top.schema[c].dataType).alias(c) for c in columns])
    return hits.sparkSession.range(1).select(F.lit(0).alias("_none")).join(shown, "_none", "left").select(F.coalesce("total", F.lit(0)).alias("total"), *columns)


def text_vectors(vectors: DataFrame, recognised: DataFrame, query: list[float], space: str, ceiling: float = UNBOUNDED) -> DataFrame:
    """asset_id, distance, source_modified_ns, content of the current text vectors, unordered.

    vectors: space, asset_id, embedding and the fingerprint; recognised: one row per asset. The distance is computed
    in the scan, before the join, so vectors never shuffle."""
    scored = vectors.where(F.col("space") == space).select(*fingerprint(), V.distance_to(query)(F.col("embedding")).alias("distance"))
    scored = scored.where(F.col("distance").isNotNull() & (F.col("distance") <= ceiling)).distinct()
    return recognised.join(scored, fingerprint())


def nearest(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy("distance", F.desc("source_modified_ns"), "asset_id").limit(limit)


def late_text(top: DataFrame, recognised: DataFrame, characters: int = 240) -> DataFrame:
    """The excerpt of the first characters, joined only to the few rows that are shown."""
    return top.join(recognised.select("asset_id", F.substring("content", 1, characters).alias("excerpt")), "asset_id", "left")


def image_vectors(samples: DataFrame, state: DataFrame, assets: DataFrame, query: list[float]) -> DataFrame:
    """asset_id, embedding_id, timestamp_ms, distance, and the asset's columns, of all current samples; a repeated sample is
    a repeated row. The distance is computed in the scan, and the catalog side shrinks by a semi join before it is joined."""
    scored = samples.select("embedding_id", "asset_id", "timestamp_ms", V.distance_to(query)(F.col("embedding")).alias("distance")).where(F.col("distance").isNotNull())
    version = F.when(F.col("media_kind") == "image", 0).when(F.col("media_kind") == "video", 4)
    known = assets.withColumn("sampling_version", version).join(state.select(*fingerprint(), "sampling_version"), [*fingerprint(), "sampling_version"], "left_semi")
    return scored.join(known, "asset_id").where(media_current())


def best_frame(hits: DataFrame) -> DataFrame:
    """The nearest sample of each asset; ties go to the earlier time, then the smaller embedding_id. Partial aggregates."""
    columns = [c for c in hits.columns if c != "asset_id"]
    first = F.min(F.struct("distance", F.coalesce("timestamp_ms", F.lit(-1)).alias("_t"), "embedding_id", *[c for c in columns if c not in ("distance", "embedding_id")]))
    return hits.groupBy("asset_id").agg(first.alias("b")).select("asset_id", *[F.col(f"b.{c}").alias(c) for c in columns])


def current_vector(samples: DataFrame, state: DataFrame, assets: DataFrame, asset_id: int, width: int | None = None) -> DataFrame:
    """The earliest current usable vector of an asset."""
    one = assets.where(F.col("asset_id") == asset_id).join(state.select(*fingerprint(), "sampling_version").distinct(), fingerprint())
    usable = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    if width is not None:
        usable = usable & (F.size("embedding") == width)
    rows = samples.where((F.col("asset_id") == asset_id) & usable).select("asset_id", "embedding_id", "timestamp_ms", "embedding")
    return one.join(rows, "asset_id").where(media_current()).orderBy(F.asc_nulls_first("timestamp_ms"), "embedding_id").limit(1).select("asset_id", "embedding_id", "timestamp_ms", "embedding")


def stamp_ranks(hits: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rank 1..n in retrieval order, over rows already cut to a limit."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(*order)))
