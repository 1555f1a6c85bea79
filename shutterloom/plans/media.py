"""Queries of the catalog, filters, searches and maintenance over the driver's tables, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom import request as R
from shutterloom.functions import paths, words
from shutterloom.functions import vectors as V
from shutterloom.operators import catalog, coverage, frames, fusion, highlight, media, search, tags, upkeep
from shutterloom.operators.filters import CAPTURE, Filters, TimeRange
from shutterloom.operators.scope import PathScope
from shutterloom.session import table

SCOPE = PathScope.of(["/library/scans", "/library/family"], ["/library/scans/2020"])
SCOPE_SQL = "(((path >= '/library/scans/' AND path < '/library/scans0') OR (path >= '/library/family/' AND path < '/library/family0')) AND NOT (path >= '/library/scans/2020/' AND path < '/library/scans/20200'))"
FROM_NS, TO_NS = 1_672_531_200_000_000_000, 1_688_169_600_000_000_000
PHRASE, BOOLEAN, GLOB, REGEX = "telescope", '"door that" NOT lantern', "harb*", r"[0-9]{3} of them"
LIMIT = 200

CUR = """cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY seen_at DESC, source_modified_ns DESC, source_size DESC, path DESC) AS rn
  FROM assets WHERE asset_id IS NOT NULL) WHERE rn = 1)"""
TXT = """txt AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY written_at DESC, source_path DESC, source_modified_ns DESC, source_size DESC) AS rn
  FROM ocr_results WHERE asset_id IS NOT NULL) WHERE rn = 1)"""
USABLE = "len(embedding) = {w} AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
FOLDER = "(CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END)"
NAME = "regexp_replace(path, '^.*/', '')"
EXT = "lower(regexp_extract(regexp_replace(replace(path, '\\', '/'), '^.*/', ''), '^.+\\.([^.]*)$', 1))"


def cur(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.current(table(spark, folder, "assets"))


def txt(spark: SparkSession, folder: str) -> DataFrame:
    return search.distinct_texts(table(spark, folder, "ocr_results").where(F.col("asset_id").isNotNull()))


def _usable(c: str, width: int):
    return V.is_valid(F.col(c), width) & F.exists(c, lambda x: x != 0)


def query_vector(spark: SparkSession, folder: str, name: str = "ocr_embedding_state", key: str = "asset_id", width: int = 64, place: int = 0) -> list[float]:
    """The usable vector of the smallest id, or the next ones. Looked up once in an application, as a caller has its query."""
    at = (spark.sparkContext.applicationId, folder, name, key, width, place)
    if at not in _vectors:
        _vectors[at] = _query_vector(spark, folder, name, key, width, place)
    return _vectors[at]


_vectors: dict[tuple, list[float]] = {}


def _query_vector(spark, folder, name, key, width, place) -> list[float]:
    rows = table(spark, folder, name)
    if name == "ocr_embedding_state":
        rows = rows.where(F.col("space") == "ocrText")
    least = rows.where(_usable("embedding", width)).groupBy(key).agg(F.min("embedding").alias("e")).orderBy(key).limit(place + 1).collect()
    return list(least[-1]["e"]) if least else [1.0] * width


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- catalog


@query(f"WITH {CUR} SELECT asset_id, {NAME} AS display_name, source_modified_ns AS timeline_ns FROM cur WHERE {SCOPE_SQL} ORDER BY 3 DESC, 1 DESC LIMIT {LIMIT}")
def gallery_modified(spark, folder):
    return catalog.gallery(cur(spark, folder), SCOPE, limit=LIMIT).select("asset_id", "display_name", "timeline_ns")


@query(f"""WITH {CUR} SELECT asset_id, coalesce(exif_taken_ns, source_modified_ns) AS timeline_ns, {EXT} AS extension,
 {FOLDER} AS folder_path FROM cur WHERE {SCOPE_SQL} ORDER BY 2 DESC, 1 DESC LIMIT {LIMIT}""")
def gallery_capture(spark, folder):
    return catalog.gallery(cur(spark, folder), SCOPE, CAPTURE, LIMIT).select("asset_id", "timeline_ns", "extension", "folder_path")


@query(f"WITH {CUR} SELECT count(*) AS assets FROM cur WHERE {SCOPE_SQL}")
def gallery_count(spark, folder):
    return catalog.in_scope(cur(spark, folder), SCOPE).agg(F.count("*").alias("assets"))


@query(f"WITH {CUR} SELECT asset_id, path FROM cur WHERE {SCOPE_SQL}")
def in_scope_ids(spark, folder):
    return catalog.in_scope(cur(spark, folder), SCOPE).select("asset_id", "path")


IDS = [90, 7, 41, 7, 10**9, 2, 55]


@query(f"WITH {CUR}, want AS (SELECT unnest({IDS}) AS asset_id, unnest(range({len(IDS)})) AS position) SELECT asset_id, CAST(position AS INTEGER) AS position, path FROM cur JOIN want USING (asset_id)")
def get_many_ordered(spark, folder):
    return catalog.get_many(cur(spark, folder), IDS).select("asset_id", "position", "path")


@query(f"WITH {CUR} SELECT asset_id, path FROM cur WHERE path = (SELECT min(path) FROM cur)")
def asset_by_path(spark, folder):
    rows = cur(spark, folder)
    return rows.where(F.col("path") == rows.agg(F.min("path")).first()[0]).select("asset_id", "path")


@query(f"""WITH {CUR}, snap AS (SELECT {FOLDER} AS p, max(source_modified_ns) AS modified_ns FROM cur GROUP BY 1),
 u AS (SELECT p, modified_ns FROM snap UNION ALL SELECT unnest(['/library/scans', '/library/family']), NULL)
 SELECT p AS path, max(modified_ns) AS modified_ns FROM u WHERE (p IN ('/library/scans', '/library/family', '/library', '/') OR starts_with(p, '/library/scans/') OR starts_with(p, '/library/family/'))
 AND NOT (p = '/library/scans/2020' OR starts_with(p, '/library/scans/2020/')) GROUP BY p""")
def folder_listing(spark, folder):
    snapshots = cur(spark, folder).groupBy(paths.folder(F.col("path")).alias("path")).agg(F.max("source_modified_ns").alias("modified_ns"))
    return catalog.folder_listing(list(SCOPE.include), snapshots, SCOPE)


# --- filters


def _filtered(spark, folder, filters: Filters) -> DataFrame:
    return cur(spark, folder).where(filters.column(F.col("path"))).select("asset_id")


LOW = "lower(replace(path, '\\', '/'))"


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE contains({LOW}, 'scan_')")
def filter_path_substring(spark, folder):
    return _filtered(spark, folder, Filters(patterns=("SCAN_",)))


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE regexp_full_match({LOW}, '/library/.*/20[0-9?]?.*/.*\\.png', 's') AND regexp_matches({LOW}, '^/library/.*/201./.*\\.png$', 's')")
def filter_path_glob(spark, folder):
    return _filtered(spark, folder, Filters(patterns=("/library/*/201?/*.png",)))


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE regexp_matches(regexp_replace({LOW}, '^.*/', ''), '^img_....*\\.jpg$', 's') AND NOT contains({LOW}, 'inbox')")
def filter_name_glob(spark, folder):
    return _filtered(spark, folder, Filters(patterns=("img_???*.jpg",), exclude_patterns=("inbox", " ")))


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE {EXT} IN ('jpg', 'webp')")
def filter_ext(spark, folder):
    return _filtered(spark, folder, Filters(extensions=(".JPG", "webp", " ")))


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE {EXT} NOT IN ('jpg', 'png') AND {SCOPE_SQL}")
def filter_ext_exclude(spark, folder):
    return _filtered(spark, folder, Filters(scope=SCOPE, exclude_extensions=("jpg", "png")))


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE coalesce(exif_taken_ns, source_modified_ns) >= {FROM_NS} AND coalesce(exif_taken_ns, source_modified_ns) < {TO_NS}")
def filter_time_half_open(spark, folder):
    return _filtered(spark, folder, Filters(time=TimeRange(CAPTURE, FROM_NS, TO_NS)))


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE starts_with(path, '/library/scans/20')  AND starts_with(path, '/library/scans/201/')")
def scope_sibling_prefix(spark, folder):
    return _filtered(spark, folder, Filters(scope=PathScope.of(["/library/scans/201/"])))


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE starts_with(path, '/library/family/2018/')")
def focus_scope(spark, folder):
    return _filtered(spark, folder, Filters(scope=SCOPE.focused("/library/family/2018")))


# --- files

NAT_SQL = "array_to_string(list_transform(regexp_extract_all(lower({t}), '([0-9]+|[^0-9]+)', 1), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN '0' || lpad(CAST(len(ltrim(r, '0')) AS VARCHAR), 10, '0') || ltrim(r, '0') ELSE r END), '')"


@query(f"""WITH {CUR}, hit AS (SELECT asset_id, {NAME} AS display_name, {NAT_SQL.format(t=NAME)} AS k FROM cur WHERE {SCOPE_SQL} AND contains(lower({NAME}), 'scan'))
 SELECT asset_id, display_name, CAST(row_number() OVER (ORDER BY k, asset_id) AS INTEGER) AS place FROM hit ORDER BY k, asset_id LIMIT {LIMIT}""")
def file_search_name_natural(spark, folder):
    rows = catalog.search_files(cur(spark, folder), SCOPE, "Scan", "name", LIMIT).withColumn("k", paths.natural_key(paths.file_name(F.col("path"))))
    return search.stamp_ranks(rows, F.col("k"), F.col("asset_id"), name="place").select("asset_id", paths.file_name(F.col("path")).alias("display_name"), "place")


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE {SCOPE_SQL} AND regexp_matches({LOW}, '^/library/fam.*\\.jpg$', 's')")
def file_search_path_glob(spark, folder):
    return catalog.search_files(cur(spark, folder), SCOPE, "/library/fam*.jpg", "path").select("asset_id")


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE {SCOPE_SQL}")
def file_search_empty_query(spark, folder):
    return catalog.search_files(cur(spark, folder), SCOPE, " ").select("asset_id")


# --- text

BM25 = """stats AS (SELECT count(*) AS n, avg(greatest(length(content) - 2, 0)) AS avgl, count_if(contains(lower(content), '{p}')) AS df FROM txt),
scored AS (SELECT asset_id, source_modified_ns, content, source_path,
  (length(lower(content)) - length(replace(lower(content), '{p}', ''))) / {l} AS f, greatest(length(content) - 2, 0) AS len FROM txt WHERE contains(lower(content), '{p}')),
ranked AS (SELECT *, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgl)) AS score FROM scored, stats)"""


@query(f"WITH {TXT}, {BM25.format(p=PHRASE, l=len(PHRASE))} SELECT asset_id, round(score, 6) AS score FROM ranked")
def ocr_simple_bm25(spark, folder):
    return search.simple(txt(spark, folder), PHRASE).select("asset_id", F.round("score", 6).alias("score"))


@query(f"WITH {TXT} SELECT asset_id FROM txt WHERE contains(lower(content), 'door that') AND NOT contains(lower(content), 'lantern')")
def ocr_match_bool(spark, folder):
    return search.match(txt(spark, folder), BOOLEAN).select("asset_id")


WORDS_SQL = "regexp_extract_all(lower(strip_accents(content)), '[\\p{L}\\p{N}]+')"
GLOB_SQL = f"WITH {TXT}, hit AS (SELECT asset_id, CAST(len(list_filter({WORDS_SQL}, lambda w: regexp_full_match(w, 'harb.*'))) AS INTEGER) AS matching_words FROM txt) SELECT asset_id, matching_words FROM hit WHERE matching_words > 0"


@query(GLOB_SQL)
def ocr_glob_words(spark, folder):
    return search.glob(txt(spark, folder), GLOB).select("asset_id", "matching_words")


@query(GLOB_SQL)
def ocr_glob_by_index(spark, folder):
    rows = txt(spark, folder)
    return search.glob_by_index(search.postings(rows), rows, GLOB).select("asset_id", F.col("matching_words").cast("int").alias("matching_words"))


@query(f"WITH {TXT} SELECT asset_id FROM txt WHERE regexp_matches(content, '[0-9]{{3}} of them') ORDER BY source_modified_ns DESC, asset_id LIMIT {LIMIT}")
def ocr_regex(spark, folder):
    return search.regex(txt(spark, folder), REGEX, LIMIT).select("asset_id")


@query(f"WITH {TXT} SELECT count(*) AS n, round(avg(greatest(length(content) - 2, 0)), 6) AS average, count_if(contains(lower(content), '{PHRASE}')) AS df FROM txt")
def bm25_statistics(spark, folder):
    return txt(spark, folder).agg(F.count("*").alias("n"), F.round(F.avg(F.greatest(F.length("content") - 2, F.lit(0))), 6).alias("average"), F.count_if(F.contains(F.lower("content"), F.lit(PHRASE))).alias("df"))


# --- vectors

QV = "q AS (SELECT min(embedding)::DOUBLE[] AS v FROM ocr_embedding_state WHERE space = 'ocrText' AND " + USABLE.format(w=64) + " GROUP BY asset_id ORDER BY asset_id LIMIT 1 OFFSET {n})"
TEXT_HITS = f"""hits AS (SELECT DISTINCT t.asset_id, 1 - list_cosine_similarity(s.embedding::DOUBLE[], q.v) AS distance, t.source_modified_ns, t.content FROM ocr_embedding_state s, q, txt t
 WHERE s.space = 'ocrText' AND {USABLE.format(w=64).replace('embedding', 's.embedding')} AND s.asset_id = t.asset_id AND s.source_modified_ns = t.source_modified_ns AND s.source_size = t.source_size AND {SCOPE_SQL.replace('path', 't.source_path')})"""


def _text_hits(spark, folder, place: int = 0) -> DataFrame:
    rows = txt(spark, folder).where(SCOPE.column(F.col("source_path")))
    return search.text_vectors(table(spark, folder, "ocr_embedding_state"), rows, query_vector(spark, folder, place=place), "ocrText")


@query(f"WITH {TXT}, {QV.format(n=0)}, {TEXT_HITS} SELECT asset_id, round(distance, 6) AS distance, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY round(distance, 9), source_modified_ns DESC, asset_id LIMIT 50")
def text_vector_search(spark, folder):
    hits = _text_hits(spark, folder).select("asset_id", F.round("distance", 9).alias("distance"), "source_modified_ns")
    return search.with_total(hits, 50, "distance", "-source_modified_ns", "asset_id").select("asset_id", F.round("distance", 6).alias("distance"), "total")


@query(f"WITH {TXT}, {QV.format(n=0)}, {TEXT_HITS} SELECT asset_id, round(distance, 6) AS distance, substring(content, 1, 240) AS excerpt FROM hits WHERE distance <= 0.9")
def text_vector_ceiling(spark, folder):
    hits = _text_hits(spark, folder).where("distance <= 0.9").drop("content")
    return search.late_text(hits.select("asset_id", F.round("distance", 6).alias("distance")), txt(spark, folder))


@query(f"WITH {TXT}, {QV.format(n=0)}, {TEXT_HITS} SELECT (SELECT count(*) FROM hits) AS total, CAST(NULL AS BIGINT) AS asset_id")
def vector_total_limit_zero(spark, folder):
    hits = _text_hits(spark, folder).select("asset_id", "distance")
    return search.with_total(hits, 0, "distance").select("total", "asset_id")


IMAGE_Q = "q AS (SELECT min(embedding)::DOUBLE[] AS v FROM image_embedding_samples WHERE " + USABLE.format(w=96) + " GROUP BY embedding_id ORDER BY embedding_id LIMIT 1)"
IMAGE_HITS = f"""st AS (SELECT DISTINCT asset_id, source_modified_ns, source_size, sampling_version FROM image_embedding_state),
hits AS (SELECT DISTINCT c.asset_id, s.embedding_id, s.timestamp_ms, 1 - list_cosine_similarity(s.embedding::DOUBLE[], q.v) AS distance, c.source_modified_ns
 FROM image_embedding_samples s JOIN st USING (asset_id) JOIN cur c ON c.asset_id = s.asset_id AND c.source_modified_ns = st.source_modified_ns AND c.source_size = st.source_size, q
 WHERE {USABLE.format(w=96).replace('embedding', 's.embedding')} AND {SCOPE_SQL.replace('path', 'c.path')}
 AND ((c.media_kind = 'image' AND st.sampling_version = 0 AND s.timestamp_ms IS NULL) OR (c.media_kind = 'video' AND st.sampling_version = 4 AND s.timestamp_ms IS NOT NULL))),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY round(distance, 9), timestamp_ms NULLS FIRST, embedding_id) AS rn FROM hits) WHERE rn = 1)"""


def _image_hits(spark, folder) -> DataFrame:
    q = query_vector(spark, folder, "image_embedding_samples", "embedding_id", 96)
    rows = search.image_vectors(table(spark, folder, "image_embedding_samples"), table(spark, folder, "image_embedding_state"), catalog.in_scope(cur(spark, folder), SCOPE), q)
    return search.best_frame(rows.withColumn("distance", F.round("distance", 9)))


@query(f"WITH {CUR}, {IMAGE_Q}, {IMAGE_HITS} SELECT asset_id, embedding_id, timestamp_ms, round(distance, 6) AS distance FROM best ORDER BY round(distance, 9), source_modified_ns DESC, asset_id LIMIT 100")
def image_search_best_frame(spark, folder):
    return search.nearest(_image_hits(spark, folder), 100).select("asset_id", "embedding_id", "timestamp_ms", F.round("distance", 6).alias("distance"))


@query(f"WITH {CUR}, {IMAGE_Q}, {IMAGE_HITS} SELECT count(*) AS total, count_if(distance <= 0.8) AS near FROM best")
def image_search_totals(spark, folder):
    return _image_hits(spark, folder).agg(F.count("*").alias("total"), F.count_if(F.col("distance") <= 0.8).alias("near"))


@query(f"""WITH {CUR}, {IMAGE_Q}, {IMAGE_HITS}, one AS (SELECT min(asset_id) AS a FROM hits) SELECT asset_id, embedding_id, timestamp_ms FROM hits, one WHERE asset_id = a
 ORDER BY timestamp_ms NULLS FIRST, embedding_id LIMIT 1""")
def current_vector(spark, folder):
    least = _image_hits(spark, folder).agg(F.min("asset_id")).first()[0] or 0
    return search.current_vector(table(spark, folder, "image_embedding_samples"), table(spark, folder, "image_embedding_state"), cur(spark, folder), least, 96).select("asset_id", "embedding_id", "timestamp_ms")


@query(f"""WITH {TXT}, {QV.format(n=0).replace('q AS', 'q1 AS')}, {QV.format(n=1).replace('q AS', 'q2 AS')},
 mix AS (SELECT list_transform(range(1, 65), lambda i: CAST(q1.v[i] - 0.5 * q2.v[i] AS DOUBLE)) AS m FROM q1, q2), q AS (SELECT m AS v FROM mix), {TEXT_HITS}
 SELECT asset_id, round(distance, 5) AS distance FROM hits""")
def composite_query_search(spark, folder):
    mixed = V.combine([(1.0, query_vector(spark, folder)), (-0.5, query_vector(spark, folder, place=1))])
    rows = txt(spark, folder).where(SCOPE.column(F.col("source_path")))
    return search.text_vectors(table(spark, folder, "ocr_embedding_state"), rows, mixed, "ocrText").select("asset_id", F.round("distance", 5).alias("distance"))


# --- fusion

FUSE = f"""a AS (SELECT asset_id, row_number() OVER (ORDER BY round(score, 9), source_modified_ns DESC, asset_id) AS rank, substring(content, 1, 40) AS snippet FROM ranked QUALIFY rank <= 100),
b AS (SELECT asset_id, row_number() OVER (ORDER BY source_modified_ns DESC, asset_id) AS rank FROM txt WHERE regexp_matches(content, '[0-9]{{3}} of them') QUALIFY rank <= 100),
u AS (SELECT asset_id, rank, snippet, 'words' AS key, 0 AS position, W1 AS weight FROM a UNION ALL SELECT asset_id, rank, NULL, 'numbers', 1, 1.0 FROM b),
f AS (SELECT asset_id, sum(weight / (60 + rank)) AS score, min_by(snippet, position) FILTER (snippet IS NOT NULL) AS snippet, string_agg(key || ':' || rank, ',' ORDER BY position) AS sources FROM u GROUP BY asset_id),
top AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, asset_id) AS place FROM f QUALIFY place <= 50)"""


def _fused(spark, folder, weight: float) -> DataFrame:
    rows = txt(spark, folder)
    a = search.simple(rows, PHRASE).withColumn("score", F.round("score", 9)).orderBy("score", F.desc("source_modified_ns"), "asset_id").limit(100)
    a = search.stamp_ranks(a, F.col("score"), F.desc("source_modified_ns"), F.col("asset_id")).withColumn("snippet", F.substring("content", 1, 40))
    b = search.stamp_ranks(search.regex(rows, REGEX, 100), F.desc("source_modified_ns"), F.col("asset_id"))
    return fusion.fuse([fusion.labelled(a, "words", 0, weight), fusion.labelled(b, "numbers", 1)], limit=50)


FUSE_HEAD = f"WITH {TXT}, {BM25.format(p=PHRASE, l=len(PHRASE))}, "


@query(FUSE_HEAD + FUSE.replace("W1", "1.0") + " SELECT CAST(place AS INTEGER) AS rank, asset_id, round(score, 6) AS score, snippet FROM top")
def rrf_two_modes(spark, folder):
    return _fused(spark, folder, 1.0).select("rank", "asset_id", F.round("score", 6).alias("score"), "snippet")


@query(FUSE_HEAD + FUSE.replace("W1", "3.0") + " SELECT CAST(place AS INTEGER) AS rank, asset_id, round(score, 6) AS score FROM top")
def rrf_weighted(spark, folder):
    return _fused(spark, folder, 3.0).select("rank", "asset_id", F.round("score", 6).alias("score"))


@query(FUSE_HEAD + FUSE.replace("W1", "1.0") + " SELECT asset_id, sources FROM top")
def rrf_sources(spark, folder):
    return _fused(spark, folder, 1.0).select("asset_id", F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["key"], s["rank"].cast("string"))), ",").alias("sources"))


@query()
def multi_mode_search(spark, folder):
    engine = R.Engine(cur(spark, folder), txt(spark, folder), table(spark, folder, "ocr_embedding_state"), table(spark, folder, "image_embedding_samples"), table(spark, folder, "image_embedding_state"))
    asked = R.SearchRequest(
        (
            R.Query("near", "vector", components=(R.Component(1.0, query_vector(spark, folder)),)),
            R.Query("images", "image", components=(R.Component(1.0, query_vector(spark, folder, "image_embedding_samples", "embedding_id", 96)),), weight=2.0),
            R.Query("words", "ocrSimple", PHRASE),
            R.Query("globs", "ocrGlob", GLOB),
            R.Query("names", "name", "scan"),
        ),
        filters=Filters(scope=SCOPE),
    )
    return engine.search(asked).withColumn("score", F.round("score", 6))


# --- coverage and pending work

EMB = "emb AS (SELECT DISTINCT asset_id, source_modified_ns, source_size FROM ocr_embedding_state WHERE space = 'ocrText' AND embedding IS NOT NULL)"
FP = "asset_id, source_modified_ns, source_size"
STILL = "media_kind = 'image' AND media_format IN ('png', 'jpeg', 'gif', 'webp')"


@query(f"""WITH {TXT}, {EMB} SELECT count(*) AS indexed, count(e.asset_id) AS embedded, count_if(trim(content, ' ') <> '') AS with_text, count_if(trim(content, ' ') <> '' AND e.asset_id IS NULL) AS pending,
 max(t.source_modified_ns) AS last_indexed_ns FROM txt t LEFT JOIN emb e ON t.asset_id = e.asset_id AND t.source_modified_ns = e.source_modified_ns AND t.source_size = e.source_size""")
def text_coverage(spark, folder):
    return coverage.text_coverage(txt(spark, folder), table(spark, folder, "ocr_embedding_state"), "ocrText")


@query(f"""WITH {CUR}, have AS (SELECT DISTINCT asset_id FROM image_embedding_samples WHERE embedding IS NOT NULL),
 st AS (SELECT DISTINCT {FP}, sampling_version FROM image_embedding_state WHERE asset_id IN (SELECT asset_id FROM have))
 SELECT count(*) AS total, count_if(EXISTS (SELECT 1 FROM st WHERE st.asset_id = cur.asset_id AND st.source_modified_ns = cur.source_modified_ns AND st.source_size = cur.source_size
  AND st.sampling_version = CASE WHEN media_kind = 'video' THEN 4 ELSE 0 END)) AS indexed
 FROM cur WHERE media_kind = 'video' OR (media_kind = 'image' AND media_format IN ('png', 'jpeg', 'gif', 'webp', 'bmp'))""")
def image_coverage(spark, folder):
    return coverage.image_coverage(cur(spark, folder), table(spark, folder, "image_embedding_state"), table(spark, folder, "image_embedding_samples"))


@query(f"WITH {TXT}, {EMB} SELECT asset_id, source_modified_ns FROM txt WHERE trim(content, ' ') <> '' AND ({FP}) NOT IN (SELECT ({FP}) FROM emb) ORDER BY source_modified_ns DESC, asset_id DESC LIMIT {LIMIT}".replace(f"({FP}) NOT IN (SELECT ({FP}) FROM emb)", "NOT EXISTS (SELECT 1 FROM emb e WHERE e.asset_id = txt.asset_id AND e.source_modified_ns = txt.source_modified_ns AND e.source_size = txt.source_size)"))
def text_backlog(spark, folder):
    return coverage.text_backlog(txt(spark, folder), table(spark, folder, "ocr_embedding_state"), "ocrText", LIMIT, 1000).select("asset_id", "source_modified_ns")


@query(f"""WITH {CUR} SELECT asset_id FROM cur WHERE {STILL} AND coalesce(width <= 4000 AND height <= 4000, true)
 AND NOT EXISTS (SELECT 1 FROM ocr_results o WHERE o.asset_id = cur.asset_id AND o.source_modified_ns = cur.source_modified_ns AND o.source_size = cur.source_size)""")
def ocr_pending(spark, folder):
    return coverage.pending_recognition(cur(spark, folder), table(spark, folder, "ocr_results"), largest=4000).select("asset_id")


@query(f"""WITH {CUR}, want AS (SELECT *, CASE WHEN media_kind = 'video' THEN 4 ELSE 0 END AS v FROM cur WHERE media_kind = 'video' OR (media_kind = 'image' AND media_format IN ('png', 'jpeg', 'gif', 'webp', 'bmp')))
 SELECT asset_id FROM want w WHERE NOT EXISTS (SELECT 1 FROM image_embedding_state s WHERE s.asset_id = w.asset_id AND s.source_modified_ns = w.source_modified_ns AND s.source_size = w.source_size AND s.sampling_version = w.v)
 OR (media_kind = 'video' AND NOT EXISTS (SELECT 1 FROM thumbnails t WHERE t.generator_version = 3 AND t.asset_id = w.asset_id AND t.source_modified_ns = w.source_modified_ns AND t.source_size = w.source_size))""")
def image_pending(spark, folder):
    return coverage.pending_images(cur(spark, folder), table(spark, folder, "image_embedding_state"), table(spark, folder, "thumbnails"), 3).select("asset_id")


@query(f"""WITH {CUR} SELECT c.asset_id, CASE max(CASE WHEN s.asset_id IS NULL THEN 0 WHEN s.source_modified_ns = c.source_modified_ns AND s.source_size = c.source_size THEN 2 ELSE 1 END)
 WHEN 2 THEN 'indexed' WHEN 1 THEN 'stale' ELSE 'notIndexed' END AS state FROM cur c LEFT JOIN image_embedding_state s ON s.asset_id = c.asset_id GROUP BY c.asset_id""")
def index_states(spark, folder):
    return coverage.index_states(cur(spark, folder).select(*search.fingerprint()), table(spark, folder, "image_embedding_state"))


@query(f"""WITH {CUR}, {EMB} SELECT DISTINCT c.asset_id, CASE WHEN o.content IS NULL THEN 'notIndexed' WHEN trim(o.content, ' ') = '' THEN 'noText' WHEN e.asset_id IS NOT NULL THEN 'embedded' ELSE 'pending' END AS label
 FROM cur c LEFT JOIN ocr_results o ON o.asset_id = c.asset_id AND o.source_modified_ns = c.source_modified_ns AND o.source_size = c.source_size
 LEFT JOIN emb e ON e.asset_id = c.asset_id AND e.source_modified_ns = c.source_modified_ns AND e.source_size = c.source_size WHERE {STILL}""")
def text_labels(spark, folder):
    return coverage.text_labels(cur(spark, folder), table(spark, folder, "ocr_results"), table(spark, folder, "ocr_embedding_state"), "ocrText")


# --- maintenance


def _orphans(name, spark, folder):
    return upkeep.without_parent(table(spark, folder, name), table(spark, folder, "assets"))


for _name, _key in (("ocr_results", "orphans_ocr"), ("image_embedding_samples", "orphans_vectors"), ("thumbnails", "orphans_thumbnails")):
    QUERIES[_key] = partial(_orphans, _name)
    SQL[_key] = f"SELECT DISTINCT asset_id FROM {_name} d WHERE asset_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM assets a WHERE a.asset_id = d.asset_id)"


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE starts_with(path, '/library/family/') AND path NOT IN (SELECT source_path FROM ocr_results WHERE source_path IS NOT NULL)")
def unseen_under_root(spark, folder):
    seen = table(spark, folder, "ocr_results").select(F.col("source_path").alias("path"))
    return catalog.unseen(cur(spark, folder), seen, "/library/family").select("asset_id")


FOUND = """found AS (SELECT path, max(source_modified_ns) AS source_modified_ns, max(source_size) AS source_size, max(source_created_ns) AS source_created_ns FROM assets WHERE seen_at < TIMESTAMP '2023-07-01' GROUP BY path)"""


def _found(spark, folder) -> DataFrame:
    early = table(spark, folder, "assets").where(F.col("seen_at") < F.lit("2023-07-01").cast("timestamp_ntz"))
    return early.groupBy("path").agg(*[F.max(c).alias(c) for c in ("source_modified_ns", "source_size", "source_created_ns")])


@query(f"""WITH {CUR}, {FOUND} SELECT f.path, c.asset_id AS known_id, CASE WHEN c.asset_id IS NULL THEN 'new'
 WHEN f.source_modified_ns IS NOT DISTINCT FROM c.source_modified_ns AND f.source_size IS NOT DISTINCT FROM c.source_size AND c.metadata_version = 2 THEN
  CASE WHEN f.source_created_ns IS NOT DISTINCT FROM c.source_created_ns THEN 'unchanged' ELSE 'metadata' END ELSE 'changed' END AS state
 FROM found f LEFT JOIN cur c ON c.path = f.path""")
def upsert_classify(spark, folder):
    return catalog.classify(_found(spark, folder), cur(spark, folder), 2).select("path", "known_id", "state")


@query(f"""WITH {CUR}, old AS (SELECT path, min(asset_id) AS asset_id, max(source_size) AS source_size FROM cur WHERE asset_id % 3 <> 0 GROUP BY path), scan AS (SELECT path, max(source_size) + 1 AS source_size FROM cur WHERE asset_id % 2 = 0 GROUP BY path),
 fresh AS (SELECT path, source_size, (SELECT max(asset_id) FROM old) + row_number() OVER (ORDER BY path) AS asset_id FROM scan WHERE path NOT IN (SELECT path FROM old))
 SELECT asset_id, path, source_size FROM old WHERE path NOT IN (SELECT path FROM scan) UNION ALL SELECT o.asset_id, s.path, s.source_size FROM scan s JOIN old o ON o.path = s.path UNION ALL SELECT asset_id, path, source_size FROM fresh""")
def upsert_apply(spark, folder):
    rows = cur(spark, folder)
    old = rows.where("asset_id % 3 <> 0").groupBy("path").agg(F.min("asset_id").alias("asset_id"), F.max("source_size").alias("source_size")).select("asset_id", "path", "source_size")
    scan = rows.where("asset_id % 2 = 0").groupBy("path").agg((F.max("source_size") + 1).alias("source_size"))
    return catalog.upsert(old, scan)


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE {SCOPE_SQL} AND NOT (starts_with(path, '/library/family/2018/') OR starts_with(path, '/library/scans/2019/'))")
def purge_candidates(spark, folder):
    others = [PathScope.of(["/library/family/2018"]), PathScope.of(["/library/scans/2019", "/mnt/gallery"])]
    return catalog.purgeable(cur(spark, folder), SCOPE, others).select("asset_id")


@query(f"""WITH d AS (SELECT {FOLDER} AS path, seen_at, source_modified_ns FROM assets),
 b AS (SELECT path, max(source_modified_ns) AS m FROM d WHERE seen_at < TIMESTAMP '2023-09-01' GROUP BY path), n AS (SELECT path, max(source_modified_ns) AS m FROM d WHERE seen_at >= TIMESTAMP '2023-03-01' GROUP BY path)
 SELECT coalesce(b.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'missing' WHEN b.path IS NULL THEN 'new' WHEN b.m IS NOT DISTINCT FROM n.m THEN 'unchanged' ELSE 'changed' END AS state FROM b FULL JOIN n ON b.path = n.path""")
def directory_diff(spark, folder):
    rows = table(spark, folder, "assets").select(paths.folder(F.col("path")).alias("path"), "seen_at", "source_modified_ns")
    side = lambda c: rows.where(c).groupBy("path").agg(F.max("source_modified_ns").alias("modified_ns"))
    return catalog.directory_diff(side(F.col("seen_at") < F.lit("2023-09-01").cast("timestamp_ntz")), side(F.col("seen_at") >= F.lit("2023-03-01").cast("timestamp_ntz")))


@query(f"""WITH {CUR}, f AS (SELECT DISTINCT {FOLDER} AS p FROM cur UNION SELECT unnest(['/library/scans', '/library', '/mnt/gallery']))
 SELECT o.p AS outer, i.p AS inner FROM f o JOIN f i ON starts_with(i.p, o.p || '/') AND o.p <> ''""".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'))
def nested_folders(spark, folder):
    own = cur(spark, folder).select(paths.folder(F.col("path")).alias("path"))
    more = spark.createDataFrame([("/library/scans",), ("/library",), ("/mnt/gallery",)], "path string")
    return catalog.nested_folders(own.unionByName(more).distinct())


@query("SELECT DISTINCT o.asset_id FROM ocr_results o WHERE EXISTS (SELECT 1 FROM assets a WHERE a.asset_id = o.asset_id AND a.source_modified_ns = o.source_modified_ns AND a.source_size = o.source_size)")
def fingerprint_semi(spark, folder):
    return search.currently(table(spark, folder, "ocr_results"), table(spark, folder, "assets")).select("asset_id").distinct()


@query("SELECT generator_version, count(*) AS thumbnails FROM thumbnails WHERE NOT (generator_version <> 3 AND asset_id IN (SELECT asset_id FROM image_embedding_state)) GROUP BY ALL")
def sweep_generators(spark, folder):
    kept = upkeep.sweep_generators(table(spark, folder, "thumbnails"), 3, table(spark, folder, "image_embedding_state").where(F.col("asset_id").isNotNull()))
    return kept.groupBy("generator_version").agg(F.count("*").alias("thumbnails"))


@query("""SELECT 'ocr_results' AS store, count(*) AS n FROM ocr_results WHERE asset_id NOT IN (SELECT asset_id FROM pruned_assets) UNION ALL SELECT 'thumbnails', count(*) FROM thumbnails WHERE asset_id NOT IN (SELECT asset_id FROM pruned_assets)
 UNION ALL SELECT 'assets', count(*) FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM pruned_assets)""")
def delete_everywhere(spark, folder):
    stores = {n: table(spark, folder, n) for n in ("ocr_results", "thumbnails", "assets")}
    left = upkeep.delete_assets(table(spark, folder, "pruned_assets"), stores)
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- media arithmetic


@query(f"""WITH {CUR} SELECT asset_id, CASE WHEN duration_ms > 0 THEN list_transform(range(greatest(3, least(12, (duration_ms + 2999) // 3000))), lambda i: CAST((2 * i + 1) * duration_ms // (2 * greatest(3, least(12, (duration_ms + 2999) // 3000))) AS BIGINT)) ELSE [] END AS targets
 FROM cur WHERE media_kind = 'video'""")
def sample_targets(spark, folder):
    return cur(spark, folder).where("media_kind = 'video'").select("asset_id", media.spread(F.col("duration_ms")).alias("targets"))


@query("""WITH t AS (SELECT DISTINCT asset_id, size_bucket, width, height FROM thumbnails WHERE generator_version = 3)
 SELECT asset_id, size_bucket FROM (SELECT asset_id, size_bucket, row_number() OVER (PARTITION BY asset_id ORDER BY (size_bucket < 256), CASE WHEN size_bucket >= 256 THEN size_bucket ELSE -size_bucket END) AS rn FROM t) WHERE rn = 1""")
def thumbnail_pick(spark, folder):
    rows = table(spark, folder, "thumbnails").where("generator_version = 3").select("asset_id", "size_bucket", "width", "height").distinct()
    return media.pick_thumbnail(rows, 256).select("asset_id", "size_bucket")


@query("SELECT DISTINCT width AS size, CASE WHEN width < 1 OR width > 1024 THEN NULL WHEN width <= 128 THEN 128 WHEN width <= 256 THEN 256 WHEN width <= 512 THEN 512 ELSE 1024 END AS bucket FROM thumbnails WHERE width IS NOT NULL")
def required_bucket(spark, folder):
    return table(spark, folder, "thumbnails").where("width IS NOT NULL").select(F.col("width").alias("size")).distinct().withColumn("bucket", media.required_bucket(F.col("size")))


@query(f"""WITH {CUR}, r AS (SELECT asset_id, width, height, least(640.0::DOUBLE / width, 640.0::DOUBLE / height) AS ratio FROM cur WHERE width > 0 AND height > 0)
 SELECT asset_id, CAST(greatest(floor(width * ratio + 0.5), 1) AS INTEGER) AS w, CAST(greatest(floor(height * ratio + 0.5), 1) AS INTEGER) AS h, CAST(greatest(floor(width * ratio / 32 + 0.5), 1) * 32 AS INTEGER) AS aligned FROM r""")
def fit_and_align(spark, folder):
    w, h = media.fit_within(F.col("width"), F.col("height"), 640)
    ratio = F.least(640.0 / F.col("width"), 640.0 / F.col("height"))
    return cur(spark, folder).where("width > 0 AND height > 0").select("asset_id", w.alias("w"), h.alias("h"), media.align(F.col("width"), ratio).alias("aligned"))


@query(f"""WITH {CUR}, a AS (SELECT asset_id, width, height, floor(256.0::DOUBLE * greatest(width, height) / least(width, height)) AS long FROM cur WHERE width > 0 AND height > 0),
 b AS (SELECT asset_id, CASE WHEN width <= height THEN 256 ELSE long END AS w, CASE WHEN width <= height THEN long ELSE 256 END AS h FROM a)
 SELECT asset_id, round((CASE WHEN w >= 224 THEN floor((w - 224) / 2) ELSE -floor((224 - w) / 2) END) / w, 6) AS x, round((CASE WHEN h >= 224 THEN floor((h - 224) / 2) ELSE -floor((224 - h) / 2) END) / h, 6) AS y, round(224.0::DOUBLE / w, 6) AS cw FROM b""")
def crop_regions(spark, folder):
    region = media.crop_shortest_edge(F.col("width"), F.col("height"), 256, 224)
    rows = cur(spark, folder).where("width > 0 AND height > 0").select("asset_id", region.alias("r"))
    return rows.select("asset_id", F.round("r.x", 6).alias("x"), F.round("r.y", 6).alias("y"), F.round("r.w", 6).alias("cw"))


@query(f"WITH {CUR} SELECT asset_id, CAST((source_modified_ns - ((source_modified_ns % 1000000000) + 1000000000) % 1000000000) // 1000000000 AS BIGINT) AS seconds FROM cur WHERE source_modified_ns IS NOT NULL")
def floor_seconds(spark, folder):
    return cur(spark, folder).where("source_modified_ns IS NOT NULL").select("asset_id", media.floor_seconds(F.col("source_modified_ns")).alias("seconds"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '4.999999 seconds' PRECEDING AND CURRENT ROW) / 5, 6) AS rate FROM events")
def rolling_throughput(spark, folder):
    return media.rolling_rate(table(spark, folder, "events"), "event_type", "ts", "value").select("event_id", F.round("rate", 6).alias("rate"))


@query("""WITH l AS (SELECT asset_id AS page, row_number() OVER (PARTITION BY asset_id ORDER BY size_bucket, generator_version, source_modified_ns, source_size, width, height) AS line, width::DOUBLE / height AS aspect FROM (SELECT DISTINCT asset_id, size_bucket, generator_version, source_modified_ns, source_size, width, height FROM thumbnails))
 SELECT page, line, CAST((row_number() OVER (PARTITION BY page ORDER BY aspect, line) - 1) // 2 AS INTEGER) AS batch FROM l""")
def aspect_batches(spark, folder):
    from pyspark.sql import Window

    key = ["size_bucket", "generator_version", "source_modified_ns", "source_size", "width", "height"]
    rows = table(spark, folder, "thumbnails").select("asset_id", *key).distinct()
    lines = rows.select(F.col("asset_id").alias("page"), F.row_number().over(Window.partitionBy("asset_id").orderBy(*key)).alias("line"), (F.col("width").cast("double") / F.col("height")).alias("aspect"))
    return media.aspect_batches(lines, 2).select("page", "line", "batch")


# --- scalar functions


@query(f"SELECT DISTINCT path, {EXT} AS extension, {NAME} AS name, {LOW} AS normal FROM assets")
def path_functions(spark, folder):
    p = F.col("path")
    return table(spark, folder, "assets").select("path", paths.extension(p).alias("extension"), paths.file_name(p).alias("name"), paths.normal_path(p).alias("normal")).distinct()


@query(f"SELECT DISTINCT path, {NAT_SQL.format(t='path')} AS natural FROM assets".replace("AS natural", 'AS "natural"'))
def natural_keys(spark, folder):
    return table(spark, folder, "assets").select("path", paths.natural_key(F.col("path")).alias("natural")).distinct()


STEM = "word"
for _suffix, _least, _new in reversed(words.SUFFIXES):
    STEM = f"CASE WHEN length(word) >= {_least} AND ends_with(word, '{_suffix}') AND NOT ends_with(word, 'ss') THEN left(word, length(word) - {len(_suffix)}) || '{_new}' ELSE {STEM} END" if STEM == "word" else f"CASE WHEN length(word) >= {_least} AND ends_with(word, '{_suffix}') AND NOT ends_with(word, 'ss') THEN left(word, length(word) - {len(_suffix)}) || '{_new}' ELSE ({STEM}) END"
VOCAB = "vocab AS (SELECT DISTINCT unnest(regexp_extract_all(lower(content), '[a-z]+')) AS word FROM ocr_results)"


def _vocabulary(spark, folder) -> DataFrame:
    return table(spark, folder, "ocr_results").select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()


@query(f"""WITH {VOCAB}, s AS (SELECT word, {STEM} AS st FROM vocab) SELECT word, CASE WHEN length(st) > 1 AND st[-1] = st[-2] AND NOT contains('aeious', st[-1]) THEN left(st, length(st) - 1) ELSE st END AS stem FROM s""")
def stems(spark, folder):
    return _vocabulary(spark, folder).select("word", words.stem(F.col("word")).alias("stem"))


@query(f"WITH {VOCAB} SELECT word FROM vocab WHERE length(word) >= 5 AND levenshtein(word, 'museum') <= 1")
def edit_distance_one(spark, folder):
    return _vocabulary(spark, folder).where((F.length("word") >= 5) & words.within_one_edit(F.col("word"), F.lit("museum")))


@query(f"WITH {TXT} SELECT asset_id, array_to_string({WORDS_SQL}, ' ') AS tokens FROM txt WHERE content IS NOT NULL")
def word_tokens(spark, folder):
    return txt(spark, folder).where("content IS NOT NULL").select("asset_id", F.array_join(words.tokens(F.col("content")), " ").alias("tokens"))


# --- tags, patches, recognition


def _tags(spark, folder) -> DataFrame:
    kind = F.element_at(F.array(F.lit("simple"), F.lit("subject"), F.lit("vibe")), F.pmod("label", F.lit(3)) + 1)
    return table(spark, folder, "embeddings").select(F.concat(F.lit("tag-"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("term"), kind.alias("kind"), F.when(F.col("label") == 9, "blocked").otherwise("safe").alias("sensitivity"), "embedding")


def _vec(spark, folder, place: int) -> list[float]:
    return list(table(spark, folder, "embeddings").where(F.col("vec_id") == place).first()["embedding"])


@query("""WITH q AS (SELECT (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[] AS v, (SELECT embedding FROM embeddings WHERE vec_id = 1)::DOUBLE[] AS m),
 s AS (SELECT 'tag-' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS term, ['simple', 'subject', 'vibe'][label % 3 + 1] AS kind, round(list_cosine_similarity(embedding::DOUBLE[], q.v) - list_cosine_similarity(embedding::DOUBLE[], q.m), 9) AS score FROM embeddings, q WHERE label <> 9),
 r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, term) AS rank FROM s) SELECT kind, term, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""")
def tag_topn_per_kind(spark, folder):
    known = tags.baselines(_tags(spark, folder), _vec(spark, folder, 1))
    return tags.top_tags(known, _vec(spark, folder, 0)).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), p AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, embedding::DOUBLE[] AS e FROM embeddings)
 SELECT label, CAST(place AS INTEGER) AS place, round(list_inner_product(e, q.v), 6) AS score FROM p, q""")
def patch_scores(spark, folder):
    grids = table(spark, folder, "embeddings").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]).alias("patches"))
    q = F.array(*[F.lit(float(x)) for x in _vec(spark, folder, 0)])
    return grids.select("label", F.posexplode(frames.patch_scores(F.col("patches"), q)).alias("place", "score")).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT label AS line, vec_id AS step, list_transform(range(1, 6), lambda i: embedding[i]) AS sc FROM embeddings), b AS (SELECT line, step, list_max(sc) AS v, 4 - list_position(list_reverse(sc), list_max(sc)) + 1 AS c FROM s),
 k AS (SELECT *, c <> 0 AND c IS DISTINCT FROM lag(c) OVER (PARTITION BY line ORDER BY step) AS kept FROM b)
 SELECT line, coalesce(string_agg(['A', 'B', 'C', 'D'][c], '' ORDER BY step) FILTER (kept), '') AS text, round(coalesce(avg(v::DOUBLE) FILTER (kept), 0), 6) AS score FROM k GROUP BY line""")
def ctc_decode(spark, folder):
    steps = table(spark, folder, "embeddings").select(F.col("label").alias("line"), F.col("vec_id").alias("step"), F.slice("embedding", 1, 5).alias("scores"))
    return frames.ctc(steps, ["A", "B", "C", "D"]).withColumn("score", F.round("score", 6))


@query()
def highlights(spark, folder):
    return txt(spark, folder).select("asset_id", highlight.highlights(F.col("content"), "restored harbours and the telescopes").alias("spans")).where(F.size("spans") > 0)


@query()
def snippets(spark, folder):
    rows = search.simple(txt(spark, folder), PHRASE, 100)
    return highlight.snippets(rows, PHRASE).select("asset_id", "snippet", "highlights")
