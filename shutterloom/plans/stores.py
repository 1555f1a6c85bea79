"""Queries of libraries, maintenance, batches of results, frames and smaller functions over the driver's tables, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.functions import instants, paths, words
from shutterloom.functions import vectors as V
from shutterloom.operators import catalog, coverage, filters, frames, highlight, hooks, libraries, media, search, tags, upkeep
from shutterloom.operators.filters import CAPTURE, TimeRange
from shutterloom.operators.scope import PathScope
from shutterloom.operators.text_index import TextIndex
from shutterloom.plans.media import BM25, CUR, EMB, EXT, FP, FROM_NS, LOW, PHRASE, QUERIES, SCOPE, SCOPE_SQL, SQL, STILL, TO_NS, TXT, USABLE, WORDS_SQL, _usable, cur, query, txt
from shutterloom.session import checkpoint_dir, table
from shutterloom.sources import files

__all__ = ["QUERIES", "SQL"]


#: Catalog columns that may be null; shown as -1 where whole rows are compared.
NULLABLE = ("source_created_ns", "exif_taken_ns", "width", "height", "frame_count", "duration_ms")


# --- full text by a kept index

_indexes: dict[tuple[str, str, str], TextIndex] = {}


def text_index(spark, folder, kind: str = "content") -> TextIndex:
    """The kept index of the recognised texts or of the catalog's paths, built at its first use in an application."""
    at = (spark.sparkContext.applicationId, folder, kind)
    if at not in _indexes:
        where = f"{checkpoint_dir(spark)}/text-index-{kind}-{abs(hash(at))}"
        _indexes[at] = TextIndex.build(txt(spark, folder) if kind == "content" else cur(spark, folder), where, text=kind)
    return _indexes[at]


@query(f"WITH {TXT}, {BM25.format(p=PHRASE, l=len(PHRASE))} SELECT asset_id, round(score, 6) AS score FROM ranked")
def ocr_simple_by_index(spark, folder):
    return search.simple(txt(spark, folder), PHRASE, index=text_index(spark, folder)).select("asset_id", F.round("score", 6).alias("score"))


@query(f"WITH {TXT} SELECT asset_id FROM txt WHERE regexp_matches(lower(content), 'museum.{{0,20}}?near|near.{{0,20}}museum', 's') OR (contains(lower(content), 'harbo') AND starts_with(lower(content), 'the'))")
def ocr_match_near(spark, folder):
    # within 16 and 18 trigrams: as many characters between the ends of either phrase and the start of the other
    return search.match(txt(spark, folder), "NEAR(museum near, 20) OR (harb* harbo* ^the)", index=text_index(spark, folder)).select("asset_id")


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE contains({LOW}, 'family')")
def path_search_by_index(spark, folder):
    rows = text_index(spark, folder, "path").narrowed(cur(spark, folder), ["family"])
    return rows.where(paths.path_matches(F.col("path"), "family")).select("asset_id")


@query(f"""WITH {TXT} SELECT 'simple' AS mode, count_if(contains(lower(content), '{PHRASE}')) AS total FROM txt
 UNION ALL SELECT 'match', count_if(contains(lower(content), 'door that') AND NOT contains(lower(content), 'lantern')) FROM txt
 UNION ALL SELECT 'glob', count_if(len(list_filter({WORDS_SQL}, lambda w: regexp_full_match(w, 'harb.*'))) > 0) FROM txt
 UNION ALL SELECT 'regex', count_if(regexp_matches(content, '[0-9]{{3}} of them')) FROM txt""")
def counts_per_mode(spark, folder):
    rows = txt(spark, folder)
    parts = [("simple", search.count_simple(rows, PHRASE)), ("match", search.count_match(rows, '"door that" NOT lantern')), ("glob", search.count_glob(rows, "harb*")), ("regex", search.count_regex(rows, "[0-9]{3} of them"))]
    out = None
    for mode, df in parts:
        one = df.select(F.lit(mode).alias("mode"), "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {TXT} SELECT asset_id, substring(content, 1, 512) AS excerpt FROM txt WHERE len(list_filter({WORDS_SQL}, lambda w: regexp_full_match(w, 'harb.*'))) > 0")
def glob_excerpts(spark, folder):
    return search.glob(txt(spark, folder), "harb*").select("asset_id", F.substring("content", 1, 512).alias("excerpt"))


# --- libraries

FIRST = libraries.Definition(("/library/scans", "/library/family"), ("/library/scans/2020",), text=True)
SECOND = libraries.Definition(("/library/family/2018", "/mnt/gallery"))


def registry() -> libraries.Registry:
    known, one = libraries.Registry().create(FIRST, "first import")
    known, _ = known.create(SECOND)
    known, again = known.create(SECOND, "first import")
    assert again is not None and again.library_id == one.library_id
    return known


@query("""SELECT * FROM (VALUES (1, '/library/scans', false, 0, 1, 1), (1, '/library/family', false, 1, 2, 0), (1, '/library/scans/2020', true, 2, 0, 0), (2, '/library/family/2018', false, 0, 1, 0), (2, '/mnt/gallery', false, 1, 2, 0))
 t(library_id, path, excluded, position, scan_requested, scan_completed)""")
def library_folders(spark, folder):
    known = registry()
    known = known.put(known.get(1).scanned("/library/scans", 1))
    return known.frames(spark)[1].select("library_id", "path", "excluded", "position", "scan_requested", "scan_completed")


@query("""SELECT * FROM (VALUES ('/library/scans', 'unhidden', 3), ('/library/family', 'unhidden', 2), ('/library/scans', 'images on', 3), ('/library/family', 'images on', 4), ('/library/scans/2020', 'images on', 0),
 ('/library/new', 'one more', 3), ('/library/scans', 'one more', 1), ('/library/family', 'one more', 2), ('/library/scans/2020', 'one more', 0)) t(path, change, scan_requested)""")
def library_rescans(spark, folder):
    one = registry().get(1)
    changes = {"unhidden": replace(FIRST, exclude=()), "images on": replace(FIRST, images=True), "one more": replace(FIRST, include=(*FIRST.include, "/library/new"))}
    rows = [(f.path, name, f.requested) for name, d in changes.items() for f in one.updated(d).folders]
    return spark.createDataFrame(rows, "path string, change string, scan_requested long")


@query("SELECT * FROM (VALUES ('/library/Scans', 1), ('/library/family', 2), ('/library/Scans/2020', 0)) t(path, scan_requested)")
def library_respelled(spark, folder):
    spelled = registry().get(1).respelled({"/library/scans": "/library/Scans", "/library/scans/2020": "/library/Scans/2020"})
    assert registry().get(1).respelled({"/library/scans": "/library/family"}) == registry().get(1)
    return spark.createDataFrame([(f.path, f.requested) for f in spelled.folders], "path string, scan_requested long")


@query("SELECT false AS pending_only, true AS \"full\", true AS force, false AS retry_failed, 4000 AS max_dimensions, 7 AS \"limit\"")
def merged_scan_requests(spark, folder):
    one = libraries.ScanRequest(max_dimensions=4000, limit=3).merged(libraries.ScanRequest(pending_only=False, full=True)).merged(libraries.ScanRequest(force=True, limit=7))
    return spark.createDataFrame([(one.pending_only, one.full, one.force, one.retry_failed, one.max_dimensions, one.limit)], "pending_only boolean, full boolean, force boolean, retry_failed boolean, max_dimensions int, limit int")


@query("""WITH f AS (SELECT DISTINCT path, asset_id % 5 AS r FROM assets), w AS (SELECT path, min(r) AS c, max(r) AS d FROM f GROUP BY path)
 SELECT path, CASE WHEN path < '/library/s' THEN greatest(d, c) + 1 ELSE d END AS scan_requested, CASE WHEN d % 2 = 0 THEN greatest(c, d) ELSE c END AS scan_completed FROM w""")
def scan_counters(spark, folder):
    known = table(spark, folder, "assets").groupBy("path").agg(F.min(F.col("asset_id") % 5).alias("scan_completed"), F.max(F.col("asset_id") % 5).alias("scan_requested")).withColumn("excluded", F.col("path") >= "/library/s")
    asked = upkeep.request_scans(known, [r.path for r in known.where("NOT excluded").select("path").toLocalIterator()])
    done = known.where("scan_requested % 2 = 0").select("path", F.col("scan_requested").alias("request"))
    return upkeep.complete_scans(asked, done).select("path", "scan_requested", "scan_completed")


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE starts_with(path, '/library/family/') AND NOT starts_with(path, '/library/family/2018/')")
def purge_in_folder(spark, folder):
    known = registry()
    return upkeep.purge(cur(spark, folder), known.get(1).definition.scope, known.covering(1), "/library/family").select("asset_id")


# --- reconcile and prune

GONE = f"{CUR}, shown AS (SELECT DISTINCT path FROM assets WHERE seen_at < TIMESTAMP '2023-06-01')"


def _listing(spark, folder, until: str) -> DataFrame:
    return table(spark, folder, "assets").where(F.col("seen_at") < F.lit(until).cast("timestamp_ntz")).select("path").distinct()


@query(f"""WITH {GONE}, again AS (SELECT DISTINCT path FROM assets WHERE seen_at < TIMESTAMP '2023-09-01')
 SELECT asset_id, path FROM cur WHERE starts_with(path, '/library/') AND path NOT IN (SELECT path FROM shown) AND path NOT IN (SELECT path FROM again)
 AND NOT starts_with(path, '/library/scans/2020/') AND NOT regexp_matches(path, '(^|/)(\\.cache|\\.thumb[^/]*)(/|$)')""")
def reconcile_missing(spark, folder):
    scope = upkeep.in_reconcile_scope(F.col("path"), "/library", exclude=("/library/scans/2020",))
    return upkeep.reconcile(cur(spark, folder), _listing(spark, folder, "2023-06-01"), "/library", True, scope, _listing(spark, folder, "2023-09-01"))


@query(f"WITH {CUR} SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS parent, count(*) AS n FROM cur WHERE regexp_matches(path, '^/library/family/2018/[^/]+$') GROUP BY 1")
def reconcile_direct_children(spark, folder):
    rows = cur(spark, folder).where(upkeep.in_reconcile_scope(F.col("path"), "/library/family/2018", recursive=False))
    return rows.groupBy(paths.folder(F.col("path")).alias("parent")).agg(F.count("*").alias("n"))


@query(f"""WITH {GONE}, gone AS (SELECT asset_id FROM cur WHERE starts_with(path, '/library/') AND path NOT IN (SELECT path FROM shown))
 SELECT 'thumbnails' AS store, count(*) AS rows, (SELECT count(*) FROM thumbnails) AS left FROM thumbnails WHERE asset_id IN (SELECT asset_id FROM gone)
 UNION ALL SELECT 'ocr_results', count(*), (SELECT count(*) FROM ocr_results) FROM ocr_results WHERE asset_id IN (SELECT asset_id FROM gone)""".replace("AS left", 'AS "left"').replace("AS rows", 'AS "rows"'))
def prune_dry_run(spark, folder):
    gone = upkeep.reconcile(cur(spark, folder), _listing(spark, folder, "2023-06-01"), "/library", True)
    stores, counts = upkeep.prune_missing({n: table(spark, folder, n) for n in ("thumbnails", "ocr_results")}, gone)
    sizes = None
    for name, df in stores.items():
        one = df.agg(F.count("*").alias("left")).select(F.lit(name).alias("store"), "left")
        sizes = one if sizes is None else sizes.unionByName(one)
    return counts.join(sizes, "store")


@query(f"WITH {CUR} SELECT asset_id FROM cur WHERE {SCOPE_SQL} AND coalesce(exif_taken_ns, source_modified_ns) >= {FROM_NS} AND coalesce(exif_taken_ns, source_modified_ns) < {TO_NS}")
def thumbnail_backfill(spark, folder):
    return coverage.thumbnail_backfill(cur(spark, folder), SCOPE, TimeRange(CAPTURE, FROM_NS, TO_NS)).select("asset_id")


# --- spaces


@query("""SELECT * FROM (SELECT space, model, dimensions, (SELECT count(*) FROM ocr_embedding_state s WHERE s.space = m.space) AS vectors FROM ocr_embedding_model m WHERE space <> 'ocrText')
 UNION ALL SELECT 'ocrText', 'other-model', 32, 0 UNION ALL SELECT 'fresh', 'first-model', 8, 0""")
def models_after_reset(spark, folder):
    models, state = table(spark, folder, "ocr_embedding_model").select("space", "model", "dimensions").distinct(), table(spark, folder, "ocr_embedding_state")
    models, state = upkeep.declare_model(models, state, "ocrText", "other-model", 32, reset=True)
    models, state = upkeep.declare_model(models, state, "fresh", "first-model", 8)
    counts = state.groupBy("space").agg(F.count("*").alias("vectors"))
    return models.join(counts, "space", "left").select("space", "model", "dimensions", F.coalesce("vectors", F.lit(0)).alias("vectors"))


@query("SELECT space, count(*) AS n FROM ocr_embedding_state WHERE space <> 'ocrTextWide' GROUP BY space")
def cleared_space(spark, folder):
    return upkeep.clear_space(table(spark, folder, "ocr_embedding_state"), "ocrTextWide").groupBy("space").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT asset_id, embedding_id FROM image_embedding_samples v WHERE NOT EXISTS (SELECT 1 FROM image_embedding_state s WHERE s.asset_id = v.asset_id)")
def vectors_without_state(spark, folder):
    samples, state = table(spark, folder, "image_embedding_samples"), table(spark, folder, "image_embedding_state")
    return upkeep.without_state(samples, state, ["asset_id"]).select("asset_id", "embedding_id").distinct()


# --- batches of results

EARLY = "TIMESTAMP '2023-06-01'"


def _halves(spark, folder, name: str, at: str = "written_at") -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, name).where(F.col("asset_id").isNotNull())
    split = F.col(at) < F.lit("2023-06-01").cast("timestamp_ntz")
    return rows.where(split), rows.where(~split)


@query(f"""WITH a AS (SELECT * FROM ocr_results WHERE asset_id IS NOT NULL AND written_at < {EARLY}), b AS (SELECT * FROM ocr_results WHERE asset_id IS NOT NULL AND written_at >= {EARLY})
 SELECT asset_id, count(*) AS n, max(written_at) AS written_at FROM (SELECT asset_id, written_at FROM a WHERE asset_id NOT IN (SELECT asset_id FROM b) UNION ALL SELECT asset_id, max(written_at) FROM b GROUP BY asset_id) GROUP BY asset_id""")
def stored_texts(spark, folder):
    old, new = _halves(spark, folder, "ocr_results")
    return upkeep.store_texts(old, new).groupBy("asset_id").agg(F.count("*").alias("n"), F.max("written_at").alias("written_at"))


GOOD_THUMB = "asset_id > 0 AND size_bucket IN (128, 256, 512, 1024) AND generator_version > 0 AND width BETWEEN 1 AND size_bucket AND height BETWEEN 1 AND size_bucket AND octet_length(data) > 0 AND source_size >= 0"


@query(f"""WITH t AS (SELECT * FROM thumbnails WHERE {GOOD_THUMB}), k AS (SELECT asset_id, size_bucket, generator_version, max(written_at) FILTER (written_at >= {EARLY}) AS w, count(*) FILTER (written_at < {EARLY}) AS n FROM t GROUP BY ALL)
 SELECT asset_id, size_bucket, generator_version, CASE WHEN w IS NULL THEN n ELSE 1 END AS n FROM k""")
def stored_thumbnails(spark, folder):
    old, new = _halves(spark, folder, "thumbnails")
    good = F.expr(GOOD_THUMB)
    return upkeep.store_thumbnails(old.where(good), new.where(good)).groupBy("asset_id", "size_bucket", "generator_version").agg(F.count("*").alias("n"))


@query(f"""WITH {TXT}, new AS (SELECT asset_id, min(source_size) AS run_id FROM (SELECT DISTINCT asset_id, source_size FROM thumbnails WHERE asset_id IS NOT NULL) GROUP BY asset_id),
 known AS (SELECT n.asset_id, t.source_modified_ns, t.source_size, n.run_id FROM new n JOIN txt t USING (asset_id))
 SELECT space, count(*) AS n, sum(run_id) AS runs FROM (SELECT space, run_id FROM ocr_embedding_state s WHERE NOT (space = 'ocrText' AND asset_id IN (SELECT asset_id FROM known)) UNION ALL SELECT 'ocrText', run_id FROM known) GROUP BY space""")
def saved_text_vectors(spark, folder):
    state = table(spark, folder, "ocr_embedding_state")
    new = table(spark, folder, "thumbnails").where("asset_id IS NOT NULL").groupBy("asset_id").agg(F.min("source_size").alias("run_id")).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    return upkeep.save_text_vectors(state, new, txt(spark, folder), "ocrText").groupBy("space").agg(F.count("*").alias("n"), F.sum("run_id").alias("runs"))


@query("""WITH new AS (SELECT * FROM image_embedding_samples WHERE embedding_id % 3 = 0 AND asset_id IS NOT NULL)
 SELECT asset_id, count(*) AS n FROM (SELECT asset_id FROM image_embedding_samples WHERE asset_id NOT IN (SELECT asset_id FROM new) UNION ALL SELECT asset_id FROM new) GROUP BY asset_id""")
def replaced_samples(spark, folder):
    rows = table(spark, folder, "image_embedding_samples").where("asset_id IS NOT NULL")
    return upkeep.replace_samples(rows, rows.where("embedding_id % 3 = 0")).groupBy("asset_id").agg(F.count("*").alias("n"))


@query(f"""WITH {CUR}, f AS (SELECT asset_id, source_modified_ns, source_size FROM cur WHERE asset_id % 7 = 0) SELECT asset_id FROM cur WHERE {STILL} AND asset_id % 7 <> 0
 AND NOT EXISTS (SELECT 1 FROM ocr_results o WHERE o.asset_id = cur.asset_id AND o.source_modified_ns = cur.source_modified_ns AND o.source_size = cur.source_size)""")
def pending_without_failures(spark, folder):
    rows = cur(spark, folder)
    failed = rows.where("asset_id % 7 = 0").select(*search.fingerprint())
    known = upkeep.failures(failed.withColumn("source_size", F.lit(-1).cast("long")), failed)
    return coverage.pending_recognition(rows, table(spark, folder, "ocr_results"), known).select("asset_id")


VIDEO_OK = """SELECT t.asset_id, t.source_modified_ns, t.source_size FROM need n JOIN have t USING (asset_id) GROUP BY ALL"""


@query("""WITH times AS (SELECT DISTINCT asset_id, timestamp_ms FROM image_embedding_samples WHERE timestamp_ms IS NOT NULL AND asset_id IS NOT NULL AND asset_id % 2 = 0),
 n AS (SELECT asset_id, min(timestamp_ms) AS first FROM times GROUP BY asset_id),
 wanted AS (SELECT asset_id, timestamp_ms, b FROM times JOIN n USING (asset_id), (SELECT unnest([128, 256, 512, 1024]) AS b) WHERE b < 1024 OR timestamp_ms = first),
 prints AS (SELECT DISTINCT asset_id, source_modified_ns, source_size FROM thumbnails WHERE asset_id IS NOT NULL),
 frames AS (SELECT DISTINCT p.*, t.timestamp_ms, b FROM prints p JOIN (SELECT DISTINCT asset_id, timestamp_ms FROM image_embedding_samples WHERE timestamp_ms IS NOT NULL) t USING (asset_id), (SELECT unnest([128, 256, 512, 1024]) AS b)
  WHERE NOT (p.source_size % 5 = 0 AND b = 256)),
 posters AS (SELECT asset_id, source_modified_ns, source_size FROM thumbnails WHERE generator_version = 3 AND size_bucket IN (128, 256) GROUP BY ALL HAVING count(DISTINCT size_bucket) = 2)
 SELECT p.asset_id, p.source_modified_ns, p.source_size FROM posters p WHERE p.asset_id IN (SELECT asset_id FROM times)
 AND NOT EXISTS (SELECT 1 FROM wanted w WHERE w.asset_id = p.asset_id AND NOT EXISTS (SELECT 1 FROM frames f WHERE f.asset_id = p.asset_id AND f.source_modified_ns = p.source_modified_ns AND f.source_size = p.source_size AND f.timestamp_ms = w.timestamp_ms AND f.b = w.b))""")
def videos_with_all_frames(spark, folder):
    samples = table(spark, folder, "image_embedding_samples").where("timestamp_ms IS NOT NULL AND asset_id IS NOT NULL")
    thumbs = table(spark, folder, "thumbnails").where("asset_id IS NOT NULL")
    made = thumbs.select(*search.fingerprint()).distinct().join(samples.select("asset_id", "timestamp_ms").distinct(), "asset_id").select("*", F.explode(F.array(*[F.lit(b) for b in media.BUCKETS])).alias("size_bucket"))
    made = made.where("NOT (source_size % 5 = 0 AND size_bucket = 256)")
    # the test tables seldom have all sizes of a poster: the two small ones stand for all
    big = F.explode(F.array(F.col("size_bucket"), F.col("size_bucket") * 4))
    posters = thumbs.where("size_bucket IN (128, 256)").select(*search.fingerprint(), "generator_version", big.alias("size_bucket"))
    return coverage.videos_with_all_frames(samples.where("asset_id % 2 = 0"), made, posters, 3)


@query(f"""WITH {CUR}, want AS (SELECT *, CASE WHEN media_kind = 'video' THEN 4 ELSE 0 END AS v FROM cur WHERE media_kind = 'image' AND media_format IN ('png', 'jpeg', 'gif', 'webp', 'bmp'))
 SELECT asset_id FROM want w WHERE NOT EXISTS (SELECT 1 FROM image_embedding_state s WHERE s.asset_id = w.asset_id AND s.source_modified_ns = w.source_modified_ns AND s.source_size = w.source_size AND s.sampling_version = w.v) ORDER BY asset_id LIMIT 25""")
def image_pending_limited(spark, folder):
    return coverage.pending_images(cur(spark, folder), table(spark, folder, "image_embedding_state"), table(spark, folder, "thumbnails"), 3, videos=False, limit=25).select("asset_id")


@query(f"SELECT DISTINCT path FROM assets WHERE {EXT} IN ('png', 'jpeg', 'jpg', 'gif', 'webp', 'bmp', 'mp4', 'm4v', 'mov', 'mkv', 'webm', 'avi', 'mpg', 'mpeg', 'm2ts') AND NOT regexp_matches(path, '(^|/)(\\.cache|\\.thumb[^/]*)(/|$)') AND path <> '/mnt' AND NOT starts_with(path, '/mnt/')")
def media_files(spark, folder):
    return table(spark, folder, "assets").where(filters.is_media(F.col("path")) & ~filters.is_excluded(F.col("path"), ["/mnt"])).select("path").distinct()


@query("SELECT DISTINCT path FROM assets WHERE (starts_with(path, '/library/scans/') OR starts_with(path, '/library/family/')) AND NOT starts_with(path, '/library/scans/2020/')")
def scope_on_values(spark, folder):
    inside = F.udf(SCOPE.contains, "boolean")  # membership of single values, as a caller on the driver asks for it
    return table(spark, folder, "assets").select("path").distinct().where(inside("path"))


@query("SELECT event_type, count(*) AS items, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS failed FROM events GROUP BY event_type")
def progress_counters(spark, folder):
    deltas = table(spark, folder, "events").select("event_type", F.lit(1).alias("items"), F.when(F.col("value") > 50, 1).otherwise(0).alias("failed"))
    return upkeep.progress(deltas, ["event_type"], ["items", "failed"])


@query("""WITH e AS (SELECT user_id, ts, event_id, floor(epoch_us(ts) / 3600000000) AS slot FROM events WHERE user_id IS NOT NULL)
 SELECT user_id, ts, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id, slot ORDER BY ts DESC, event_id DESC) = 1""")
def coalesced_snapshots(spark, folder):
    rows = table(spark, folder, "events").where("user_id IS NOT NULL").select("user_id", "ts", "event_id")
    return upkeep.coalesced(rows, "user_id", "ts", 3_600_000)


@query("""SELECT event_id, event_id % 11 < max(event_id % 11) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS superseded FROM events WHERE user_id IS NOT NULL""")
def superseded_requests(spark, folder):
    rows = table(spark, folder, "events").where("user_id IS NOT NULL").select("event_id", F.col("user_id").alias("client"), (F.col("event_id") % 11).alias("generation"), F.struct("ts", "event_id").alias("at"))
    return upkeep.accepted_generations(rows).select("event_id", "superseded")


@query("""WITH e AS (SELECT user_id AS key, min(epoch_ms(ts)) AS created_ms, max(epoch_ms(ts)) AS touched_ms, min(event_id) % 9 = 0 AS pinned FROM events WHERE user_id IS NOT NULL GROUP BY user_id), m AS (SELECT max(touched_ms) AS now_ms FROM e)
 SELECT key FROM e, m WHERE pinned OR now_ms - touched_ms < 3600000 ORDER BY created_ms, key LIMIT 40""")
def retained_state(spark, folder):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, folder, "events").where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("key")).agg(F.min(ms).alias("created_ms"), F.max(ms).alias("touched_ms"), (F.min("event_id") % 9 == 0).alias("pinned"))
    now = rows.agg(F.max("touched_ms")).first()[0] or 0
    return upkeep.retained(rows, now, 3_600_000, 40).select("key")


@query("""WITH t AS (SELECT DISTINCT asset_id, size_bucket, generator_version, source_size, octet_length(data) AS bytes FROM thumbnails WHERE asset_id IS NOT NULL AND data IS NOT NULL),
 k AS (SELECT asset_id, size_bucket, generator_version, source_size, bytes, source_size * 10000 + generator_version * 1000 + size_bucket % 1000 AS used FROM t WHERE bytes <= 600),
 s AS (SELECT *, sum(bytes) OVER (PARTITION BY asset_id ORDER BY used DESC, bytes ROWS UNBOUNDED PRECEDING) AS so_far FROM k) SELECT asset_id, used FROM s WHERE so_far <= 600""")
def kept_within_budget(spark, folder):
    rows = table(spark, folder, "thumbnails").where("asset_id IS NOT NULL AND data IS NOT NULL").select("asset_id", "size_bucket", "generator_version", "source_size", F.octet_length("data").alias("bytes")).distinct()
    rows = rows.withColumn("used", F.col("source_size") * 10000 + F.col("generator_version") * 1000 + F.col("size_bucket") % 1000)
    return upkeep.within_budget(rows, "bytes", "used", 600, "asset_id").select("asset_id", "used")


@query(f"""WITH {CUR}, late AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY written_at DESC, source_modified_ns DESC, source_size DESC) AS rn FROM image_embedding_state WHERE asset_id IS NOT NULL) WHERE rn = 1)
 SELECT l.asset_id, CASE WHEN c.asset_id IS NULL THEN 'missing' WHEN c.asset_id % 10 = 3 THEN 'unavailable' WHEN c.source_modified_ns IS NOT DISTINCT FROM l.source_modified_ns AND c.source_size IS NOT DISTINCT FROM l.source_size THEN 'current' ELSE 'changed' END AS state
 FROM late l LEFT JOIN cur c ON c.asset_id = l.asset_id""")
def source_states(spark, folder):
    last = F.max(F.struct("written_at", "source_modified_ns", "source_size")).alias("l")
    known = table(spark, folder, "image_embedding_state").where("asset_id IS NOT NULL").groupBy("asset_id").agg(last)
    now = cur(spark, folder).select("asset_id", F.col("source_modified_ns").alias("ns"), F.col("source_size").alias("size"), F.when(F.col("asset_id") % 10 == 3, "unreadable").otherwise("ok").alias("found"))
    state = media.source_state(F.col("l.source_modified_ns"), F.col("l.source_size"), F.coalesce("found", F.lit("absent")), F.col("ns"), F.col("size"))
    return known.join(now, "asset_id", "left").select("asset_id", state.alias("state"))


# --- media


@query("""WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us, ts FROM events), d AS (SELECT event_type, us, count(*) AS n FROM e GROUP BY ALL), c AS (SELECT event_type, us, sum(n) OVER (PARTITION BY event_type ORDER BY us) AS done FROM d),
 w AS (SELECT event_type, us, done, last_value(us) OVER b AS bu, last_value(done) OVER b AS bd, first_value(us) OVER a AS au, first_value(done) OVER a AS ad, first_value(us) OVER o AS fu, first_value(done) OVER o AS fd FROM c
  WINDOW b AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 600000000 PRECEDING), a AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW), o AS (PARTITION BY event_type ORDER BY us))
 SELECT event_type, us, round(CASE WHEN bu IS NOT NULL THEN (done - (bd + (ad - bd) * ((us - 600000000 - bu)::DOUBLE / (au - bu)))) / 600.0 WHEN us > fu THEN (done - fd) / ((us - fu) / 1e6) END, 6) AS rate FROM w""")
def throughput_at_edges(spark, folder):
    rows = table(spark, folder, "events").groupBy("event_type", "ts").agg(F.count("*").alias("n"))
    done = F.sum("n").over(Window.partitionBy("event_type").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return media.throughput(rows.withColumn("done", done), "event_type", "ts", "done", 600).select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.round("rate", 6).alias("rate"))


@query(f"""WITH {CUR}, z AS (SELECT asset_id, width AS iw, height AS ih FROM cur WHERE width > 0 AND height > 0),
 a AS (SELECT *, CASE WHEN iw < ih THEN 256 ELSE floor(256.0::DOUBLE * iw / ih) END AS w, CASE WHEN iw < ih THEN floor(256.0::DOUBLE * ih / iw) ELSE 256 END AS h FROM z),
 b AS (SELECT asset_id, CASE WHEN greatest(w, h) > 300 THEN CASE WHEN h > w THEN floor(300 * w / h) ELSE 300 END ELSE w END AS w, CASE WHEN greatest(w, h) > 300 THEN CASE WHEN h > w THEN 300 ELSE floor(300 * h / w) END ELSE h END AS h FROM a),
 c AS (SELECT asset_id, greatest(w, 1) AS w, greatest(h, 1) AS h FROM b)
 SELECT asset_id, round((CASE WHEN w >= 224 THEN floor((w - 224) / 2) ELSE -floor((224 - w) / 2) END) / w, 6) AS x, round(224 / h, 6) AS ch, 1.0::DOUBLE AS stretched FROM c""")
def crops_capped_and_stretched(spark, folder):
    rows = cur(spark, folder).where("width > 0 AND height > 0").select("asset_id", media.crop_capped_edge(F.col("width"), F.col("height"), 256, 300, 224).alias("r"), media.crop_stretch().alias("s"))
    return rows.select("asset_id", F.round("r.x", 6).alias("x"), F.round("r.h", 6).alias("ch"), F.col("s.w").alias("stretched"))


@query(f"WITH {CUR} SELECT asset_id, CASE WHEN asset_id % 9 IN (5, 6, 7, 8) THEN height ELSE width END AS w, CASE WHEN asset_id % 9 IN (5, 6, 7, 8) THEN width ELSE height END AS h FROM cur")
def oriented_sizes(spark, folder):
    w, h = media.oriented(F.col("width"), F.col("height"), F.col("asset_id") % 9)
    return cur(spark, folder).select("asset_id", w.alias("w"), h.alias("h"))


@query("SELECT DISTINCT asset_id % 256 AS c, source_size % 256 AS a, CAST((asset_id % 256 * (source_size % 256) + 255 * (255 - source_size % 256)) // 255 AS INTEGER) AS flat FROM assets WHERE asset_id >= 0 AND source_size >= 0")
def blended_channels(spark, folder):
    rows = table(spark, folder, "assets").where("asset_id >= 0 AND source_size >= 0").select((F.col("asset_id") % 256).alias("c"), (F.col("source_size") % 256).alias("a")).distinct()
    return rows.withColumn("flat", media.blended(F.col("c"), F.col("a")))


# --- instants and texts


@query("""WITH s AS (SELECT DISTINCT source_modified_ns // 1000000000 AS s FROM assets WHERE source_modified_ns > 0 AND source_modified_ns < 4000000000000000000)
 SELECT s, s * 1000000000 + 250000000 AS utc, s * 1000000000 - 5400000000000 AS east, s * 1000000000 + 123456789 AS zulu, CAST(NULL AS BIGINT) AS bad FROM s""")
def instants_read_back(spark, folder):
    rows = table(spark, folder, "assets").where("source_modified_ns > 0 AND source_modified_ns < 4000000000000000000").select(F.floor(F.col("source_modified_ns") / 1_000_000_000).alias("_"), F.expr("source_modified_ns div 1000000000").alias("s")).distinct()
    at = F.timestamp_seconds("s")
    exif, iso = F.date_format(at, "yyyy:MM:dd HH:mm:ss"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select(
        "s", instants.exif_ns(F.concat(exif, F.lit(".25"))).alias("utc"), instants.exif_ns(exif, F.lit("+01:30")).alias("east"), instants.rfc3339_ns(F.concat(iso, F.lit(".123456789Z"))).alias("zulu"), instants.rfc3339_ns(iso).alias("bad")
    ).distinct()


@query("SELECT DISTINCT source_modified_ns AS ns, source_modified_ns AS back, CAST(NULL AS BIGINT) AS bad FROM assets WHERE source_modified_ns IS NOT NULL")
def decimal_instants(spark, folder):
    text = F.col("source_modified_ns").cast("string")
    return table(spark, folder, "assets").where("source_modified_ns IS NOT NULL").select(F.col("source_modified_ns").alias("ns"), instants.decimal_ns(text).alias("back"), instants.decimal_ns(F.concat(text, F.lit("x"))).alias("bad")).distinct()


@query(r"""SELECT DISTINCT path, '\\server\share' || replace(path, '/', '\') AS unc, 'C:' || replace(path, '/', '\') AS drive, path AS plain FROM assets""")
def canonical_paths(spark, folder):
    back = F.translate("path", "/", "\\")
    rows = table(spark, folder, "assets").select("path", F.concat(F.lit("\\\\?\\UNC\\server\\share"), back).alias("a"), F.concat(F.lit("\\\\?\\C:"), back).alias("b")).distinct()
    return rows.select("path", paths.canonical_windows(F.col("a")).alias("unc"), paths.canonical_windows(F.col("b")).alias("drive"), paths.canonical_windows(F.col("path")).alias("plain"))


@query(f"""WITH {TXT}, c AS (SELECT asset_id, content, CASE WHEN octet_length(encode(content)) <= 64 THEN length(content) ELSE (SELECT max(i) FROM range(0, 65) t(i) WHERE octet_length(encode(left(content, i))) <= 64) END AS n FROM txt WHERE content IS NOT NULL)
 SELECT asset_id, left(content, n) AS start FROM c""")
def truncated_texts(spark, folder):
    return txt(spark, folder).where("content IS NOT NULL").select("asset_id", words.truncate_utf8(F.col("content"), 64).alias("start"))


@query(f"WITH {TXT} SELECT asset_id, array_to_string(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ') <> ''), chr(10)) AS text FROM txt WHERE content IS NOT NULL")
def joined_lines(spark, folder):
    return txt(spark, folder).where("content IS NOT NULL").select("asset_id", words.join_lines(F.split("content", "\n")).alias("text"))


@query(f"""WITH {TXT} SELECT replace(replace(replace(replace(replace(replace(content, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), '"', '\\"'), chr(39), '\\' || chr(39)) || chr(9) || source_path AS value FROM txt
 WHERE content IS NOT NULL AND NOT regexp_matches(content, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')""")
def escaped_lines(spark, folder):
    rows = txt(spark, folder).where(F.col("content").isNotNull() & ~F.col("content").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))
    return files.text_lines(rows)


@query(f"""WITH {TXT}, w AS (SELECT asset_id, generate_subscripts(m, 1) AS i, unnest(m) AS word FROM (SELECT asset_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS m FROM txt WHERE regexp_full_match(content, '[\\x00-\\x7f]*', 's'))),
 hit AS (SELECT asset_id, i, i - row_number() OVER (PARTITION BY asset_id ORDER BY i) AS g FROM w WHERE word IN ('telescope', 'harbour', 'river')) SELECT asset_id, count(DISTINCT g) AS spans, count(*) AS words FROM hit GROUP BY asset_id""")
def highlight_spans(spark, folder):
    """Spans and words of exact evidence on ASCII texts; other evidence (stems, starts, one edit) goes to another kind and is left out."""
    ascii_only = txt(spark, folder).where(F.col("content").rlike(r"\A[\x00-\x7f]*\z"))
    spans = highlight.highlights(F.col("content"), "telescope harbour river")
    rows = ascii_only.select("asset_id", "content", F.explode(spans).alias("s")).select("asset_id", F.lower(F.expr("substring(content, s.start + 1, s.end - s.start)")).alias("t"))
    parts = rows.select("asset_id", F.filter(F.split("t", "[^a-z0-9]+"), lambda x: x != "").alias("w"))
    exact = parts.select("asset_id", F.size(F.filter("w", lambda x: x.isin("telescope", "harbour", "river"))).alias("n"), "w").where("n > 0")
    # runs of exact words within a span that other evidence may have joined
    runs = F.aggregate("w", F.struct(F.lit(0).alias("runs"), F.lit(False).alias("on")), lambda a, x: F.struct((a["runs"] + F.when(x.isin("telescope", "harbour", "river") & ~a["on"], 1).otherwise(0)).alias("runs"), x.isin("telescope", "harbour", "river").alias("on")))["runs"]
    return exact.groupBy("asset_id").agg(F.sum(runs).cast("long").alias("spans"), F.sum("n").cast("long").alias("words"))


# --- vectors and frames


@query(f"WITH v AS (SELECT DISTINCT embedding_id, embedding::DOUBLE[] AS e FROM image_embedding_samples WHERE {USABLE.format(w=96)}) SELECT embedding_id, round(e[1] / sqrt(list_inner_product(e, e)), 5) AS first, round(1.0::DOUBLE, 5) AS length FROM v")
def unit_vectors(spark, folder):
    rows = table(spark, folder, "image_embedding_samples").where(_usable("embedding", 96)).select("embedding_id", "embedding").distinct()
    rows = rows.select("embedding_id", V.normalised(F.col("embedding")).alias("u"))
    return rows.select("embedding_id", F.round(F.col("u")[0].cast("double"), 5).alias("first"), F.round(V.norm(F.col("u")), 5).alias("length"))


@query("SELECT label, count(*) AS patches, round(sum(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS power FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k BETWEEN 2 AND 10 GROUP BY label HAVING count(*) = 9")
def patch_grids(spark, folder):
    grids = table(spark, folder, "embeddings").groupBy("label").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]), 1, 10).alias("tokens"))
    units = grids.where("size(tokens) = 10").select("label", frames.patch_grid(F.col("tokens"), 1).alias("u"))
    power = F.aggregate("u", F.lit(0.0), lambda a, v: a + V.dot(v, v))
    return units.select("label", F.size("u").cast("long").alias("patches"), F.round(power, 4).alias("power"))


@query(f"""WITH RECURSIVE s AS (SELECT DISTINCT asset_id, embedding_id, timestamp_ms, embedding::DOUBLE[] AS e FROM image_embedding_samples WHERE asset_id IS NOT NULL AND {USABLE.format(w=96)}),
 o AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp_ms NULLS FIRST, embedding_id) AS k FROM s),
 pairs AS (SELECT a.asset_id, a.k AS k, list(b.k) AS near FROM o a JOIN o b ON a.asset_id = b.asset_id AND b.k < a.k WHERE list_cosine_similarity(a.e, b.e) >= 0.95 GROUP BY ALL),
 walk AS (SELECT asset_id, 1::BIGINT AS k, [1::BIGINT] AS kept FROM o WHERE k = 1
  UNION ALL SELECT w.asset_id, w.k + 1, CASE WHEN p.near IS NOT NULL AND len(list_intersect(p.near, w.kept)) > 0 THEN w.kept ELSE list_append(w.kept, w.k + 1) END FROM walk w JOIN o ON o.asset_id = w.asset_id AND o.k = w.k + 1 LEFT JOIN pairs p ON p.asset_id = o.asset_id AND p.k = o.k),
 last AS (SELECT asset_id, kept FROM walk QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY k DESC) = 1)
 SELECT o.asset_id, o.embedding_id, o.timestamp_ms FROM o JOIN last USING (asset_id) WHERE list_contains(kept, o.k)""")
def distinct_frames(spark, folder):
    rows = table(spark, folder, "image_embedding_samples").where(_usable("embedding", 96) & F.col("asset_id").isNotNull())
    return frames.distinct_frames(rows.select("asset_id", "embedding_id", "timestamp_ms", "embedding").dropDuplicates(["embedding_id"]))


@query("""WITH RECURSIVE b AS (SELECT DISTINCT asset_id AS page, size_bucket + generator_version AS box, width::DOUBLE AS x, height::DOUBLE AS y FROM thumbnails WHERE asset_id IS NOT NULL),
 o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, box) AS k FROM b),
 walk AS (SELECT page, k, y AS top, 0 AS r FROM o WHERE k = 1 UNION ALL SELECT o.page, o.k, CASE WHEN abs(o.y - w.top) >= 10 THEN o.y ELSE w.top END, CASE WHEN abs(o.y - w.top) >= 10 THEN w.r + 1 ELSE w.r END FROM walk w JOIN o ON o.page = w.page AND o.k = w.k + 1)
 SELECT page, CAST(box AS BIGINT) AS box, x, y, CAST(row_number() OVER (PARTITION BY page ORDER BY r, x, y, box) - 1 AS INTEGER) AS place FROM walk JOIN o USING (page, k)""")
def reading_order(spark, folder):
    boxes = table(spark, folder, "thumbnails").select(F.col("asset_id").alias("page"), (F.col("size_bucket") + F.col("generator_version")).cast("long").alias("box"), F.col("width").cast("double").alias("x"), F.col("height").cast("double").alias("y"))
    return frames.reading_order(boxes.where("page IS NOT NULL").distinct())


@query("""WITH p AS (SELECT label AS component, vec_id % 40 AS x, vec_id % 7 AS y, embedding[1]::DOUBLE AS score FROM embeddings), g AS (SELECT component, avg(score) AS score, avg(x) AS cx, avg(y) AS cy, sum((x - m) * (y - n)) AS xy, sum((x - m) ** 2) AS xx, sum((y - n) ** 2) AS yy
  FROM p JOIN (SELECT component, avg(x) AS m, avg(y) AS n FROM p GROUP BY component) USING (component) GROUP BY component),
 t AS (SELECT *, 0.5 * atan2(2 * xy, xx - yy) AS a FROM g), r AS (SELECT component, t.score, min(cos(a) * (x - cx) + sin(a) * (y - cy)) AS p0, max(cos(a) * (x - cx) + sin(a) * (y - cy)) AS p1, min(-sin(a) * (x - cx) + cos(a) * (y - cy)) AS q0, max(-sin(a) * (x - cx) + cos(a) * (y - cy)) AS q1, any_value(cx) AS cx, any_value(cy) AS cy, any_value(a) AS a
  FROM t JOIN p USING (component) GROUP BY component, t.score), b AS (SELECT *, p1 - p0 + 1 AS w, q1 - q0 + 1 AS h, (p1 - p0 + 1) * (q1 - q0 + 1) * 1.5 / (2 * (p1 - p0 + q1 - q0 + 2)) AS g FROM r)
 SELECT component, round(score, 6) AS score, round(cos(a) * (p0 - g) - sin(a) * (q0 - g) + cx, 4) AS x, round(sin(a) * (p0 - g) + cos(a) * (q0 - g) + cy, 4) AS y FROM b WHERE least(w, h) >= 3""")
def oriented_boxes(spark, folder):
    pixels = table(spark, folder, "embeddings").select(F.lit(1).cast("long").alias("page"), F.col("label").cast("long").alias("component"), (F.col("vec_id") % 40).alias("x"), (F.col("vec_id") % 7).alias("y"), F.col("embedding")[0].cast("double").alias("score"))
    boxes = frames.component_boxes(pixels)
    return boxes.select(F.col("component").cast("int").alias("component"), F.round("score", 6).alias("score"), F.round(F.col("corners")[0], 4).alias("x"), F.round(F.col("corners")[1], 4).alias("y"))


@query(f"""WITH {TXT}, {EMB} SELECT asset_id, octet_length(encode(content))::DOUBLE AS a, CASE WHEN contains(content, 'scan') THEN 'no model for it' END AS problem FROM txt WHERE trim(content, ' ') <> ''
 AND NOT EXISTS (SELECT 1 FROM emb e WHERE e.asset_id = txt.asset_id AND e.source_modified_ns = txt.source_modified_ns AND e.source_size = txt.source_size)""".replace("octet_length(encode(content))::DOUBLE AS a", "CASE WHEN NOT contains(content, 'scan') THEN octet_length(encode(content))::DOUBLE END AS a"))
def embedded_by_hook(spark, folder):
    """The backlog through a function that stands for a model: it knows a text's bytes, and refuses some texts."""

    def model(texts):
        if any("scan" in t for t in texts):
            raise ValueError("no model\nfor it")
        return [[float(len(t.encode())), 1.0] for t in texts]

    backlog = coverage.text_backlog(txt(spark, folder), table(spark, folder, "ocr_embedding_state"), "ocrText")
    good, bad = hooks.embedded_texts(backlog, model, 2)
    return good.select("asset_id", F.col("embedding")[0].cast("double").alias("a"), F.lit(None).cast("string").alias("problem")).unionByName(bad.select("asset_id", F.lit(None).cast("double").alias("a"), "problem"))


@query("SELECT vec_id, label FROM embeddings")
def vectors_through_blobs(spark, folder):
    back = F.udf(lambda v: files.decode_vector(files.encode_vector(v)) == [float(x) for x in v], "boolean")
    return table(spark, folder, "embeddings").where(back("embedding")).select("vec_id", "label")


@query(f"""WITH {TXT}, {EMB} SELECT count(*) AS stale FROM ocr_embedding_state s WHERE NOT EXISTS (SELECT 1 FROM txt t WHERE t.asset_id = s.asset_id AND t.source_modified_ns = s.source_modified_ns AND t.source_size = s.source_size)""")
def stale_vectors(spark, folder):
    rows = table(spark, folder, "ocr_embedding_state").join(txt(spark, folder).select(*search.fingerprint()), search.fingerprint(), "left_anti")
    return rows.agg(F.count("*").alias("stale"))


@query(f"WITH {CUR} SELECT asset_id, count(*) AS n FROM (SELECT asset_id FROM cur WHERE {STILL} UNION ALL SELECT asset_id FROM cur WHERE media_kind = 'image') GROUP BY asset_id HAVING count(*) > 0")
def candidates_once(spark, folder):
    rows = cur(spark, folder)
    both = rows.where(filters.recognisable()).unionByName(rows.where("media_kind = 'image'")).select("asset_id")
    once = both.dropDuplicates(["asset_id"])
    return once.join(both.groupBy("asset_id").agg(F.count("*").alias("n")), "asset_id")


@query(f"WITH {CUR} SELECT asset_id, {FP.replace('asset_id, ', '')} FROM cur WHERE asset_id IN (7, 41, 55)")
def checked_batch(spark, folder):
    return catalog.get_many(cur(spark, folder), coverage.batch_ids([7, 41, 55])).select(*search.fingerprint())


@query(f"""WITH {CUR} SELECT asset_id, path, regexp_replace(path, '^.*/', '') AS display_name, {EXT} AS extension, source_modified_ns, coalesce(source_created_ns, -1) AS source_created_ns, coalesce(exif_taken_ns, -1) AS exif_taken_ns, source_size, media_kind, media_format,
 coalesce(width, -1) AS width, coalesce(height, -1) AS height, is_animated, coalesce(frame_count, -1) AS frame_count, coalesce(duration_ms, -1) AS duration_ms, metadata_version FROM cur WHERE {SCOPE_SQL}""")
def asset_projection(spark, folder):
    rows = catalog.gallery(cur(spark, folder), SCOPE)
    return rows.select("asset_id", "path", "display_name", "extension", *[F.coalesce(c, F.lit(-1)).alias(c) if c in NULLABLE else c for c in catalog.FIELDS if c != "path"])


@query("SELECT 'ocr_results' AS store, count(*) AS n FROM ocr_results UNION ALL SELECT 'index_runs', count(*) FROM index_runs")
def published_snapshots(spark, folder):
    """Two tables written as snapshots and read back as a reader does that holds one version."""
    import uuid

    at = f"{checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    out = None
    for name in ("ocr_results", "index_runs"):
        files.publish(table(spark, folder, name).limit(0), at, name)
        files.publish(table(spark, folder, name), at, name)
        one = files.latest(spark, at, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
        out = one if out is None else out.unionByName(one)
    return out
