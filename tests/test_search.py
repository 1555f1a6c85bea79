import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from shutterloom import request as R
from shutterloom.functions import vectors as V
from shutterloom.operators import catalog, coverage, fusion, search
from shutterloom.operators.filters import Filters
from shutterloom.operators.scope import PathScope
from shutterloom.operators.text_index import TextIndex

TEXTS = [
    (1, "Lanterns hang over the quay at noon", 41),
    (2, "The slantern was never built", 17),
    (3, "quay quay, and once more the QUAY", 5),
    (4, "Bring rope; meet near the old crane", 88),
    (5, None, 3),
    (6, "crane", 60),
    (7, "The crane lifts rope and lanterns", 2),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "asset_id long, content string, source_modified_ns long")


@pytest.mark.parametrize("pattern,ids", [("crane", [4, 6, 7]), ("cran", []), ("LANT*", [1, 7]), ("*tern", [2]), ("r?pe", [4, 7]), ("[no]ver", [1]), ("[!q]ever", [2])])
def test_word_globs(texts, pattern, ids):
    assert sorted(r.asset_id for r in search.glob(texts, pattern).collect()) == ids
    assert search.count_glob(texts, pattern).first().total == len(ids)


def test_glob_counts_occurrences_with_and_without_index(texts):
    direct = {r.asset_id: r.matching_words for r in search.glob(texts, "qu*").collect()}
    index = {r.asset_id: r.matching_words for r in search.glob_by_index(search.postings(texts), texts, "qu*").collect()}
    assert direct == index == {1: 1, 3: 3}
    assert [r.asset_id for r in search.glob(texts, "qu*").collect()] == [3, 1]


@pytest.fixture(scope="module")
def index(texts, tmp_path_factory):
    return TextIndex.build(texts.where("content IS NOT NULL"), str(tmp_path_factory.mktemp("index")))


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(c, tokenize='trigram')")
    con.executemany("INSERT INTO t(rowid, c) VALUES (?, ?)", [(i, c) for i, c, _ in TEXTS if c is not None])
    return con


@pytest.mark.parametrize("phrase", ["quay", "ant", "the old", "lantern", "nowhere"])
def test_bm25_equals_sqlite(texts, index, fts, phrase):
    want = dict(fts.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (f'"{phrase}"',)).fetchall())
    rows = texts.where("content IS NOT NULL")
    for kept in (None, index):
        got = {r.asset_id: r.score for r in search.simple(rows, phrase, index=kept).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)
    assert search.count_simple(rows, phrase).first().total == len(want)


def test_short_and_star_phrases_match_nothing(texts):
    assert search.simple(texts, "qu").count() == 0
    assert search.simple(texts, "qua*").count() == 0


EXPRESSIONS = [
    "quay", "quay OR crane", '"meet near" crane', "rope NOT old", "(quay OR crane) NOT lanterns", "lan*", '"rope and" *', "^bring", '^"the crane"', "^crane",
    "NEAR(rope crane)", "NEAR(rope crane, 20)", "NEAR(crane rope, 2)", 'NEAR("old crane" rope meet, 11)', "NEAR(quay quay, 1)", "quay AND noon", "crane NOT NEAR(rope crane, 6)",
]


@pytest.mark.parametrize("query", EXPRESSIONS)
def test_expressions_equal_sqlite(texts, index, fts, query):
    want = sorted(i for (i,) in fts.execute("SELECT rowid FROM t WHERE t MATCH ?", (query,)).fetchall())
    for kept in (None, index):
        assert sorted(r.asset_id for r in search.match(texts, query, index=kept).collect()) == want
    assert search.count_match(texts, query).first().total == len(want)


@pytest.mark.parametrize("query", ["(noon", "noon)", "OR noon", '"noon', "NOT noon", "no*n", "NEAR(noon", "NEAR(noon quay, x)", "NEAR()", "^", ""])
def test_bad_expressions(query):
    with pytest.raises(search.QuerySyntaxError):
        search.Expression(query)


def test_regex(texts):
    assert [r.asset_id for r in search.regex(texts, "^[BT].*ran?e").collect()] == [4, 7]
    assert search.count_regex(texts, "^[BT].*ran?e").first().total == 2
    for bad in ("(?=x)", r"(a)\1", "(", "a++"):
        with pytest.raises(search.QuerySyntaxError):
            search.check_regex(bad)


@pytest.fixture(scope="module")
def gallery(spark):
    """Photos of a harbour: 11 and 14 look alike, 12 lies in a folder of its own, 13 elsewhere, 15 changed since it was embedded."""
    assets = spark.createDataFrame(
        [(11, "/port/quay.png", 700, None, 3), (12, "/port/drafts/mast.png", 650, 20, 4), (13, "/town/mill.png", 900, None, 5), (14, "/port/pier.png", 710, 30, 6), (15, "/port/tug.png", 720, None, 7)],
        "asset_id long, path string, source_modified_ns long, exif_taken_ns long, source_size long",
    ).withColumns({"media_kind": F.lit("image"), "media_format": F.lit("png")})
    vectors = [(21, 11, None, [0.6, 0.8]), (22, 12, None, [0.8, -0.6]), (23, 13, None, [0.6, 0.8]), (24, 14, None, [3.0, 4.0]), (25, 15, None, [0.6, 0.8])]
    samples = spark.createDataFrame(vectors, "embedding_id long, asset_id long, timestamp_ms long, embedding array<float>")
    state = spark.createDataFrame([(11, 700, 3, 0), (12, 650, 4, 0), (13, 900, 5, 0), (14, 710, 6, 0), (15, 720, 8, 0)], "asset_id long, source_modified_ns long, source_size long, sampling_version int")
    return assets, samples, state


def test_image_search(gallery):
    assets, samples, state = gallery

    def hits(scope, ceiling=search.UNBOUNDED, limit=10):
        rows = search.image_vectors(samples, state, catalog.in_scope(assets, scope), [0.6, 0.8])
        best = search.best_frame(rows.withColumn("distance", F.round("distance", 6))).where(F.col("distance") <= ceiling)
        got = search.with_total(best, limit, "distance", "-source_modified_ns", "asset_id").collect()
        return got[0].total, [r.asset_id for r in got if r.asset_id is not None]

    assert hits(PathScope.of(["/port"])) == (3, [14, 11, 12])
    assert hits(PathScope.of(["/port"], ["/port/drafts"])) == (2, [14, 11])
    assert hits(PathScope.of(["/port", "/town"]), 0.9) == (3, [13, 14, 11])
    assert hits(PathScope.of(["/port"]), limit=1) == (3, [14])
    assert hits(PathScope.of(["/port"]), limit=0) == (3, [])
    assert hits(PathScope.of(["/sea"])) == (0, [])


def test_best_frame_breaks_ties_by_time(spark):
    rows = spark.createDataFrame([(1, 8, 2000, 0.1), (1, 9, 1000, 0.1), (1, 7, 3000, 0.2)], "asset_id long, embedding_id long, timestamp_ms long, distance double")
    assert search.best_frame(rows).first().embedding_id == 9


def test_vector_distances(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [-1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, [1.0])], "id int, v array<float>")
    got = {r.id: r.d for r in rows.select("id", V.distance_to([1.0, 0.0, 0.0])(F.col("v")).alias("d")).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 2.0, 4: None, 5: None, 6: None}
    same = rows.where("id < 4").select("id", (1 - V.cosine_similarity(F.col("v"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))).alias("d")).collect()
    assert {r.id: r.d for r in same} == {1: 0.0, 2: 1.0, 3: 2.0}


def test_combined_vectors():
    assert V.combine([(2.0, [1.0, 0.0]), (-1.0, [0.0, 2.0])]) == pytest.approx([2 / 8**0.5, -2 / 8**0.5])
    for bad in ([(1.0, [1.0, 0.0]), (-1.0, [1.0, 0.0])], [(1.0, [math.inf])], []):
        with pytest.raises(ValueError):
            V.combine(bad)


def _ranked(spark, ids):
    return spark.createDataFrame([(i, r + 1, f"s{i}" if i != 7 else None) for r, i in enumerate(ids)], "asset_id long, rank int, snippet string")


def test_fusion(spark):
    lists = [fusion.labelled(_ranked(spark, [1, 7]), "a", 0), fusion.labelled(_ranked(spark, [2, 7]), "b", 1)]
    got = fusion.fuse(lists, k=1).orderBy("rank").collect()
    assert [r.asset_id for r in got] == [7, 1, 2]
    assert [(s.key, s["rank"]) for s in got[0].sources] == [("a", 2), ("b", 2)] and got[0].snippet is None and got[1].snippet == "s1"
    heavy = [fusion.labelled(_ranked(spark, [1, 7]), "a", 0, 3.0), lists[1]]
    assert fusion.fuse(heavy, k=1, limit=1).first().asset_id == 1


def test_requests():
    q = R.Query("a", "ocrSimple", "x")
    for bad in (
        lambda: R.SearchRequest(()), lambda: R.SearchRequest((q, q)), lambda: R.SearchRequest((q,), limit=0), lambda: R.SearchRequest((q,), k=0.0),
        lambda: R.Query(" ", "ocrSimple", "x"), lambda: R.Query("a", "other", "x"), lambda: R.Query("a", "regex", " "), lambda: R.Query("a", "regex", "x", max_distance=1.0),
        lambda: R.Query("a", "vector"), lambda: R.Component(0.0, [1.0]), lambda: R.Component(1.0), lambda: R.Component(1.0, [1.0], 3), lambda: R.Query("a", "name", "x", weight=0.0),
    ):
        with pytest.raises(R.InvalidRequest):
            bad()


def test_text_coverage_and_states(spark):
    texts = spark.createDataFrame([(1, 10, 1, "a"), (2, 20, 1, "  "), (3, 30, 1, "c")], "asset_id long, source_modified_ns long, source_size long, content string")
    state = spark.createDataFrame([("ocrText", 1, [1.0], 10, 1), ("ocrText", 3, [1.0], 29, 1), ("other", 3, [1.0], 30, 1)], "space string, asset_id long, embedding array<float>, source_modified_ns long, source_size long")
    assert tuple(coverage.text_coverage(texts, state, "ocrText").first()) == (3, 1, 2, 1, 30)
    assert [r.asset_id for r in coverage.text_backlog(texts, state, "ocrText").collect()] == [3]
    got = {r.asset_id: r.state for r in coverage.index_states(texts, state.where("space = 'ocrText'")).collect()}
    assert got == {1: "indexed", 2: "notIndexed", 3: "stale"}


def test_engine(spark, gallery):
    assets, samples, state = gallery
    texts = assets.select("asset_id", "path", "source_modified_ns", "source_size", "exif_taken_ns").withColumnRenamed("path", "source_path").withColumn("content", F.concat(F.lit("needle number "), "asset_id"))
    vectors = samples.join(assets, "asset_id").select(F.lit("ocrText").alias("space"), "asset_id", "embedding", "source_modified_ns", "source_size")
    engine = R.Engine(assets, texts, vectors, samples, state)
    vector, picture = R.Component(1.0, asset_id=11), R.Component(1.0, [0.6, 0.8])
    asked = R.SearchRequest((R.Query("v", "vector", components=(vector,)), R.Query("t", "ocrSimple", "needle"), R.Query("g", "ocrGlob", "nee*"), R.Query("i", "image", components=(picture,)), R.Query("n", "name", "*.png")), filters=Filters(scope=PathScope.of(["/port"])))
    rows = engine.search(asked).collect()
    assert {r.asset_id for r in rows} == {11, 12, 14, 15}
    with pytest.raises(R.InvalidRequest):
        engine.vector_of(R.Query("v", "vector", components=(R.Component(1.0, asset_id=15),)))
