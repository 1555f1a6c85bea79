import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shutterloom.functions import paths
from shutterloom.operators.filters import Filters, TimeRange, is_excluded, is_media
from shutterloom.operators.scope import PathScope

PATHS = [
    "/gallery_100%#/photo.png", "/gallery_100%#", "/gallery_100%#-old/photo.png", "/Gallery_100%#/photo.png", "/gallery_100%#/skip/a.png",
    "/gallery_100%#/skip", "/gallery_100%#/skipped/a.png", "/", "", "/a0/b", "/a/b", "/a.b/c",
]


@pytest.mark.parametrize("include,exclude", [(["/gallery_100%#"], []), (["/gallery_100%#/"], ["/gallery_100%#/skip"]), ([], []), (["/"], ["/a"]), (["/a", "/gallery_100%#"], ["/a"])])
def test_column_agrees_with_values(spark, include, exclude):
    scope = PathScope.of(include, exclude)
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", scope.column(F.col("path")).alias("inside")).collect()
    assert {r.path: r.inside for r in rows} == {p: scope.contains(p) for p in PATHS}


@settings(max_examples=40, deadline=None)
@given(st.text("ab/0.", min_size=0, max_size=8), st.lists(st.text("ab0", min_size=1, max_size=3).map(lambda s: "/" + s), max_size=2))
def test_inside_is_a_strict_prefix(path, roots):
    scope = PathScope.of(roots)
    assert scope.contains(path) == any(path.startswith(r + "/") for r in roots)


def test_scope_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("/a/b",)], "path string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(PathScope.of(["/a"]).column(F.col("path")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(path,/a/)" in plan and "LessThan(path,/a0)" in plan


def test_focus_and_folders(spark):
    scope = PathScope.of(["/x/a", "/y"], ["/x/a/no"])
    assert scope.focused("/x").include == ("/x/a",)
    assert scope.focused("/x/a/b").include == ("/x/a/b",)
    assert scope.focused("/z").include == ()
    names = ["/", "/x", "/x/a", "/x/a/b", "/x/a/no", "/x/a/no/b", "/x/ab", "/z", ""]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", scope.shows_folder(F.col("p")).alias("v")).collect()
    assert [r.p for r in rows if r.v] == ["/", "/x", "/x/a", "/x/a/b"]


@pytest.mark.parametrize("path,want", [("a/b.JPG", "jpg"), (".hidden", ""), ("x.", ""), ("a.b/c", ""), ("a\\b.Png", "png"), ("q.tar.GZ", "gz")])
def test_extension(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(paths.extension(F.col("p"))).first()[0] == want


CASES = [
    ("scan", "/a/My_Scan.png", True), ("*.png", "/a/b.PNG", True), ("*.png", "/a.png/b.jpg", False), ("img_????.*", "/a/IMG_0001.JPG", True),
    ("img_????.*", "/a/IMG_notes.txt.jpg", False), ("/a/*/c.png", "/a/b/x/c.png", True), ("a[1]", "/x/a[1].png", True), ("a.c", "/x/abc", False), ("*(1)*", "/x/y (1).jpg", True),
]


@pytest.mark.parametrize("pattern,path,want", CASES)
def test_path_patterns(spark, pattern, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(paths.path_matches(F.col("p"), pattern)).first()[0] is want


def test_longest_literal():
    assert paths.longest_literal("ab*cd?e") == "cd" and paths.longest_literal("*") == "" and paths.longest_literal("abc") == "abc"


def test_natural_order(spark):
    names = ["photo10.jpg", "photo2.jpg", "photo002.jpg", "photo.jpg", "0", "00", "a1b2", "a1b10"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(paths.natural_key(F.col("n")), "n").collect()
    assert [r.n for r in rows] == ["0", "00", "a1b2", "a1b10", "photo.jpg", "photo002.jpg", "photo2.jpg", "photo10.jpg"]


def test_time_ranges(spark):
    rows = spark.createDataFrame([(1, 10, None), (2, 20, 5), (3, 30, None)], "id int, source_modified_ns long, exif_taken_ns long")
    ids = lambda t: [r.id for r in rows.where(t.column()).orderBy("id").collect()]
    assert ids(TimeRange("modified", 20, 30)) == [2]
    assert ids(TimeRange("capture", None, 10)) == [2]
    assert ids(TimeRange("capture")) == [1, 2, 3]
    for bad in ({"kind": None, "after": 1}, {"kind": "modified", "after": 2, "before": 2}):
        with pytest.raises(ValueError):
            TimeRange(**bad)


def test_inert_filters_and_exclusions(spark):
    rows = spark.createDataFrame([("/a/.cache/x.png",), ("/a/.thumbs/y.png",), ("/a/b.png",), ("/a/skip/c.png",), ("/a/d.txt",)], "path string")
    kept = rows.where(is_media(F.col("path")) & ~is_excluded(F.col("path"), ["/a/skip"])).collect()
    assert [r.path for r in kept] == ["/a/b.png"]
    assert rows.where(Filters(patterns=(" ",), extensions=("",)).column(F.col("path"))).count() == 5
