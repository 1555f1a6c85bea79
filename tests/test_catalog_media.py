import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.functions import words
from shutterloom.operators import catalog, frames, highlight, media, upkeep
from shutterloom.operators.scope import PathScope
from shutterloom.sources import files

ASSET = "asset_id long, path string, source_modified_ns long, exif_taken_ns long, source_size long"


def test_gallery_order(spark):
    rows = spark.createDataFrame([(1, "/g/a", 10, 30, 1), (2, "/g/b", 20, None, 1), (3, "/g/c", 20, 30, 1), (4, "/g-old/d", 99, None, 1)], ASSET)
    order = lambda kind: [r.asset_id for r in catalog.gallery(rows, PathScope.of(["/g"]), kind).collect()]
    assert order("modified") == [3, 2, 1] and order("capture") == [3, 1, 2]


def test_current_is_the_latest_sighting(spark):
    rows = spark.createDataFrame([(1, "/a", 5, None, 1, 1), (1, "/b", 4, None, 1, 2), (None, "/c", 1, None, 1, 3), (1, "/b", 4, None, 1, 2)], ASSET + ", t int").withColumn("seen_at", F.timestamp_seconds("t"))
    assert [(r.asset_id, r.path) for r in catalog.current(rows).collect()] == [(1, "/b")]


def test_get_many_keeps_order_and_repeats(spark):
    rows = spark.createDataFrame([(1, "/a", 1, None, 1), (2, "/b", 1, None, 1)], ASSET)
    assert [r.asset_id for r in catalog.get_many(rows, [2, 9, 1, 2]).collect()] == [2, 1, 2]
    assert catalog.get_many(rows, []).count() == 0


def test_file_search(spark):
    rows = spark.createDataFrame([(i, f"/g/{n}", 1, None, 1) for i, n in enumerate(["photo10.jpg", "photo2.jpg", "other.jpg"], 1)], ASSET)
    assert [r.asset_id for r in catalog.search_files(rows, PathScope.of(["/g"]), "photo").collect()] == [2, 1]


def test_upsert_keeps_ids(spark):
    old = spark.createDataFrame([(5, "/a", 1), (9, "/b", 1)], "asset_id long, path string, source_size long")
    found = spark.createDataFrame([("/b", 2), ("/d", 2), ("/c", 2)], "path string, source_size long")
    got = {r.path: (r.asset_id, r.source_size) for r in catalog.upsert(old, found).collect()}
    assert got == {"/a": (5, 1), "/b": (9, 2), "/c": (10, 2), "/d": (11, 2)}
    again = catalog.upsert(catalog.upsert(old, found), found)
    assert {r.path: (r.asset_id, r.source_size) for r in again.collect()} == got


def test_classify(spark):
    t = "path string, source_modified_ns long, source_size long, source_created_ns long"
    old = spark.createDataFrame([(1, "/a", 1, 1, 1, 2), (2, "/b", 1, 1, 1, 2), (3, "/c", 1, 1, None, 2), (4, "/d", 1, 1, 1, 1)], "asset_id long, path string, source_modified_ns long, source_size long, source_created_ns long, metadata_version int")
    found = spark.createDataFrame([("/a", 1, 1, 1), ("/b", 1, 1, 7), ("/c", 2, 1, None), ("/d", 1, 1, 1), ("/e", 1, 1, 1)], t)
    got = {r.path: r.state for r in catalog.classify(found, old, 2).collect()}
    assert got == {"/a": "unchanged", "/b": "metadata", "/c": "changed", "/d": "changed", "/e": "new"}


def test_directory_diff_and_nesting(spark):
    a = spark.createDataFrame([("/x", 1), ("/y", 1), ("/z", None)], "path string, modified_ns long")
    b = spark.createDataFrame([("/x", 1), ("/y", 2), ("/w", 1)], "path string, modified_ns long")
    assert {r.path: r.state for r in catalog.directory_diff(a, b).collect()} == {"/x": "unchanged", "/y": "changed", "/z": "missing", "/w": "new"}
    f = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/c",), ("/ab",)], "path string")
    assert {(r.outer, r.inner) for r in catalog.nested_folders(f).collect()} == {("/a", "/a/b"), ("/a", "/a/b/c"), ("/a/b", "/a/b/c")}


def test_upkeep(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "asset_id long, content string, written_at int")
    new = spark.createDataFrame([(2, "x", 2), (2, "y", 3), (3, "z", 1)], "asset_id long, content string, written_at int")
    assert {(r.asset_id, r.content) for r in upkeep.upsert_latest(stored, new).collect()} == {(1, "a"), (2, "y"), (3, "z")}
    parents = spark.createDataFrame([(1,)], "asset_id long")
    assert [r.asset_id for r in upkeep.without_parent(stored, parents).collect()] == [2]
    listing = spark.createDataFrame([("/g/a",)], "path string")
    assets = spark.createDataFrame([(1, "/g/a", 1, None, 1), (2, "/g/b", 1, None, 1)], ASSET)
    assert [r.asset_id for r in upkeep.reconcile(assets, listing, "/g", True).collect()] == [2]
    assert upkeep.reconcile(assets, listing, "/g", False).count() == 0 and upkeep.reconcile(assets, listing.limit(0), "/g", True).count() == 0


@pytest.mark.parametrize("duration,want", [(6000, [1000, 3000, 5000]), (None, []), (0, []), (-5, [])])
def test_sample_targets(spark, duration, want):
    assert spark.createDataFrame([(duration,)], "d long").select(media.spread(F.col("d"))).first()[0] == want


def test_more_sample_targets(spark):
    row = spark.createDataFrame([(21000, 1200000)], "a long, b long").select(F.size(media.spread(F.col("a"))), F.size(media.spread(F.col("b"))), media.at_percentages(F.col("a"), [0, 50, 100])).first()
    assert row[0] == 7 and row[1] == 12 and row[2] == [0, 10500, 21000]


def test_thumbnail_choice(spark):
    t = spark.createDataFrame([(1, 128), (1, 512), (1, 1024), (2, 128), (2, 64)], "asset_id long, size_bucket int")
    assert {r.asset_id: r.size_bucket for r in media.pick_thumbnail(t, 256).collect()} == {1: 512, 2: 128}
    sizes = spark.createDataFrame([(s,) for s in (0, 1, 128, 129, 1024, 1025)], "s int").select(media.required_bucket(F.col("s"))).collect()
    assert [r[0] for r in sizes] == [None, 128, 128, 256, 1024, None]


def test_floor_seconds(spark):
    rows = spark.createDataFrame([(-1,), (0,), (1_999_999_999,), (1_670_525_539_457_486_109,)], "n long").select(media.floor_seconds(F.col("n"))).collect()
    assert [r[0] for r in rows] == [-1, 0, 1, 1_670_525_539]


@pytest.mark.parametrize("word,want", [("running", "run"), ("inspected", "inspect"), ("inspecting", "inspect"), ("stories", "story"), ("address", "address"), ("glass", "glass"), ("boxes", "box"), ("cats", "cat"), ("is", "is")])
def test_stems(spark, word, want):
    assert words.stem_text(word) == want
    assert spark.createDataFrame([(word,)], "w string").select(words.stem(F.col("w"))).first()[0] == want


def test_tokens_and_truncation(spark):
    row = spark.createDataFrame([("Crème BRÛLÉE, naïve 2ⁿᵈ",)], "t string").select(words.tokens(F.col("t")), words.truncate_utf8(F.col("t"), 4)).first()
    assert row[0][:3] == ["creme", "brulee", "naive"] and row[1] == "Crè"


def test_highlights():
    text = "Sailors repaired the mooring ropes; a moorinq post was painted twice."
    marks = highlight.Highlighter("repairing paint").spans(text)
    assert [(text[m["start"] : m["end"]], m["kind"]) for m in marks] == [("repaired", "stem"), ("painted", "stem")]
    marks = highlight.Highlighter("mooring").spans(text)
    assert [(text[m["start"] : m["end"]], m["kind"]) for m in marks] == [("mooring", "exact"), ("moorinq", "fuzzy")]
    # neighbours are one span, of the stronger kind; the start of a word is evidence from three letters on
    (one,) = highlight.Highlighter("mooring rop").spans(text[:36])
    assert text[one["start"] : one["end"]] == "mooring ropes" and one["kind"] == "exact"
    assert highlight.Highlighter("ro").spans(text) == [] == highlight.Highlighter("with the").spans(text)
    assert highlight.Highlighter("rope").spans(None) == []


def test_markers_and_snippets():
    plain, spans = highlight.parse_marked("[tide] tables, [] page ]3[ of [harbour] notes [")
    assert plain == "tide tables,  page ]3 of [harbour notes ["
    assert [plain[s["start"] : s["end"]] for s in spans][0] == "tide" and all(s["kind"] == "indexed" for s in spans)
    assert "[buoy]" in highlight.snippet("wave " * 150 + "buoy " + "foam " * 90, {"buoy"})


def test_distinct_frames(spark):
    rows = [(1, 1, 0, [1.0, 0.0]), (1, 2, 5000, [0.99, 0.05]), (1, 3, 10000, [0.0, 1.0]), (1, 4, 20000, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "asset_id long, embedding_id long, timestamp_ms long, embedding array<float>")
    assert sorted(r.timestamp_ms for r in frames.distinct_frames(df).collect()) == [0, 10000, 20000]


def test_reading_order(spark):
    boxes = [(1, 10, 5.0, 0.0), (1, 20, 9.0, 18.0), (1, 30, 90.0, 3.0), (1, 50, 1.0, 12.0)]
    df = spark.createDataFrame(boxes, "page long, box long, x double, y double")
    assert [r.box for r in frames.reading_order(df).orderBy("place").collect()] == [10, 30, 50, 20]


def test_ctc(spark):
    steps = [(1, 0, [0.1, 0.8, 0.1]), (1, 1, [0.1, 0.8, 0.1]), (1, 2, [0.9, 0.0, 0.1]), (1, 3, [0.1, 0.2, 0.7]), (2, 0, [0.9, 0.0, 0.0])]
    got = {r.line: (r.text, round(r.score, 6)) for r in frames.ctc(spark.createDataFrame(steps, "line long, step long, scores array<float>"), ["A", "B"]).collect()}
    assert got == {1: ("AB", 0.75), 2: ("", 0.0)}


def test_oriented_box():
    y, x = np.mgrid[0:4, 0:20]
    box = frames.oriented_box(x.ravel().astype(float), y.ravel().astype(float), 1.5)
    grow = 20 * 4 * 1.5 / 48
    assert np.allclose(box[0], [-grow, -grow]) and np.allclose(box[2], [19 + grow, 3 + grow])
    assert frames.oriented_box(np.arange(9.0), np.zeros(9), 1.5) is None


def test_patches(spark):
    df = spark.createDataFrame([([[9.0, 9.0], [3.0, 4.0], [0.0, 2.0], [1.0, 0.0], [0.0, 0.0]],)], "t array<array<float>>")
    scores = df.select(frames.patch_scores(frames.patch_grid(F.col("t"), 1), F.array(F.lit(1.0), F.lit(0.0)))).first()[0]
    assert [round(s, 6) for s in scores] == [0.6, 0.0, 1.0, 0.0]
    with pytest.raises(Exception, match="square"):
        df.select(frames.patch_grid(F.col("t"), 0)).collect()


def test_tensors_and_vectors(tmp_path):
    data = files.tensor_bytes({"tags": np.eye(3), "mean": np.ones(3)})
    (tmp_path / "t").write_bytes(data)
    back = files.read_tensors(str(tmp_path / "t"))
    assert np.array_equal(back["tags"], np.eye(3)) and back["mean"].dtype == np.float32
    assert files.decode_vector(files.encode_vector([1.5, -2.0])) == [1.5, -2.0]


def test_tag_vocabulary(spark, tmp_path):
    (tmp_path / "good.tsv").write_text("term\tkind\tsource\tsensitivity\ncat\tsubject\tx\tsafe\n")
    (tmp_path / "bad.tsv").write_text("term\tkind\tsource\tsensitivity\ncat\tother\tx\tsafe\n")
    assert files.read_tags(spark, str(tmp_path / "good.tsv")).collect()[0].term == "cat"
    with pytest.raises(Exception, match="unknown tag class"):
        files.read_tags(spark, str(tmp_path / "bad.tsv")).collect()


GIF = b"GIF89a\x02\x00\x03\x00\x00\x00\x00" + (b"\x21\xf9\x04\x00\x0a\x00\x00\x00" + b"\x2c\x00\x00\x00\x00\x02\x00\x03\x00\x00\x02\x01\x00\x00") * 2 + b";"
PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x00\x07\x00\x00\x00\x05"


def test_walk_and_probe(spark, tmp_path):
    (tmp_path / ".cache").mkdir()
    for name, data in (("a.gif", GIF), ("b.PNG", PNG), ("c.txt", b"x"), (".cache/d.png", PNG), ("e.jpg", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.probe(files.walk(spark, str(tmp_path), contents=True)).collect()}
    assert set(got) == {"a.gif", "b.PNG", "e.jpg"}
    assert (got["a.gif"].frame_count, got["a.gif"].duration_ms, got["a.gif"].width, got["a.gif"].is_animated) == (2, 200, 2, True)
    assert (got["b.PNG"].media_format, got["b.PNG"].width, got["b.PNG"].height) == ("png", 7, 5) and got["e.jpg"].width is None
