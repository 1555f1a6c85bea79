"""Libraries, complete walks, headers of files, snapshots and ingest on URIs, guards of batches."""

import base64
import os
import struct
from collections import OrderedDict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shutterloom.functions import paths, words
from shutterloom.functions import vectors as V
from shutterloom.operators import coverage, libraries, media, upkeep
from shutterloom.sources import files
from shutterloom.streaming import ingest

D = libraries.Definition


@pytest.mark.parametrize(
    "bad",
    [D(()), D(("photos",)), D(("/a", "/a/")), D(("/a",), ("/b",)), D(("/a", "/a/b/c"), ("/a/b",)), D(("/a",), ("/a",))],
)
def test_definitions_that_do_not_hold(bad):
    with pytest.raises(ValueError):
        bad.check()


def test_library_life():
    known, one = libraries.Registry().create(D(("/a", "/b"), ("/a/x",)), "key")
    known, same = known.create(D(("/c",)), "key")
    assert same == one and len(known.libraries) == 1
    assert [(f.path, f.requested) for f in one.folders] == [("/a", 1), ("/b", 2), ("/a/x", 0)]
    done = one.scanned("/a", 1).scanned("/b", 1)
    assert [f.pending for f in done.folders] == [False, True, False]
    # a scan asked before a folder left and came back does not answer the new request
    again = done.updated(D(("/b",))).updated(D(("/b", "/a")))
    assert {f.path: f.requested for f in again.folders} == {"/b": 2, "/a": 3} and again.scanned("/a", 1).folders[1].pending
    assert [f.requested for f in done.updated(replace(done.definition, text=True)).folders] == [3, 4, 0]
    assert [f.requested for f in done.updated(replace(done.definition, videos=True)).folders] == [1, 2, 0]
    assert done.updated(done.definition) is done and done.respelled({"/a": "/b"}) is done
    assert [f.path for f in done.respelled({"/a": "/A", "/a/x": "/A/x"}).folders] == ["/A", "/b", "/A/x"]
    known = known.put(done)
    assert known.get(1) == done and known.delete(1).libraries == () and known.covering(2) == [done.definition.scope]
    assert known.delete(1).create(D(("/a",)))[1].library_id == 2  # ids are not given twice


def test_walk_says_whether_it_is_complete(spark, tmp_path):
    (tmp_path / "in" / ".cache").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    for name in ("a.png", "in/b.JPG", "in/c.txt", "in/.cache/d.png", "out/e.png"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "in" / "link").symlink_to(tmp_path / "out")
    (tmp_path / "in" / "round").symlink_to(tmp_path / "in")
    (tmp_path / "in" / "hidden").symlink_to(tmp_path / "in" / ".cache")
    names = lambda df: sorted(os.path.relpath(r.path, tmp_path) for r in df.where("NOT is_folder AND problem IS NULL").collect())
    whole = files.listing(spark, str(tmp_path))
    assert names(whole) in (["a.png", "in/b.JPG", "in/link/e.png"], ["a.png", "in/b.JPG", "out/e.png"]) and files.is_complete(whole)
    assert names(files.listing(spark, str(tmp_path), recursive=False)) == ["a.png"]
    assert names(files.listing(spark, str(tmp_path), [str(tmp_path / "out")])) == ["a.png", "in/b.JPG"]
    assert files.listing(spark, str(tmp_path), limit=2).count() == 2
    (tmp_path / "in" / "gone.png").symlink_to(tmp_path / "nowhere.png")
    broken = files.listing(spark, str(tmp_path))
    assert not files.is_complete(broken) and not files.is_complete(files.listing(spark, str(tmp_path / "missing")))
    assets = spark.createDataFrame([(1, f"{tmp_path}/x.png")], "asset_id long, path string")
    for found, gone in ((whole, 1), (broken, 0)):
        assert upkeep.reconcile(assets, found.where("problem IS NULL"), str(tmp_path), files.is_complete(found)).count() == gone


def _jpeg(orientation: int, taken: bytes, offset: bytes) -> bytes:
    inner = struct.pack("<HHHII", 2, 0x9003, 2, len(taken), 80) + struct.pack("<HHII", 0x9011, 2, len(offset), 80 + len(taken))
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<HHHIHH", 2, 0x112, 3, 1, orientation, 0) + struct.pack("<HHII", 0x8769, 4, 1, 40) + b"\0" * 4
    tiff = tiff.ljust(40, b"\0") + inner
    tiff = tiff.ljust(80, b"\0") + taken + offset
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\x01\x01\x11\x00"


def test_headers_hold_capture_time_and_movie_size():
    head = files.probe_header(_jpeg(6, b"2023:05:01 10:20:30\0", b"+02:00\0"))
    assert (head["width"], head["height"], head["taken"], head["taken_offset"]) == (30, 40, "2023:05:01 10:20:30", "+02:00")
    box = lambda kind, data: struct.pack(">I4s", len(data) + 8, kind) + data
    matrix = struct.pack(">9i", 0, 1 << 16, 0, -(1 << 16), 0, 0, 0, 0, 1 << 30)
    track = box(b"tkhd", struct.pack(">IIIIII", 0, 0, 0, 1, 0, 5000) + b"\0" * 16 + matrix + struct.pack(">II", 640 << 16, 360 << 16))
    movie = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 3_600_000_000, 0, 1000, 2500) + b"\0" * 80) + box(b"trak", track))
    head = files.probe_header(movie)
    assert (head["media_kind"], head["duration_ms"], head["width"], head["height"], head["taken"][:4]) == ("video", 2500, 360, 640, "2018")


def test_external_images():
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 10, 10)
    known: OrderedDict = OrderedDict()
    for i in range(40):
        files.external_images([base64.b64encode(png + bytes([i])).decode()], known)
    assert len(known) == 32 and next(iter(known.values())) == png + bytes([8])
    for bad in ("", base64.b64encode(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 10_000, 10_000)).decode()):
        with pytest.raises(ValueError):
            files.external_images([bad])


def test_snapshots_and_ingest_by_uri(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    assert files.latest(spark, at, "t") is None
    first = files.publish(spark.range(2).toDF("id"), at, "t")
    held = spark.read.parquet(first)
    assert files.publish(spark.range(5).toDF("id"), at, "t").endswith("v2") and held.count() == 2 and files.latest(spark, at, "t").count() == 5
    schema = "asset_id long, path string, source_modified_ns long, source_size long, seen_at timestamp"
    rows = lambda *r: spark.createDataFrame([(i, p, n, 1, None) for i, p, n in r], schema)
    inbox = str(tmp_path / "inbox")
    for part in (rows((1, "/a", 1)), rows((2, "/b", 1), (1, "/a", 2))):
        part.coalesce(1).write.mode("append").parquet(inbox)
        ingest.ingest(ingest.sightings_stream(spark, inbox, part.schema, 1), f"file://{tmp_path}/catalog", str(tmp_path / "marks")).awaitTermination()
    assert {(r.path, r.source_modified_ns) for r in spark.read.parquet(f"{tmp_path}/catalog/v2").collect()} == {("/a", 2), ("/b", 1)}


def test_guards_of_batches(spark):
    stored = spark.createDataFrame([], "asset_id long, size_bucket int, generator_version int, source_size long, width int, height int, data binary, written_at int")
    good = (1, 128, 3, 1, 128, 90, b"x", 1)
    for bad in ((0, *good[1:]), (1, 100, *good[2:]), (*good[:4], 129, *good[5:]), (*good[:6], b"", 1)):
        with pytest.raises(Exception, match="not a thumbnail"):
            upkeep.store_thumbnails(stored, spark.createDataFrame([good, bad], stored.schema)).collect()
    newer = (*good[:5], 91, b"y", 2)
    kept = upkeep.store_thumbnails(stored, spark.createDataFrame([good, newer], stored.schema)).collect()
    assert [r.height for r in kept] == [91]
    for ids in ([0], [1, 1], list(range(1, 1002))):
        with pytest.raises(ValueError):
            coverage.batch_ids(ids)
    models = spark.createDataFrame([("s", "m", 4)], "space string, model string, dimensions int")
    state = spark.createDataFrame([("s", 1), ("t", 1)], "space string, asset_id long")
    with pytest.raises(ValueError, match="reset"):
        upkeep.declare_model(models, state, "s", "other", 4)
    with pytest.raises(ValueError):
        upkeep.declare_model(models, state, "s", " ", 4)
    assert upkeep.declare_model(models, state, "s", "m", 4)[1].count() == 2 and upkeep.declare_model(models, state, "s", "m", 5, reset=True)[1].count() == 1
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(V.normalised(F.col("v"))).collect()


def test_small_functions(spark):
    row = spark.createDataFrame([("\\\\?\\UNC\\server\\share\\a.png", "\\\\?\\C:\\a.png", "C:\\b.png")], "a string, b string, c string").select(*[paths.canonical_windows(F.col(c)) for c in "abc"]).first()
    assert tuple(row) == ("\\\\server\\share\\a.png", "C:\\a.png", "C:\\b.png")
    texts = spark.createDataFrame([("é€😀x",), ("abc",), ("",), (None,)], "t string")
    for most in range(11):
        want = [None if t is None else t.encode()[:most].decode(errors="ignore") for (t,) in [("é€😀x",), ("abc",), ("",), (None,)]]
        assert [r[0] for r in texts.select(words.truncate_utf8(F.col("t"), most)).collect()] == want
    lines = spark.createDataFrame([(["a", " ", "b"],)], "l array<string>").select(words.join_lines(F.col("l"))).first()[0]
    assert lines == "a\nb"
    states = spark.createDataFrame([(1, 1, "ok", 1, 1), (1, 1, "ok", 1, 2), (1, 1, "absent", None, None), (1, 1, "denied", None, None)], "a long, b long, f string, n long, s long")
    got = [r[0] for r in states.select(media.source_state(F.col("a"), F.col("b"), F.col("f"), F.col("n"), F.col("s"))).collect()]
    assert got == ["current", "changed", "missing", "unavailable"]
    text = files.text_lines(spark.createDataFrame([("a\tb\\\n\"'\x01", "/p")], "content string, source_path string")).first()[0]
    assert text == "a\\tb\\\\\\n\\\"\\'\\u{1}\t/p"
