import datetime as dt
import struct

from pyspark.sql import functions as F

from shutterloom.streaming import ingest

SCHEMA = "asset_id long, path string, source_modified_ns long, source_size long, seen_at timestamp"


def _write(spark, rows, path):
    spark.createDataFrame([(i, p, m, s, dt.datetime(2023, 1, 1)) for i, p, m, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_ingest_is_incremental_and_keeps_ids(spark, tmp_path):
    inbox, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    _write(spark, [(1, "/a", 1, 1), (2, "/b", 1, 1)], inbox)
    ingest.ingest(ingest.sightings_stream(spark, inbox, SCHEMA), store, check).awaitTermination()
    _write(spark, [(1, "/b", 2, 1), (3, "/c", 1, 1)], inbox)
    ingest.ingest(ingest.sightings_stream(spark, inbox, SCHEMA), store, check).awaitTermination()
    got = {r.path: (r.asset_id, r.source_modified_ns) for r in spark.read.parquet(store + "/v2").collect()}
    assert got == {"/a": (1, 1), "/b": (2, 2), "/c": (3, 1)}


def test_unchanged_files_are_dropped(spark, tmp_path):
    inbox = str(tmp_path / "in")
    _write(spark, [(1, "/a", 1, 1)], inbox)
    _write(spark, [(1, "/a", 1, 1), (1, "/b", 1, 1)], inbox)
    stream = ingest.unchanged_filter(ingest.sightings_stream(spark, inbox, SCHEMA, 1))
    q = stream.writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.path for r in spark.table("fresh").collect()) == ["/a", "/b"]


def test_windowed_rate(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2023, 1, 1, 0, 0, s), "x") for s in range(10)], "ts timestamp, event_type string")
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = ingest.windowed_rate(stream).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").agg(F.max("rate")).first()[0] == 1.0


def test_files_are_ingested_as_they_appear(spark, tmp_path):
    (tmp_path / "in" / ".cache").mkdir(parents=True)
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 7, 5)
    store, check = f"file://{tmp_path}/store", str(tmp_path / "check")
    for n, names in enumerate((["b.png"], ["a.png", "note.txt", ".cache/c.png"])):
        for name in names:
            (tmp_path / "in" / name).write_bytes(png)
        ingest.ingest(ingest.files_stream(spark, str(tmp_path / "in")), store, check).awaitTermination()
    got = {r.path.rsplit("/", 1)[1]: (r.asset_id, r.width, r.source_size) for r in spark.read.parquet(f"{tmp_path}/store/v2").collect()}
    assert got == {"b.png": (1, 7, 24), "a.png": (2, 7, 24)}
