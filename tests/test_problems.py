import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shutterloom.functions.bitmaps import Bitmap
from shutterloom.operators import increments, orphans


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4095), max_size=300), st.lists(st.integers(0, 4095), max_size=300))
def test_bitmaps(a, b):
    x, y = Bitmap.of(np.array(a, int), 4096), Bitmap.of(np.array(b, int), 4096)
    assert x.and_not(y).offsets().tolist() == sorted(set(a) - set(b))
    assert (x | y).offsets().tolist() == sorted(set(a) | set(b)) and len(x) == len(set(a))


def _t(day):
    return None if day is None else dt.datetime(2023, 1, 1) + dt.timedelta(days=day)


def _rows(spark, rows, schema):
    return spark.createDataFrame([(i, _t(d)) for i, d in rows], schema)


def test_orphans(spark):
    assets = _rows(spark, [(1, 1), (2, 50), (3, 1), (3, 9), (4, 1), (5, 40), (6, None), (8, 100)], "asset_id long, seen_at timestamp")
    pruned = _rows(spark, [(3, 5), (4, 5), (4, 3), (7, 5), (None, 3)], "asset_id long, pruned_at timestamp")
    refs = [(1, 2), (2, 3), (2, 60), (3, 2), (4, 2), (5, 33), (7, 40), (9, 31), (9, 2), (None, 3), (6, 3), (8, None), (1, 2)]
    refs = _rows(spark, refs, "asset_id long, written_at timestamp").withColumns({"seen_at": F.lit(1), "reason": F.lit("x")})
    got = orphans.find_orphans(orphans.references({"t": refs}), orphans.parents(assets, pruned)).collect()
    assert sorted((r.asset_id, r.reason, r.period) for r in got) == [(2, "late", "2023-01"), (4, "deleted", "2023-01"), (5, "late", "2023-02"), (7, "deleted", "2023-02"), (9, "missing", "2023-01")]
    assert orphans.find_orphans(orphans.references({"t": refs.limit(0)}), orphans.parents(assets, pruned)).count() == 0
    assert orphans.find_orphans(orphans.references({"t": refs}), orphans.parents(assets.limit(0), pruned.limit(0))).count() == 9


def test_sparse_keys_share_ranges(spark, monkeypatch):
    """Random 64-bit keys fall into as many ranges as their number asks for, and all orphans are found."""
    monkeypatch.setattr(orphans, "RANGE", 50)
    keys = np.random.default_rng(2).integers(-(2**62), 2**62, 400).tolist()
    assets = _rows(spark, [(k, 1) for k in keys[:300]], "asset_id long, seen_at timestamp")
    pruned = _rows(spark, [], "asset_id long, pruned_at timestamp")
    refs = _rows(spark, [(k, 2) for k in keys[200:]], "asset_id long, written_at timestamp")
    got = orphans.find_orphans(orphans.references({"t": refs}), orphans.parents(assets, pruned))
    assert sorted(r.asset_id for r in got.collect()) == sorted(keys[300:])


def _numbers(spark, pairs):
    return spark.createDataFrame(pairs, "lane string, seq long")


@settings(max_examples=12, deadline=None)
@given(a=st.lists(st.integers(-20, 40), max_size=30), b=st.lists(st.integers(-20, 40), max_size=30))
def test_interval_arithmetic(spark, a, b):
    x, y = (increments.intervals(_numbers(spark, [("l", i) for i in v]), block_bits=3) for v in (a, b))
    todo = increments.numbers(increments.subtract(x, y)).collect()
    assert sorted(r.seq for r in todo) == sorted(set(a) - set(b))
    union = increments.merge(x, y).collect()
    covered = sorted(n for r in union for n in range(r.lo, r.hi + 1))
    assert covered == sorted(set(a) | set(b))


def test_ledger_survives_failures_and_late_commits(spark, tmp_path):
    ledger = increments.Ledger(spark, str(tmp_path))
    first = _numbers(spark, [("a", 1), ("a", 2), ("a", 5), ("b", 1)])
    ledger.run(first, lambda todo: todo)

    def broken(todo):
        raise RuntimeError("lost")

    more = first.unionByName(_numbers(spark, [("a", 3), ("a", 9), (None, 4)]))  # 3 is a late commit below 5
    with pytest.raises(RuntimeError):
        ledger.run(more, broken)
    ledger.run(more, lambda todo: todo)
    ledger.run(more, lambda todo: todo)
    done = sorted((r.lane, r.seq) for r in ledger.output().collect())
    assert done == [("a", 1), ("a", 2), ("a", 3), ("a", 5), ("a", 9), ("b", 1)]
    assert sorted((r.lane, r.lo, r.hi) for r in ledger.processed().collect()) == [("a", 1, 3), ("a", 5, 5), ("a", 9, 9), ("b", 1, 1)]


def test_of_two_racing_runs_one_is_published(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(increments.Ledger, "FOLD", 2)
    ledger = increments.Ledger(spark, f"file://{tmp_path}")
    rows = _numbers(spark, [("a", 1), ("a", 2)])
    ledger.adopt(_numbers(spark, [("a", 2), ("a", 7)]))

    def beaten(todo):
        increments.Ledger(spark, str(tmp_path)).run(rows.unionByName(_numbers(spark, [("a", 3)])), lambda x: x)
        return todo

    with pytest.raises(RuntimeError, match="void"):
        ledger.run(rows, beaten)
    assert sorted(r.seq for r in ledger.output().collect()) == [1, 3]
    for n in range(10, 14):
        assert [r.seq for r in ledger.run(_numbers(spark, [("a", n)]), lambda x: x).collect()] == [n]
    assert sorted(r.seq for r in ledger.output().collect()) == [1, 3, 10, 11, 12, 13] and len(ledger._state()["outputs"]) <= 3
    assert sorted((r.lo, r.hi) for r in ledger.processed().collect()) == [(1, 3), (7, 7), (10, 13)]


def test_pending_text_assets(spark):
    a = "asset_id long, source_modified_ns long, source_size long, media_kind string, media_format string, day int"
    assets = spark.createDataFrame(
        [(1, 10, 1, "image", "png", 1), (1, 11, 1, "image", "png", 2), (2, 10, 1, "image", "bmp", 1), (3, 10, 1, "image", "gif", 1), (4, 10, 1, "image", "png", 1), (5, 10, 1, "image", "png", 1), (6, 10, 1, "video", "mp4", 1)], a
    ).withColumn("seen_at", F.timestamp_seconds("day"))
    pruned = spark.createDataFrame([(3, 5)], "asset_id long, d int").select("asset_id", F.timestamp_seconds("d").alias("pruned_at"))
    texts = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "  "), (5, "x"), (6, "x"), (None, "x")], "asset_id long, content string")
    state = spark.createDataFrame([("s", 1, [1.0], 10, 1), ("s", 5, [1.0], 10, 1), ("w", 5, None, 10, 1)], "space string, asset_id long, embedding array<float>, source_modified_ns long, source_size long")
    spaces = spark.createDataFrame([("s",), ("w",)], "space string")
    got = {(r.space, r.asset_id) for r in increments.pending_text_assets(assets, pruned, texts, state, spaces).collect()}
    assert got == {("s", 1), ("w", 1), ("w", 5)}
    assert increments.pending_text_assets(assets, pruned, texts, state, spaces.limit(0)).count() == 0
