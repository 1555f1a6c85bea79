"""Distinct frames of assets larger than a group."""

import numpy as np

from shutterloom.operators import frames


def test_large_assets_go_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for asset, n in ((1, 70), (2, 23), (3, 4), (4, 10)):
        base = rng.standard_normal((max(2, n // 3), 6))
        for i in range(n):
            v = base[rng.integers(len(base))] + 0.1 * rng.standard_normal(6)
            rows.append((asset, len(rows), None if i == 5 else int(rng.integers(40)) * 100, v.tolist()))
    df = spark.createDataFrame(rows, "asset_id long, embedding_id long, timestamp_ms long, embedding array<float>").repartition(3)
    whole = sorted(map(tuple, frames.distinct_frames(df).collect()), key=str)
    monkeypatch.setattr(frames, "TILE", 4)
    assert sorted(map(tuple, frames.distinct_frames(df, most=10).collect()), key=str) == whole
    assert 30 < len(whole) < len(rows)
