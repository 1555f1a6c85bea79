import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import components, density, neighbours, vectors

WIDTH = 16


def _data(seed=3, clusters=25, loose=120):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for c in range(clusters):
        centre = rng.standard_normal(WIDTH)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(1, 12))):
            v = centre + rng.standard_normal(WIDTH) * 0.05
            rows.append((k, (v * rng.choice([1.0, 7.0])).astype(np.float32).tolist()))
            k += 1
    for _ in range(loose):
        rows.append((k, rng.standard_normal(WIDTH).astype(np.float32).tolist()))
        k += 1
    same = rng.standard_normal(WIDTH).astype(np.float32).tolist()
    rows += [(k + i, same) for i in range(11)]  # more equal vectors than a list is long
    k += 11
    bad = [None, [1.0], [0.0] * WIDTH, [float("nan")] * WIDTH, [float("inf")] + [0.0] * (WIDTH - 1), []]
    return rows + rows[:5] + [(k + i, b) for i, b in enumerate(bad)] + [(None, rows[0][1]), (None, None)], rows


def _frame(spark, rows):
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    return frame.withColumns({c: F.lit(0) for c in ("label", "place", "v", "node", "keys", "bucket", "size")}).withColumn("space", F.lit("s"))


def _pairs(frame, k=5):
    return neighbours.similar_pairs(frame, {"s": WIDTH}, k)


def _true(rows):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float64)
    return ids, v / np.linalg.norm(v, axis=1, keepdims=True)


def _true_pairs(rows, k=5, least=0.9):
    ids, v = _true(rows)
    s = np.round(v @ v.T, 6)
    out = set()
    for i in range(len(ids)):
        order = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= least)[:k]
        out |= {(min(ids[i], j), max(ids[i], j)) for _, j in order}
    return {(int(a), int(b)) for a, b in out}


def _true_clusters(rows, least=0.78):
    ids, v = _true(rows)
    near = v @ v.T >= least
    out = set()
    for i in range(len(ids)):
        members = np.flatnonzero(near[i])
        if len(members) >= 3 and near[np.ix_(members, members)].all() and (near[members].sum(1) == len(members)).all():
            out |= {(int(ids[members].min()), int(ids[m])) for m in members}
    return out


@pytest.mark.parametrize("tile, bound, k", [(vectors.TILE, vectors.BOUND, 5), (4, vectors.BOUND, 5), (4, 40, 2), (vectors.TILE, 40, 20)])
def test_neighbours_and_clusters_equal_brute_force(spark, monkeypatch, tile, bound, k):
    """Also where groups are larger than a tile, buckets are split, and for any k."""
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "BOUND", bound)
    monkeypatch.setattr(vectors, "BUCKET", min(bound, vectors.BUCKET))
    vectors.plan_tables.cache_clear()
    every, rows = _data()
    frame = _frame(spark, every)
    got = {(r.id_a, r.id_b) for r in _pairs(frame, k).collect()}
    want = _true_pairs(rows, k)
    assert got <= want and len(got) >= 0.98 * len(want)
    members = density.clusters(frame, WIDTH)
    found = {(r.cluster_id, r.embedding_id) for r in members.collect()}
    truth = _true_clusters(rows)
    assert found <= truth and len(found) >= 0.98 * len(truth) > 0
    top = density.describe(members).collect()
    assert all(1 <= len(r.typical) <= 3 and r.size >= 3 for r in top)


def test_no_vectors(spark):
    for rows in ([], [(1, None)], [(1, [1.0] * WIDTH)]):
        frame = _frame(spark, rows)
        assert _pairs(frame).count() == 0 and density.clusters(frame, WIDTH).count() == 0


def test_components(spark):
    edges = [(2, 1), (3, 2), (4, 3), (9, 8), (10, 9), (12, 8), (5, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in components.components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 8, 12: 8}
    assert components.components(df.limit(0)).count() == 0


def test_each_space_for_itself(spark):
    """Spaces of several widths in one plan; ids of one space tell nothing about another's; undeclared spaces are left out."""
    every, rows = _data()
    wide = [(i, [*v, *v, *v]) for i, v in rows]
    frame = spark.createDataFrame([("a", *r) for r in every] + [("b", *r) for r in wide] + [("c", *r) for r in rows], "space string, id long, embedding array<float>")
    got = neighbours.similar_pairs(frame, {"a": WIDTH, "b": 3 * WIDTH, "none": 4}).collect()
    want = _true_pairs(rows)
    for space in "ab":
        found = {(r.id_a, r.id_b) for r in got if r.space == space}
        assert found <= want and len(found) >= 0.98 * len(want)
    assert {r.space for r in got} == {"a", "b"}


def test_a_chain_and_a_large_cluster(spark, monkeypatch):
    """Links that chain through more vectors than a tile make no cluster; a cluster larger than a tile is found, with its copies."""
    monkeypatch.setattr(vectors, "TILE", 8)
    angle = np.arange(60) * 0.5
    chain = [(i, [float(np.cos(a)), float(np.sin(a)), a / 9, *[0.0] * (WIDTH - 3)]) for i, a in enumerate(angle)]
    rng = np.random.default_rng(1)
    ball = [(100 + i, [0.0] * 8 + (np.r_[9, rng.standard_normal(7)]).tolist()) for i in range(30)]
    ball += [(200 + i, ball[0][1]) for i in range(5)]
    rows = [(i, np.float32(v).tolist()) for i, v in chain + ball]
    found = {(r.cluster_id, r.embedding_id) for r in density.clusters(_frame(spark, rows), WIDTH).collect()}
    assert found == _true_clusters(rows) and len(found) >= 35


def test_links_agree():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 8, (300, 8)).astype(np.uint8)[:, :1]
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    label = vectors.link(signs, 7.5)
    assert all((label == label[i]).sum() == (codes[:, 0] == codes[i, 0]).sum() for i in range(300))
    near = signs @ signs.T >= 5.5
    reach = near
    while ((reach @ reach) != reach).any():
        reach = reach @ reach
    assert (vectors.link(signs, 5.5) == reach.argmax(1)).all()
