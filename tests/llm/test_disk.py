"""What is on disk at once: shuffles end with their action, and large exchanges go in passes with the same result."""

import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from shutterloom.llm import density, nearcopies, neighbours, vectors
from shutterloom.session import cut, discard, written


def _shuffle_files(spark) -> set[str]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(p) for folder in folders for p in Path(folder.getPath()).rglob("shuffle_*")}


def test_shuffles_end_with_their_action(spark):
    before = _shuffle_files(spark)
    for keep in (written, cut):
        kept = keep(spark.range(20_000).groupBy((F.col("id") % 997).alias("k")).agg(F.sum("id").alias("s")))
        for _ in range(50):
            if not (left := _shuffle_files(spark) - before):
                break
            time.sleep(0.2)
        assert not left and kept.count() == 997


def test_discarded_tables_are_gone(spark):
    table, other = written(spark.range(10)), written(spark.range(7))
    folder = Path(table.inputFiles()[0].removeprefix("file:")).parent
    discard(table)
    assert not folder.exists() and other.count() == 7


def _vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 24))
    v = np.concatenate([c + rng.standard_normal((n, 24)) * 0.08 for c, n in zip(centres, rng.integers(1, 14, 60))]).astype(np.float32)
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")


def test_passes_of_buckets(spark, monkeypatch):
    """Each bucket in one pass, whole; a pass has its share of the entries."""
    rows = _vectors(spark).select(F.lit("s").alias("space"), "id", "embedding")
    plans = vectors.plans_for(rows, {"s": 24}, 0.78)
    monkeypatch.setattr(vectors, "ENTRIES", 2)
    passes = vectors.passes_for(plans)
    assert passes == -(-plans["s"].tables * plans["s"].probes // 2) > 1
    nodes = vectors.encoded(rows, plans).select("place", "node", "code", "keys")

    def of(blocks):
        return {r.bucket: r.n for r in blocks.groupBy("bucket").agg(F.sum(F.length("codes")).alias("n")).collect()}

    whole, parts = of(vectors.buckets(nodes, plans, {})), [of(vectors.buckets(nodes, plans, {}, k, passes)) for k in range(passes)]
    assert sum(len(p) for p in parts) == len(whole) and {b: n for p in parts for b, n in p.items()} == whole


def test_passes_give_the_same_rows(spark, monkeypatch):
    """Also for groups larger than a tile, whose floats meet in the buckets."""
    frame = _vectors(spark)

    def rows():
        pairs = neighbours.similar_pairs(frame.withColumn("space", F.lit("s")), {"s": 24})
        return sorted(map(tuple, density.clusters(frame, 24).collect())), sorted(map(tuple, pairs.collect()))

    for tile in (vectors.TILE, 6):
        monkeypatch.setattr(vectors, "TILE", tile)
        one = rows()
        with monkeypatch.context() as m:
            m.setattr(vectors, "ENTRIES", 1)
            m.setattr(vectors, "LEAST_PASS", 1)
            m.setattr(vectors, "PACK", 64)
            assert rows() == one and len(one[0]) > 100


def test_passes_give_the_same_copies(spark, monkeypatch):
    """Passes, blocks, tiles and the sample of the plan leave the pairs as they are; a pass has a bounded number of bytes."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, 9)) for _ in range(90)]
    texts += [t[: k % 30] + "x" + t[k % 30 + 1 :] for k, t in enumerate(texts)]
    frame = cut(spark.createDataFrame(list(enumerate(texts)), "id long, content string"))
    plans = []

    def pairs():
        return sorted(map(tuple, nearcopies.near_copies(frame, 3).collect()))

    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in (t.replace(" ", "") for t in texts)]
    want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if nearcopies.exact(sets[i], sets[j]) >= 0.6]
    assert pairs() == want and len(want) >= 80
    sizes, postings = [], nearcopies._postings

    def measured(*args):
        out = postings(*args)
        sizes.append(out.agg(F.sum(F.length("sig") + F.length("grams") + F.length("places") + F.length("sides") + nearcopies.ROW)).first()[0] or 0)
        return out

    monkeypatch.setattr(nearcopies, "_postings", measured)
    for name, value in (("LEAST_PASS", 25_000), ("PASS_SHARE", 0), ("BLOCK_BYTES", 12_000), ("SAMPLE", 50), ("TILE", 16)):
        monkeypatch.setattr(nearcopies, name, value)
    assert pairs() == want and max(sizes) < 50_000 < sum(sizes)


def test_orders_of_ngrams():
    rng = np.random.default_rng(4)
    row, c = np.sort(rng.integers(0, 300, 5000)), rng.integers(0, 9, 5000)
    c[:3] = np.iinfo(np.int32).max
    assert (nearcopies._by_count(row, c) == np.lexsort((c, row))).all()
    assert (nearcopies._by_count(row << 20, c) == np.lexsort((c, row))).all()
    rows, h = nearcopies.grams_of(["banana", "", "abc", "bananas"], 3)
    assert rows.tolist() == [0] * 3 + [2] + [3] * 4 and all((h[rows == k][1:] > h[rows == k][:-1]).all() for k in range(4))
