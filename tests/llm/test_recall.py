"""Recall of the hashing at the queries' own thresholds, on vectors spread evenly, at any number of codes."""

import math

import numpy as np
import pytest

from shutterloom.llm import vectors

WIDTH = 96


def recall(codes: int, cosine: float, pairs: int = 3000) -> float:
    rng = np.random.default_rng(codes)
    length, tables, probes = vectors.plan_tables(codes, cosine)
    bits = -(-max(vectors.BITS, length * tables) // 64) * 64
    plan = vectors.Plan(0, WIDTH, length, tables, probes, vectors.radius(cosine, bits), vectors.learn_rotation(rng.standard_normal((1000, WIDTH)), bits, rounds=3))
    a, b = vectors.unit(rng.standard_normal((pairs, WIDTH))), rng.standard_normal((pairs, WIDTH))
    b = vectors.unit(b - (a * b).sum(1, keepdims=True) * a)
    (x, i), (y, j) = (vectors.encode(v, plan) for v in (a, cosine * a + math.sqrt(1 - cosine * cosine) * b))
    met = np.zeros(pairs, bool)
    for t in range(tables):
        part = slice(t * probes, (t + 1) * probes)
        met |= (i[:, part, None] == j[:, None, part]).any((1, 2))
    near = np.bitwise_count(x ^ y).sum(1) <= plan.radius
    return float((met & near).mean())


@pytest.mark.parametrize("codes", [10**5, 10**6, 10**7, 10**8, 10**9])
@pytest.mark.parametrize("cosine", [0.78, 0.9])
def test_recall_at_the_threshold(codes, cosine):
    vectors.plan_tables.cache_clear()
    assert recall(codes, cosine) >= 0.96
