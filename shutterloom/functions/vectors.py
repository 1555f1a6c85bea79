"""Vector functions: JVM expressions for small vectors, Arrow batches for scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def normalised(a: Column) -> Column:
    """Of length 1; an error for a vector that is not finite or has no length."""
    length = norm(a)
    usable = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (length > 1.2e-7)
    return F.when(usable, F.transform(a, lambda x: (x / length).cast("float"))).otherwise(F.raise_error(F.lit("a vector must be finite and not zero")).cast("array<float>"))


def is_valid(a: Column, width: int) -> Column:
    """Declared width, only finite numbers."""
    return a.isNotNull() & (F.size(a) == width) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def distance_to(query: list[float]):
    """A function of a vector column: its cosine distance (0 to 2) to the query, null for other widths and zero vectors.

    One pass over Arrow batches with a matrix product each; the query travels with the function."""
    q = np.asarray(query, np.float64)
    q = q / np.linalg.norm(q)
    width = len(q)

    def run(column: pa.Array) -> pa.Array:
        out = np.full(len(column), np.nan)
        lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1)
        at = np.flatnonzero(lengths == width)
        if len(at):
            v = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
            with np.errstate(all="ignore"):
                out[at] = 1 - (v @ q) / np.sqrt(np.einsum("ij,ij->i", v, v))
        return pa.array(out, mask=~np.isfinite(out))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    # else a filter on the distance is pushed below its projection, and the product is taken twice
    return F.arrow_udf(run, "double").asNondeterministic()


def combine(weighted: list[tuple[float, list[float]]]) -> list[float]:
    """The weighted sum of vectors of one width, of length 1. Weights may be negative; accumulates in float64."""
    if not weighted:
        raise ValueError("no component")
    total = np.zeros(len(weighted[0][1]))
    for weight, vector in weighted:
        v = np.asarray(vector, np.float64)
        if v.shape != total.shape or not np.isfinite(v).all():
            raise ValueError("components must be finite and of one width")
        total += weight * v
    length = np.linalg.norm(total)
    if not np.isfinite(length) or length <= np.finfo(np.float32).eps:
        raise ValueError("the components cancel out")
    return (total / length).astype(np.float32).tolist()
