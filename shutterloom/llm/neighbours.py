"""Most similar vectors for every vector: codes found by multi-index hashing, exact floats reranked.

Similarities are rounded to 6 decimals before comparing, ties go to the smaller id. Within a class of more than k + 1
copies of one vector only the k + 1 smallest ids can be anyone's neighbours; the others share the list of the last of
these. A group too large for one task is reranked bucket by bucket, the k best of each kept; never all against all.
See vectors.py for the groups and the treatment of unusable vectors and repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.llm import vectors

PAIRS = "place int, id long, other long, sim double"


def top_within(ids: np.ndarray, v: np.ndarray, owner: np.ndarray, k: int, least: float) -> tuple[np.ndarray, ...]:
    """(id, other, sim): for each of ids, its k most similar with at least this cosine. ids[i] has the vector v[owner[i]]."""
    f = v.astype(np.float32)
    left, right = [], []
    step = max(1, (1 << 22) // max(1, len(ids)))
    few = len(ids) <= k + 1
    for i in range(0, len(ids), step):
        s = (f[owner[i : i + step]] @ f.T)[:, owner] if len(ids) != len(v) else f[i : i + step] @ f.T
        rows = np.arange(len(s))
        s[rows, rows + i] = -2
        floor = np.full(len(s), least, np.float32)
        if not few:
            floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        x, y = np.nonzero(s >= (floor - np.float32(1e-5))[:, None])
        left.append(x + i)
        right.append(y)
    x, y = np.concatenate(left), np.concatenate(right)
    sim = np.empty(len(x))
    for i in range(0, len(x), 1 << 16):
        sim[i : i + (1 << 16)] = np.einsum("ij,ij->i", v[owner[x[i : i + (1 << 16)]]], v[owner[y[i : i + (1 << 16)]]])
    sim = np.round(sim, 6)
    keep = sim >= least
    x, other, sim = x[keep], ids[y[keep]], sim[keep]
    order = np.lexsort((other, -sim, x))
    x, other, sim = x[order], other[order], sim[order]
    first = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
    place = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
    keep = place < k
    return ids[x[keep]], other[keep], sim[keep]


def nearest(rows: DataFrame, widths: dict[str, int], k: int = 5, least: float = 0.9) -> DataFrame:
    """place, id, other, sim: the k most similar usable vectors of each in its space, as far as their cosine is at least ``least``.

    rows has the columns space, id (long) and embedding (array<float>); place is the space's number in alphabetical order."""
    groups = vectors.similar_groups(rows, widths, least)
    plans, members = groups.plans, groups.members
    members = members.drop("ids")
    total, largest, copies = members.agg(F.count("*"), F.max("size"), F.max("n")).first()
    spare = None
    if (copies or 0) > 1:
        rank = F.row_number().over(Window.partitionBy("place", "v").orderBy("id"))
        many = members.where("n > 1").select("place", "v")
        ranked = groups.owners.join(many, ["place", "v"], "left_semi").withColumn("rank", rank).where(F.col("rank") <= k + 1)
        first = ranked.groupBy("place", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        members = members.join(first, ["place", "v"], "left")
        if copies > k + 1:
            spare = first.where(F.size("ids") > k).join(members.where(F.col("n") > k + 1).select("place", "v"), ["place", "v"]).select("place", "v", F.element_at("ids", k + 1).alias("last"))
    else:
        members = members.withColumn("ids", F.lit(None).cast("array<long>"))

    def run(key: str):
        def gathered(table: pa.Table) -> pa.Table:
            parts = []
            for part, v in vectors.segments(table, key, plans):
                ids, owner = part.column("rep").to_numpy(), np.arange(len(v))
                more = part.column("ids").combine_chunks()
                if more.null_count < len(more):
                    lists = [m or [i] for m, i in zip(more.to_pylist(), ids.tolist())]
                    owner = np.repeat(owner, [len(x) for x in lists])
                    ids = np.concatenate([np.array(x, np.int64) for x in lists])
                if len(ids) > 1:
                    a, b, s = top_within(ids, v, owner, k, least)
                    place = part.column("place")[0].as_py()
                    parts.append((np.full(len(a), place, np.int32), a, b, s))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, t) for t in (np.int32, np.int64, np.int64, float)]
            return pa.table(dict(zip(("place", "id", "other", "sim"), columns)))

        return gathered

    small = vectors.floats_of(rows, members.where(F.col("size") <= vectors.TILE).select("place", "v", "rep", "label", "ids"), plans)
    best = vectors.tasks(small, total or 0).groupBy("task").applyInArrow(run("label"), PAIRS)
    if (largest or 0) > vectors.TILE:
        large = members.where(F.col("size") > vectors.TILE)
        lists = large.select("place", "v", "ids")

        def nearest_met(met: DataFrame) -> DataFrame:
            return met.join(lists, ["place", "v"]).select("place", "v", "rep", "ids", "embedding", "bucket").groupBy("bucket").applyInArrow(run("bucket"), PAIRS)

        found = vectors.in_buckets(rows, large.drop("ids"), groups, nearest_met)
        rank = F.row_number().over(Window.partitionBy("place", "id").orderBy(F.desc("sim"), "other"))
        best = best.unionByName(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
    if spare is None:
        return best
    others = groups.owners.join(spare, ["place", "v"]).where("id > last").select("place", "id", "last")
    lists = best.join(spare.select("place", F.col("last").alias("id")), ["place", "id"], "left_semi").withColumnRenamed("id", "last")
    return best.unionByName(others.join(lists, ["place", "last"]).select("place", "id", "other", "sim"))


def similar_pairs(rows: DataFrame, widths: dict[str, int], k: int = 5, least: float = 0.9) -> DataFrame:
    """space, id_a, id_b (id_a < id_b) of which at least one is among the other's k most similar of its space."""
    found = nearest(rows, widths, k, least)
    space = F.element_at(F.array(*[F.lit(s) for s in sorted(widths)]), F.col("place") + 1) if widths else F.lit("")
    return found.select(space.alias("space"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
