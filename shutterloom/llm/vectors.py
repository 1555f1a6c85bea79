"""Multi-index hashing of vectors: learned rotated binary codes, their substrings indexed and probed.

1. A rotation is learned (iterative quantisation on principal axes) from a bounded sample and turns each vector into a
   binary code of ``BITS`` bits or more. Vectors of one code are one node, so copies don't multiply.
2. The code is split into substrings, each of them an index. A node enters, in each index, the bucket of its own substring
   and those of the likeliest neighbouring substrings (probes: the bits nearest to the rotation's planes flipped), so two
   codes that differ in a few bits of a substring still meet, and fewer indexes are needed than for equal substrings.
   Entries travel packed, one row per bucket and batch.
3. In a bucket every two codes within the Hamming radius are linked; only stars (member, smallest member) leave it.
   The stars are contracted to groups, and each vector is shuffled to its group once, where the exact floats decide.

The plan (substring length, indexes, probes) follows the number of vectors and the threshold: buckets keep their mean size
and recall holds at any scale; what grows is the number of entries per vector. Buckets are taken in passes of about ``ENTRIES``
entries a vector, and what a pass shuffled is removed before the next, so that disk follows the input. A bucket of more than ``BOUND`` codes is split
by windows of the bits that follow its substring. Groups of more than ``TILE`` vectors are not gathered in one task: their
floats are sent to the buckets instead, where they are compared exactly, so that chained groups cost no square of their size.

Rows have the columns space, id, embedding: any number of collections go through one plan. A vector is usable if it is
not null, has its space's width, only finite numbers and not only zeros; others are left out, repeated rows count once,
of different vectors under one id the one with the smallest 64-bit hash holds, rows without an id or space are left out. Vectors with
one hash are copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.llm.components import components
from shutterloom.session import discard, shuffles_removed, written

#: Vectors that a rotation is learned from, about.
SAMPLE = 8192
BITS = 192
#: Entries in a bucket, on average.
BUCKET = 4000
#: Codes in a bucket beyond which it is split, and the windows it is split by.
BOUND, WINDOWS = 32_768, 4
#: Split buckets that travel with the code, at most; beyond, substrings are made longer.
HOT = 100_000
RECALL = 0.99
#: Vectors of a group that one task takes.
TILE = 6144
#: Vectors in one task's groups, about.
TASK = 16_384
#: Entries of a vector that are on disk at once, about, and entries that are packed together.
ENTRIES, PACK = 16, 1 << 21
#: Vectors that a pass over floats is sized for, at least.
LEAST_PASS = 1_000_000


class Plan(NamedTuple):
    place: int
    width: int
    length: int
    tables: int
    probes: int
    radius: int
    rotation: np.ndarray

    @property
    def words(self) -> int:
        return self.rotation.shape[1] // 64


def usable_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and float32 values (one row each) of the usable vectors of an Arrow list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.nan_to_num(lengths.astype(float), nan=-1) == width)
    flat = column.take(pa.array(at)).flatten()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    v = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)
    ok = np.isfinite(v).all(1) & (v != 0).any(1)
    return at[ok], v[ok]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows in float64, of length 1."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """A (width, bits) matrix whose signs are the code: iterative quantisation from several starts."""
    x = unit(sample) if len(sample) else np.zeros((0, sample.shape[1]))
    width = sample.shape[1]
    rng = np.random.default_rng(seed)
    parts = []
    if len(x) > width:
        _, axes = np.linalg.eigh(x.T @ x / len(x))
    else:
        axes = np.eye(width)
    y = x @ axes
    for _ in range(-(-bits // width)):
        r, _ = np.linalg.qr(rng.standard_normal((width, width)))
        if len(x) > width:
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.sign(y @ r).T @ y)
                r = (u @ w).T
        parts.append(axes @ r)
    return np.concatenate(parts, 1)[:, :bits].astype(np.float32)


def radius(cosine: float, bits: int) -> int:
    """Hamming radius that holds pairs of this cosine with a margin of 2.5 deviations: 99 % of those at the very
    threshold and all but a few of a million of closer ones, while unrelated codes stay far outside."""
    p = math.acos(cosine) / math.pi
    return int(bits * p + 2.5 * math.sqrt(bits * p * (1 - p)))


@cache
def _flips(bits: int) -> np.ndarray:
    """All subsets of so many bits, as rows of 0 and 1."""
    return (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1


def probe(margins: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` likeliest substrings of each row of margins: its signs, and those with the bits flipped whose margins
    sum up least. One row of integers for each row."""
    length = margins.shape[1]
    weight = 1 << np.arange(length, dtype=np.int64)
    own = (margins > 0) @ weight
    if probes == 1:
        return own[:, None]
    size = np.abs(margins)
    few = min(length, 6)
    at = np.argpartition(size, few - 1, axis=1)[:, :few]
    cost = np.take_along_axis(size, at, 1) @ _flips(few).T.astype(size.dtype)
    best = np.argpartition(cost, min(probes, cost.shape[1]) - 1, axis=1)[:, :probes]
    return own[:, None] ^ (_flips(few)[best] * weight[at][:, None, :]).sum(2)


@cache
def meeting(length: int, probes: int, cosine: float) -> float:
    """The chance that two vectors of this cosine, spread evenly over many dimensions, meet in one index."""
    rng = np.random.default_rng(length)
    x, z = rng.standard_normal((2, 4000, length))
    a, b = probe(x, probes), probe(cosine * x + math.sqrt(1 - cosine * cosine) * z, probes)
    return float((a[:, :, None] == b[:, None, :]).any((1, 2)).mean())


@cache
def plan_tables(codes: int, cosine: float) -> tuple[int, int, int]:
    """(substring length, indexes, probes) for a number of codes: the fewest entries with which a pair of this cosine
    meets with RECALL, in buckets of BUCKET entries on average."""
    best = None
    for probes in (1, 2, 4, 8):
        length = max(2, min(24, round(math.log2(max(1, codes * probes / BUCKET)))))
        if probes > 1 << (length - 1):
            continue
        together = min(meeting(length, probes, cosine), 1 - 1e-9)
        tables = max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - together)))
        if best is None or tables * probes < best[1] * best[2]:
            best = (length, tables, probes)
    return best


def plans_for(rows: DataFrame, widths: dict[str, int], cosine: float) -> dict[str, Plan]:
    """A plan for each space, its rotation learned from about SAMPLE of its vectors, those with the smallest hash of the id."""
    fits = F.lit(False)
    for space, width in widths.items():
        fits = fits | ((F.col("space") == space) & (F.size("embedding") == width))
    counts = {r[0]: r[1] for r in rows.where(fits).groupBy("space").agg(F.approx_count_distinct(F.xxhash64("embedding"))).collect()}
    share = F.lit(0.0)
    for space, n in counts.items():
        share = F.when(F.col("space") == space, min(1.0, SAMPLE / max(n, 1))).otherwise(share)
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)
    sample = rows.where(fits & drawn).select("space", "id", "embedding").limit(2 * SAMPLE * max(1, len(widths))).toArrow()
    out = {}
    for place, (space, width) in enumerate(sorted(widths.items())):
        mine = sample.filter(pc.equal(sample.column("space"), space)).sort_by("id").column("embedding").combine_chunks()
        mine = mine.chunk(0) if isinstance(mine, pa.ChunkedArray) and mine.num_chunks else mine
        v = usable_rows(mine, width)[1] if len(mine) else np.zeros((0, width), np.float32)
        length, tables, probes = plan_tables(counts.get(space, 0), cosine)
        bits = -(-max(BITS, length * tables) // 64) * 64
        out[space] = Plan(place, width, length, tables, probes, radius(cosine, bits), learn_rotation(v, bits))
    return out


def binaries(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column, from one buffer."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def pieces(sorted_rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The rows from each start to the next as one binary value."""
    sorted_rows = np.ascontiguousarray(sorted_rows)
    width = sorted_rows.itemsize * (sorted_rows.shape[1] if sorted_rows.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.r_[starts, len(sorted_rows)] * width).astype(np.int32)), pa.py_buffer(sorted_rows)])


def joined(column) -> np.ndarray:
    """The bytes of a binary column, one value after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def node_of(codes: np.ndarray, place: int) -> np.ndarray:
    """A 64-bit name of each code of a space."""
    h = np.full(len(codes), place + 1, np.uint64)
    for k in range(codes.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k])
    return h.view(np.int64)


def encode(v: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows of uint64) and bucket keys (rows of int64: index and substring)."""
    p = unit(v).astype(np.float32) @ plan.rotation
    codes = np.packbits(p > 0, axis=1, bitorder="little").view(np.uint64)
    keys = [probe(p[:, t * plan.length : (t + 1) * plan.length], plan.probes) + (t << plan.length) for t in range(plan.tables)]
    return codes, np.concatenate(keys, 1)


def with_hash(rows: DataFrame) -> DataFrame:
    return rows.select("space", "id", "embedding", F.xxhash64("embedding").alias("v"))


def encoded(rows: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """place, id, v, node, code, keys of the usable rows; v is the vector's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space, plan in plans.items():
                part = batch.filter(pc.equal(batch.column(0), space))
                if not part.num_rows:
                    continue
                at, v = usable_rows(part.column(2), plan.width)
                codes, keys = encode(v, plan) if len(v) else (np.zeros((0, plan.words), np.uint64), np.zeros((0, plan.tables * plan.probes), np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel().astype(np.int32)))
                at = pa.array(at)
                columns = [pa.array(np.full(len(v), plan.place, np.int32)), part.column(1).take(at), part.column(3).take(at), pa.array(node_of(codes, plan.place)), binaries(codes), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "id", "v", "node", "code", "keys"])

    return with_hash(rows).mapInArrow(run, "place int, id long, v long, node long, code binary, keys array<int>")


def split_keys(nodes: DataFrame) -> dict[tuple[int, int], int]:
    """(place, key) -> bits to split by, of the buckets with more than BOUND codes. At most HOT of them."""
    with shuffles_removed(nodes.sparkSession):
        hot = nodes.select("place", F.explode("keys").alias("key")).groupBy("place", "key").agg(F.count("*").alias("n")).where(F.col("n") > BOUND)
        return {(r.place, r.key): math.ceil(math.log2(r.n / BUCKET)) + 1 for r in hot.orderBy(F.desc("n")).limit(HOT).collect()}


def entries(places: np.ndarray, keys: np.ndarray, codes: np.ndarray, plan: Plan, hot: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each entry of the rows of one space: keys has the keys of each row."""
    flat = keys.ravel().astype(np.int64)
    row = np.repeat(np.arange(len(keys)), keys.shape[1])
    bucket = flat | (plan.place << 33)
    mine = {k: s for (p, k), s in hot.items() if p == plan.place}
    if mine:
        names = np.array(sorted(mine))
        found = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        split = names[found] == flat
        if split.any():
            more = [np.array([mine[int(k)] for k in flat[split]])]
            bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little")
            first = ((flat[split] >> plan.length) + 1) * plan.length
            parts_b, parts_r = [bucket[~split]], [row[~split]]
            for w in range(WINDOWS):
                h = bucket[split].astype(np.uint64) * np.uint64(WINDOWS) + np.uint64(w)
                for k in range(int(more[0].max())):
                    bit = bits[row[split], (first + w * more[0] + k) % bits.shape[1]]
                    h = np.where(k < more[0], mix(h * np.uint64(3) + bit), h)
                parts_b.append((h >> np.uint64(2)).view(np.int64) | (1 << 62))
                parts_r.append(row[split])
            bucket, row = np.concatenate(parts_b), np.concatenate(parts_r)
    return bucket, row


def rows_of(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A binary or list column of values of one length as a matrix."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    return joined(column).view(dtype).reshape(len(column), width)


def in_pass(bucket: np.ndarray, number: int, passes: int) -> np.ndarray:
    """Whether each bucket is taken in this pass: every bucket is in one, whole."""
    return mix(bucket.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(passes) == number


def passes_for(plans: dict[str, Plan]) -> int:
    """So many passes that a vector has about ENTRIES entries in each."""
    return max([1, *(math.ceil(p.tables * p.probes / ENTRIES) for p in plans.values())])


def packs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches put together until they have so many rows, so that a bucket gets few pieces."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def buckets(nodes: DataFrame, plans: dict[str, Plan], hot: dict, number: int = 0, passes: int = 1) -> DataFrame:
    """bucket, place, codes: the codes of each bucket of a pass, packed by batch. nodes: place, node, code, keys."""
    by_place = {p.place: p for p in plans.values()}
    together = PACK // max([1, *(p.tables * p.probes for p in plans.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packs(batches, together):
            for place, plan in by_place.items():
                part = batch.filter(pc.equal(batch.column(0), place))
                n = part.num_rows
                if not n:
                    continue
                codes = rows_of(part.column(1), np.uint64, plan.words)
                keys = rows_of(part.column(2), np.int32, plan.tables * plan.probes)
                bucket, row = entries(place, keys, codes, plan, hot)
                if passes > 1:
                    mine = in_pass(bucket, number, passes)
                    bucket, row = bucket[mine], row[mine]
                    if not len(bucket):
                        continue
                order = np.argsort(bucket, kind="stable")
                bucket, row = bucket[order], row[order]
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                columns = [pa.array(bucket[starts]), pa.array(np.full(len(starts), place, np.int32)), pieces(codes[row], starts)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "place", "codes"])

    return nodes.select("place", "code", "keys").mapInArrow(run, "bucket long, place int, codes binary")


def link(x: np.ndarray, floor: float) -> np.ndarray:
    """The smallest position of each row's component, where rows whose product is at least ``floor`` are linked."""
    n = len(x)
    a, b = [], []
    step = int(max(64, min(512, (1 << 24) // max(1, n))))
    for i in range(0, n, step):
        near = x[i : i + step] @ x[i:].T >= floor
        if np.count_nonzero(near) <= 8 * n:
            p, q = np.nonzero(near)
            keep = q > p
            a.append(p[keep] + i)
            b.append(q[keep] + i)
        else:  # dense: the first neighbour of each, and which of these rows have a neighbour in common
            q = np.flatnonzero(near.any(0))
            a.append(near[:, q].argmax(0) + i)
            b.append(q + i)
            f = near.astype(np.float32)
            p, q = np.nonzero(np.triu(f @ f.T, 1))
            a.append(p + i)
            b.append(q + i)
    label = np.arange(n)
    x, y = np.concatenate(a) if a else np.zeros(0, int), np.concatenate(b) if b else np.zeros(0, int)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    return label


def stars(blocks: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """a, b: each code of a bucket that is linked within the Hamming radius, and the smallest node it is linked with."""
    by_place = {p.place: (p.words, p.radius) for p in plans.values()}

    def run(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        words, most = by_place[place]
        codes = joined(table.column("codes")).view(np.uint64).reshape(-1, words)
        names, at = np.unique(node_of(codes, place), return_index=True)
        signs = np.unpackbits(np.ascontiguousarray(codes[at]).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
        root = names[link(signs, signs.shape[1] - 2 * most - 0.5)]
        linked = root != names
        return pa.table({"a": names[linked], "b": root[linked]})

    return blocks.groupBy("bucket").applyInArrow(run, "a long, b long")


def all_stars(nodes: DataFrame, plans: dict[str, Plan], hot: dict) -> DataFrame:
    """The stars of all buckets, those of a pass written before the next one begins."""
    n = passes_for(plans)
    if n == 1:
        return stars(buckets(nodes, plans, hot), plans)
    return reduce(DataFrame.unionByName, [written(stars(buckets(nodes, plans, hot, k, n), plans).distinct()) for k in range(n)])


def contracted(edges: DataFrame) -> DataFrame:
    """node, label: of every node of the stars (a, b), the smallest node of its component.

    A node's roots are first joined to the smallest of them, so that only the graph of roots is left to contract."""
    edges = edges.where("a <> b")
    low = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("s")))
    roots = low.select(F.explode("s").alias("b")).distinct()
    between = low.where(F.size("s") > 1).select(F.explode("s").alias("a"), F.col("m").alias("b")).where("a <> b")
    climbing = low.join(roots, F.col("a") == roots.b, "left_semi").select("a", F.col("m").alias("b"))
    labels = components(between.unionByName(climbing).distinct())
    of = labels.withColumnRenamed("node", "m")
    own = low.select(F.col("a").alias("node"), "m").join(of, "m", "left").select("node", F.coalesce("label", "m").alias("label"))
    top = roots.withColumnRenamed("b", "m").join(low.select(F.col("a").alias("m")), "m", "left_anti").join(of, "m", "left").select(F.col("m").alias("node"), F.coalesce("label", "m").alias("label"))
    return own.unionByName(top)


class Groups(NamedTuple):
    #: place, v, node, rep (the smallest id), n (ids), label, size (different vectors in the group), ids (in the group); groups of copies included
    members: DataFrame
    #: place, id, v of every usable id
    owners: DataFrame
    #: place, node, code, keys
    nodes: DataFrame
    plans: dict[str, Plan]
    hot: dict


def similar_groups(rows: DataFrame, widths: dict[str, int], cosine: float) -> Groups:
    """The groups of vectors that may be similar. Vectors alone in their group, without a copy, are left out."""
    rows = rows.where(F.col("id").isNotNull())
    plans = plans_for(rows, widths, cosine)
    every = written(encoded(rows, plans))
    nodes = written(every.select("place", "node", "code", "keys").dropDuplicates(["place", "node"]))
    owners = every.groupBy("place", "id").agg(F.min(F.struct("v", "node")).alias("o")).select("place", "id", "o.v", "o.node")
    owners = written(owners)
    discard(every)
    hot = split_keys(nodes)
    edges = all_stars(nodes, plans, hot)
    labels = contracted(edges)
    if passes_for(plans) > 1:
        discard(edges)
    vectors = owners.groupBy("place", "v", "node").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    found = written(vectors.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    sizes = found.groupBy("label").agg(F.count("*").alias("size"), F.sum("n").alias("ids")).where("ids > 1")
    members = written(found.join(sizes, "label").select("place", "v", "node", "rep", "n", "label", "size", "ids"))
    discard(found)
    return Groups(members, owners, nodes, plans, hot)


def floats_of(rows: DataFrame, members: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """members with the embedding of their vector, taken from the row of the smallest id. members: place, v, rep, ..."""
    place = F.lit(None).cast("int")
    for space, plan in plans.items():
        place = F.when(F.col("space") == space, plan.place).otherwise(place)
    full = with_hash(rows).select(place.alias("place"), F.col("id").alias("rep"), "v", "embedding")
    return members.join(full, ["place", "v", "rep"])


def segments(table: pa.Table, key: str, plans: dict[str, Plan]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of each value of ``key``, in the order of rep and each rep once, with their unit vectors."""
    k, rep = table.column(key).to_numpy(), table.column("rep").to_numpy()
    order = np.lexsort((rep, k))
    k, rep = k[order], rep[order]
    fresh = np.r_[True, (k[1:] != k[:-1]) | (rep[1:] != rep[:-1])] if len(k) else np.zeros(0, bool)
    order, k = order[fresh], k[fresh]
    widths = {p.place: p.width for p in plans.values()}
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    table = table.take(pa.array(order)).combine_chunks()
    place = table.column("place").to_numpy()
    lists = table.column("embedding").chunk(0) if table.num_rows else None
    rest = table.drop_columns(["embedding"])
    for i, j in zip(starts, np.r_[starts[1:], len(k)]):
        v = lists.slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(j - i, widths[int(place[i])])
        yield rest.slice(i, j - i), unit(v)


def tasks(members: DataFrame, total: int) -> DataFrame:
    """members with a task number: whole groups, TASK vectors in a task on average."""
    return members.withColumn("task", F.pmod(F.xxhash64("label"), F.lit(max(1, math.ceil(total / TASK)))))


def in_buckets(rows: DataFrame, members: DataFrame, groups: Groups, met: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``met`` makes of the members of large groups with their embedding, one row for each of their buckets (column bucket).

    met gets the buckets of one pass at a time, and its distinct rows are written: all entries' floats would be many times the
    input, so a pass has about as many bytes of them as one pass has of all vectors' codes."""
    plans, hot = {p.place: p for p in groups.plans.values()}, groups.hot
    large, total = members.count(), groups.nodes.count()
    widest = max((p.tables * p.probes * p.width * 4 for p in plans.values()), default=0)
    passes = max(1, math.ceil(widest * large / (ENTRIES * BITS // 8 * max(total, LEAST_PASS))))

    def run(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, plan in plans.items():
                part = batch.filter(pc.equal(batch.column("place"), place))
                if not part.num_rows:
                    continue
                codes = rows_of(part.column("code"), np.uint64, plan.words)
                bucket, row = entries(place, rows_of(part.column("keys"), np.int32, plan.tables * plan.probes), codes, plan, hot)
                mine = in_pass(bucket, number, passes)
                bucket, row = bucket[mine], row[mine]
                label = part.column("label").to_numpy()[row].view(np.uint64)
                where = mix(label + mix(bucket.astype(np.uint64))).view(np.int64)
                for i in range(0, len(row), 20_000):
                    out = part.drop_columns(["code", "keys"]).take(pa.array(row[i : i + 20_000]))
                    yield out.append_column("bucket", pa.array(where[i : i + 20_000]))

    keyed = members.join(groups.nodes, ["place", "node"])
    full = floats_of(rows, keyed, groups.plans).select("place", "v", "node", "rep", "n", "label", "size", "code", "keys", "embedding")
    full = written(full) if passes > 1 else full
    schema = "place int, v long, node long, rep long, n long, label long, size long, embedding array<float>, bucket long"

    def part(number: int) -> DataFrame:
        return met(full.mapInArrow(lambda batches: run(batches, number), schema)).distinct()

    if passes == 1:
        return part(0)
    parts = [written(part(k)) for k in range(passes)]
    discard(full)
    return reduce(DataFrame.unionByName, parts).distinct()
