"""The catalog: current rows, listings, lookups, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.functions.paths import extension, file_name, folder, natural_key, path_matches
from shutterloom.operators.filters import CAPTURE, timeline
from shutterloom.operators.scope import PathScope

FIELDS = ("path", "source_modified_ns", "source_created_ns", "exif_taken_ns", "source_size", "media_kind", "media_format", "width", "height", "is_animated", "frame_count", "duration_ms", "metadata_version")


def current(sightings: DataFrame) -> DataFrame:
    """One row per asset: the latest sighting (ties: the largest row). Partial aggregates, no window."""
    keep = [c for c in FIELDS if c in sightings.columns]
    latest = F.max(F.struct("seen_at", *[F.col(c) for c in ("source_modified_ns", "source_size")], *[F.col(c) for c in keep if c not in ("source_modified_ns", "source_size")]))
    rows = sightings.where(F.col("asset_id").isNotNull()).groupBy("asset_id").agg(latest.alias("row"))
    return rows.select("asset_id", "row.seen_at", *[F.col(f"row.{c}").alias(c) for c in keep])


def in_scope(assets: DataFrame, scope: PathScope) -> DataFrame:
    return assets.where(scope.column(F.col("path")))


def gallery(assets: DataFrame, scope: PathScope, kind: str = "modified", limit: int | None = None) -> DataFrame:
    """Newest first on the timeline, then the larger id; with a limit a top-k without a full sort."""
    rows = in_scope(assets, scope).withColumns({"display_name": file_name(F.col("path")), "extension": extension(F.col("path")), "folder_path": folder(F.col("path")), "timeline_ns": timeline(kind)})
    ordered = rows.orderBy(F.desc("timeline_ns"), F.desc("asset_id"))
    return ordered.limit(limit) if limit is not None else ordered


def get_many(assets: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of these ids in request order; missing ones are left out. A request is a short list."""
    request = F.array(*[F.lit(int(i)).cast("long") for i in ids]) if ids else F.array().cast("array<long>")
    rows = assets.where(F.col("asset_id").isin(list(set(ids)))) if ids else assets.where(F.lit(False))
    return rows.select("*", F.explode(F.filter(F.transform(request, lambda x, i: F.struct(x.alias("id"), i.alias("position"))), lambda s: s["id"] == F.col("asset_id"))).alias("r")).select("*", F.col("r.position").alias("position")).drop("r").orderBy("position")


def folder_listing(roots: list[str], snapshots: DataFrame, scope: PathScope) -> DataFrame:
    """path, modified_ns: the roots (time unknown) and the snapshot's folders, the latest time of each, as far as shown."""
    spark = snapshots.sparkSession
    base = spark.createDataFrame([(r, None) for r in roots], "path string, modified_ns long")
    both = base.unionByName(snapshots.select("path", "modified_ns"))
    return both.groupBy("path").agg(F.max("modified_ns").alias("modified_ns")).where(scope.shows_folder(F.col("path"))).orderBy("path")


def search_files(assets: DataFrame, scope: PathScope, query: str, by: str = "name", limit: int | None = None) -> DataFrame:
    """Files whose name (or path) matches, in natural order, then by id; an empty query matches all."""
    target = file_name(F.col("path")) if by == "name" else F.col("path")
    rows = in_scope(assets, scope)
    if query.strip():
        rows = rows.where(path_matches(target, query) if by == "path" or not any(c in query for c in "*?") else path_matches(F.col("path"), query))
    ordered = rows.withColumn("natural", natural_key(target)).orderBy("natural", "asset_id")
    return (ordered.limit(limit) if limit is not None else ordered).drop("natural")


def classify(found: DataFrame, assets: DataFrame, metadata_version: int) -> DataFrame:
    """state of each scanned file: new, unchanged, metadata (only the creation time differs) or changed."""
    old = assets.select("path", F.col("asset_id").alias("old_id"), *[F.col(c).alias(f"old_{c}") for c in ("source_modified_ns", "source_size", "source_created_ns", "metadata_version")])
    same = (F.col("source_modified_ns") == F.col("old_source_modified_ns")) & (F.col("source_size") == F.col("old_source_size")) & (F.col("old_metadata_version") == metadata_version)
    state = F.when(F.col("old_id").isNull(), "new").when(same & F.col("source_created_ns").eqNullSafe(F.col("old_source_created_ns")), "unchanged").when(same, "metadata").otherwise("changed")
    return found.join(old, "path", "left").withColumn("state", state).select(*found.columns, F.col("old_id").alias("known_id"), "state")


def upsert(assets: DataFrame, found: DataFrame) -> DataFrame:
    """The catalog after a scan: known paths keep their id, new ones get ids above the largest, in path order.

    Ids are dealt without one global sort: range partitions by path are counted, and each adds the counts before it."""
    largest = assets.agg(F.coalesce(F.max("asset_id"), F.lit(0))).first()[0]
    known = assets.select("path", "asset_id")
    scanned = found.drop("asset_id").join(known, "path", "left")
    fresh = scanned.where(F.col("asset_id").isNull()).drop("asset_id")
    ids = dense_numbers(fresh.select("path").distinct(), "path", "number").select("path", (F.col("number") + largest).alias("asset_id"))
    columns = ["asset_id", *[c for c in assets.columns if c != "asset_id"]]
    kept = assets.join(found.select("path"), "path", "left_anti").select(*columns)
    updated = scanned.where(F.col("asset_id").isNotNull()).unionByName(fresh.join(ids, "path"))
    return kept.unionByName(updated.select(*columns))


def dense_numbers(rows: DataFrame, by: str, name: str, partitions: int | None = None) -> DataFrame:
    """1, 2, ... in the order of a column of distinct values, from a range partitioning and its counts."""
    ranged = rows.repartitionByRange(partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by) if partitions != 0 else rows
    marked = ranged.withColumn("_part", F.spark_partition_id())
    from shutterloom.session import cut

    marked = cut(marked)
    before = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = before.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_start")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    # one row for each partition, so its size is bounded by their number
    return marked.withColumn("_within", within).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_start", "_within")


def directory_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, state of folders by their times in two listings (path, modified_ns): missing, new, changed or unchanged."""
    a, b = before.select("path", F.col("modified_ns").alias("old"), F.lit(True).alias("was")), now.select("path", F.col("modified_ns").alias("new"), F.lit(True).alias("is"))
    state = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def unseen(assets: DataFrame, seen: DataFrame, root: str) -> DataFrame:
    """Catalog rows under a root that a complete walk did not see."""
    return in_scope(assets, PathScope.of([root])).join(seen.select("path"), "path", "left_anti")


def purgeable(assets: DataFrame, removed: PathScope, others: list[PathScope]) -> DataFrame:
    """Assets of a removed library that no other library covers."""
    rows = in_scope(assets, removed)
    for scope in others:
        rows = rows.where(~scope.column(F.col("path")))
    return rows


def nested_folders(folders: DataFrame) -> DataFrame:
    """outer, inner: pairs of folders of which one holds the other, joined on the folder's ancestors (no cross join)."""
    parts = F.split("path", "/")
    above = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda p: p != "")
    inner = folders.where(F.size(parts) > 1).select(F.col("path").alias("inner"), F.explode(above).alias("outer"))
    return inner.join(folders.select(F.col("path").alias("outer")), "outer").select("outer", "inner")


