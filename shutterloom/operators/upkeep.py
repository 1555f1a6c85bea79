"""Writes to the derived stores as new snapshots: replace, delete, prune, sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.functions.paths import glob_regex
from shutterloom.operators.catalog import purgeable, unseen
from shutterloom.operators.filters import DEFAULT_EXCLUSIONS
from shutterloom.operators.media import BUCKETS
from shutterloom.operators.scope import PathScope
from shutterloom.operators.search import fingerprint


def upsert_latest(stored: DataFrame, new: DataFrame, key: str = "asset_id") -> DataFrame:
    """Stored rows of other keys and the new rows; of several new rows for a key the last written one."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("written_at")))
    latest = new.withColumn("_r", rank).where("_r = 1").drop("_r")
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(latest)


def save_text_vectors(state: DataFrame, new: DataFrame, recognised: DataFrame, space: str) -> DataFrame:
    """new: asset_id, embedding, run_id. Ids without a text are skipped; the text's fingerprint is copied."""
    known = new.join(recognised.select(*fingerprint()).dropDuplicates(["asset_id"]), "asset_id").withColumn("space", F.lit(space)).select(*state.columns)
    kept = state.join(known.select("space", "asset_id"), ["space", "asset_id"], "left_anti")
    return kept.unionByName(known)


def replace_samples(samples: DataFrame, new: DataFrame) -> DataFrame:
    """All samples of the assets that are written again give way."""
    return samples.join(new.select("asset_id").distinct(), "asset_id", "left_anti").unionByName(new)


def delete_assets(ids: DataFrame, stores: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every store without the ids, in the given order: derived stores first, the catalog last."""
    gone = ids.select("asset_id").distinct()
    return {name: df.join(gone, "asset_id", "left_anti") for name, df in stores.items()}


def without_parent(derived: DataFrame, assets: DataFrame) -> DataFrame:
    """Ids of a derived store that the catalog does not have."""
    return derived.select("asset_id").where(F.col("asset_id").isNotNull()).distinct().join(assets.select("asset_id").distinct(), "asset_id", "left_anti")


def sweep_generators(thumbnails: DataFrame, generator: int, ids: DataFrame | None = None) -> DataFrame:
    """Thumbnails without those of other generators, of all assets or of the given ones."""
    old = F.col("generator_version") != generator
    if ids is None:
        return thumbnails.where(~old)
    marked = thumbnails.join(ids.select("asset_id").distinct().withColumn("_in", F.lit(True)), "asset_id", "left")
    return marked.where(~(old & F.col("_in").isNotNull())).drop("_in")


def failures(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One failure per asset with the fingerprint it failed in."""
    return stored.join(new.select("asset_id"), "asset_id", "left_anti").unionByName(new.dropDuplicates(["asset_id"]))


def request_scans(folders: DataFrame, paths: list[str]) -> DataFrame:
    """scan_requested raised by one above both counters for the folders."""
    hit = F.col("path").isin(paths) & ~F.col("excluded")
    return folders.withColumn("scan_requested", F.when(hit, F.greatest("scan_requested", "scan_completed") + 1).otherwise(F.col("scan_requested")))


def complete_scans(folders: DataFrame, done: DataFrame) -> DataFrame:
    """scan_completed raised to what was done (path, request), never lowered."""
    rows = folders.join(done.select("path", F.col("request").alias("_done")), "path", "left")
    return rows.withColumn("scan_completed", F.greatest("scan_completed", F.coalesce("_done", "scan_completed"))).drop("_done").select(*folders.columns)


def in_reconcile_scope(path: Column, root: str, recursive: bool = True, exclude: tuple[str, ...] = (), patterns: tuple[str, ...] = DEFAULT_EXCLUSIONS) -> Column:
    """Below the root (directly, if not recursive), in no excluded folder, and below no folder that matches a pattern."""
    base = root.rstrip("/") + "/"
    got = PathScope.of([root], list(exclude)).column(path)
    if not recursive:
        got = got & ~F.substring(path, len(base) + 1, 1 << 30).contains("/")
    for e in exclude:
        got = got & (path != e)
    for p in patterns:
        body = glob_regex(p).removeprefix("^").removesuffix("$")
        # the path itself or a folder on the way to it, the root included
        parts = F.split(path, "/")
        ways = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))  # noqa: B023
        got = got & ~F.exists(ways, lambda w: (F.length(w) >= len(base) - 1) & w.rlike(f"^{body}$"))  # noqa: B023
    return got


def reconcile(assets: DataFrame, listing: DataFrame, root: str, complete: bool, scope: Column | None = None, again: DataFrame | None = None) -> DataFrame:
    """asset_id, path of catalog rows that are gone from disk.

    Nothing is gone unless the walk was complete and its listing (path) shows the root at all. Rows outside ``scope`` are
    left alone; rows that a second listing, taken just before the deletion, shows again are spared."""
    rows = unseen(assets, listing, root).select("asset_id", "path")
    if not complete or not listing.limit(1).count():
        return rows.where(F.lit(False))
    rows = rows.where(scope) if scope is not None else rows
    return rows if again is None else rows.join(again.select("path").distinct(), "path", "left_anti").select("asset_id", "path")


def prune_missing(stores: dict[str, DataFrame], gone: DataFrame, dry_run: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """The stores without what is gone, and store, rows: how many rows of each that concerns. A dry run only counts."""
    ids = gone.select("asset_id").distinct()
    counts = None
    for name, df in stores.items():
        one = df.join(ids, "asset_id", "left_semi").agg(F.count("*").alias("rows")).select(F.lit(name).alias("store"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return (stores if dry_run else delete_assets(ids, stores)), counts


def purge(assets: DataFrame, removed: PathScope, others: list[PathScope], folder: str | None = None) -> DataFrame:
    """Assets of a removed library that no other one covers, of one folder of it if that is given."""
    return purgeable(assets, removed.focused(folder) if folder is not None else removed, others)


# --- spaces of text vectors


def declare_model(models: DataFrame, state: DataFrame, space: str, model: str, dimensions: int, reset: bool = False) -> tuple[DataFrame, DataFrame]:
    """models and state with the space's model declared. Another model or width than the declared one needs ``reset``,
    which drops the space's vectors."""
    if not model.strip() or dimensions < 1:
        raise ValueError("a model has a name and a width of 1 or more")
    known = models.where(F.col("space") == space).select("model", "dimensions").first()
    changing = known is not None and tuple(known) != (model, dimensions)
    if changing and not reset:
        raise ValueError(f"{space} holds vectors of {known.model} with {known.dimensions} dimensions; another model needs a reset")
    new = models.sparkSession.createDataFrame([(space, model, dimensions)], "space string, model string, dimensions int")
    return models.where(F.col("space") != space).unionByName(new), clear_space(state, space) if changing else state


def clear_space(state: DataFrame, space: str) -> DataFrame:
    """Without the vectors of a space; its model stays declared."""
    return state.where(~F.col("space").eqNullSafe(space))


def without_state(vectors: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors (any columns) whose keys have no row of state: left over by broken runs, to be swept."""
    return vectors.join(state.select(*keys).distinct(), keys, "left_anti")


# --- batches of results


def store_thumbnails(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the new thumbnails, one for each asset, bucket and generator (the last written). One bad row (ids and
    versions not positive, a side of 0 or beyond the bucket, no data) rejects the batch."""
    key = ["asset_id", "size_bucket", "generator_version"]
    good = (F.col("asset_id") > 0) & (F.col("generator_version") > 0) & F.col("size_bucket").isin(*BUCKETS) & (F.col("source_size") >= 0)
    good = good & F.col("width").between(1, F.col("size_bucket")) & F.col("height").between(1, F.col("size_bucket")) & (F.octet_length("data") > 0)
    checked = new.withColumn("asset_id", F.when(good, F.col("asset_id")).otherwise(F.raise_error(F.concat(F.lit("not a thumbnail: "), F.col("asset_id").cast("string"))).cast("long")))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("written_at")))
    latest = checked.withColumn("_r", rank).where("_r = 1").drop("_r")
    return stored.join(latest.select(*key), key, "left_anti").unionByName(latest)


def store_texts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the newly recognised texts; of several for an asset the last written."""
    return upsert_latest(stored, new)


def progress(deltas: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """The sum of each counter's deltas; a counter nobody raised is 0."""
    return deltas.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def coalesced(snapshots: DataFrame, job: str, at: str, every_ms: int = 100) -> DataFrame:
    """The last snapshot of each job in each interval: what a slow reader gets to see."""
    slot = F.floor(F.unix_millis(F.col(at).cast("timestamp")) / every_ms)
    columns = [c for c in snapshots.columns if c not in (job, at)]
    last = F.max(F.struct(at, *columns))
    return snapshots.groupBy(job, slot.alias("slot")).agg(last.alias("s")).select(job, f"s.{at}", *[F.col(f"s.{c}").alias(c) for c in columns])


def within_budget(entries: DataFrame, size: str, used: str, budget: int, group: str | None = None) -> DataFrame:
    """The most recently used entries that fit a budget of bytes together; one larger than the budget is never kept."""
    rows = entries.where(F.col(size) <= budget)
    order = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(F.desc(used), size)
    return rows.withColumn("_sum", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= budget).drop("_sum")


def accepted_generations(requests: DataFrame, client: str = "client", generation: str = "generation", at: str = "at") -> DataFrame:
    """requests with superseded: whether the client had asked with a later generation before."""
    order = Window.partitionBy(client).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("superseded", F.col(generation) < F.max(generation).over(order))


def retained(entries: DataFrame, now_ms: int, ttl_ms: int = 24 * 3600 * 1000, most: int = 4096) -> DataFrame:
    """Keyed state (key, created_ms, touched_ms, pinned) that is kept: pinned or touched within the time to live; of new keys beyond ``most``
    the later ones are refused."""
    live = entries.where(F.col("pinned") | (F.lit(now_ms) - F.col("touched_ms") < ttl_ms))
    return live.orderBy("created_ms", "key").limit(most)
