"""What is indexed, and what is to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterloom.operators.filters import TimeRange, embeddable, non_blank, recognisable, within_dimensions
from shutterloom.operators.media import BUCKETS
from shutterloom.operators.scope import PathScope
from shutterloom.operators.search import fingerprint


def _embedded(state: DataFrame, space: str) -> DataFrame:
    return state.where((F.col("space") == space) & F.col("embedding").isNotNull()).select(*fingerprint()).distinct().withColumn("embedded", F.lit(True))


def text_coverage(recognised: DataFrame, state: DataFrame, space: str) -> DataFrame:
    """indexed, embedded, with_text, pending, last_indexed_ns: one row. recognised: one row per asset."""
    rows = recognised.join(_embedded(state, space), fingerprint(), "left")
    text, done = non_blank(F.col("content")), F.col("embedded").isNotNull()
    return rows.agg(F.count("*").alias("indexed"), F.count("embedded").alias("embedded"), F.count_if(text).alias("with_text"), F.count_if(text & ~done).alias("pending"), F.max("source_modified_ns").alias("last_indexed_ns"))


def image_coverage(assets: DataFrame, state: DataFrame, samples: DataFrame, videos: bool = True) -> DataFrame:
    """total, indexed: one row. An asset is indexed while its state is current and it has a sample."""
    done = state.join(samples.where(F.col("embedding").isNotNull()).select("asset_id").distinct(), "asset_id", "left_semi").select(*fingerprint(), "sampling_version").distinct()
    rows = assets.where(embeddable(videos)).join(done, fingerprint(), "left")
    version = F.when(F.col("media_kind") == "video", 4).otherwise(0)
    by_asset = rows.groupBy("asset_id").agg(F.max(F.coalesce((F.col("sampling_version") == version).cast("int"), F.lit(0))).alias("done"))
    return by_asset.agg(F.count("*").alias("total"), F.coalesce(F.sum("done"), F.lit(0)).alias("indexed"))


def index_states(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """asset_id, state: indexed, stale (another fingerprint is stored) or notIndexed."""
    have = stored.select("asset_id", F.struct("source_modified_ns", "source_size").alias("f"))
    rows = expected.join(have, "asset_id", "left")
    same = F.col("f").isNotNull() & (F.col("f.source_modified_ns") == F.col("source_modified_ns")) & (F.col("f.source_size") == F.col("source_size"))
    level = F.when(same, 2).when(F.col("f").isNotNull(), 1).otherwise(0)
    state = F.element_at(F.array(F.lit("notIndexed"), F.lit("stale"), F.lit("indexed")), F.max(level) + 1)
    return rows.groupBy("asset_id").agg(state.alias("state"))


def text_label() -> Column:
    """notIndexed, noText, embedded or pending, from columns content and embedded."""
    return F.when(F.col("content").isNull(), "notIndexed").when(~non_blank(F.col("content")), "noText").when(F.col("embedded").isNotNull(), "embedded").otherwise("pending")


def text_labels(assets: DataFrame, recognised: DataFrame, state: DataFrame, space: str) -> DataFrame:
    """asset_id, label of every asset that text can be read from."""
    texts = recognised.select(*fingerprint(), "content").distinct()
    rows = assets.where(recognisable()).join(texts, fingerprint(), "left").join(_embedded(state, space), fingerprint(), "left")
    return rows.select("asset_id", text_label().alias("label")).distinct()


def text_backlog(recognised: DataFrame, state: DataFrame, space: str, limit: int | None = None, characters: int | None = None) -> DataFrame:
    """Texts without a current vector, newest first."""
    rows = recognised.where(non_blank(F.col("content"))).join(_embedded(state, space), fingerprint(), "left_anti")
    if characters is not None:
        rows = rows.withColumn("content", F.substring("content", 1, characters))
    ordered = rows.orderBy(F.desc("source_modified_ns"), F.desc("asset_id"))
    return ordered.limit(limit) if limit is not None else ordered


def pending_recognition(assets: DataFrame, recognised: DataFrame, failed: DataFrame | None = None, largest: int | None = None) -> DataFrame:
    """Stills whose text was not read since they changed, without those that failed in the same state."""
    rows = assets.where(recognisable() & within_dimensions(largest)).join(recognised.select(*fingerprint()).distinct(), fingerprint(), "left_anti")
    return rows if failed is None else rows.join(failed.select(*fingerprint()).distinct(), fingerprint(), "left_anti")


def pending_images(assets: DataFrame, state: DataFrame, thumbnails: DataFrame, generator: int, videos: bool = True, limit: int | None = None) -> DataFrame:
    """Media without a current vector state; videos also where no thumbnail of the generator is current. One scan of the
    catalog: what is there is flagged by key, what lacks a flag is pending."""
    version = F.when(F.col("media_kind") == "video", 4).otherwise(0)
    wanted = assets.where(embeddable(videos)).withColumn("sampling_version", version)
    done = state.select(*fingerprint(), "sampling_version").distinct().withColumn("_vector", F.lit(True))
    shown = thumbnails.where(F.col("generator_version") == generator).select(*fingerprint()).distinct().withColumn("_shown", F.lit(True))
    flagged = wanted.join(done, [*fingerprint(), "sampling_version"], "left").join(shown, fingerprint(), "left")
    rows = flagged.where(F.col("_vector").isNull() | ((F.col("media_kind") == "video") & F.col("_shown").isNull())).drop("_vector", "_shown").dropDuplicates(["asset_id"])
    return rows if limit is None else rows.orderBy("asset_id").limit(limit)


def videos_with_all_frames(samples: DataFrame, frames: DataFrame, posters: DataFrame, generator: int) -> DataFrame:
    """asset_id, source_modified_ns, source_size of videos that show every indexed frame: each sample time has its sizes
    (all buckets but the largest; the first one, the poster, all) and the still poster has all buckets.

    samples: asset_id, timestamp_ms; frames: fingerprint, timestamp_ms, size_bucket; posters: thumbnails."""
    times = samples.where(F.col("timestamp_ms").isNotNull()).select("asset_id", "timestamp_ms").distinct()
    first = times.groupBy("asset_id").agg(F.min("timestamp_ms").alias("first"), F.count("*").alias("times"))
    need = first.select("asset_id", "first", (F.col("times") * (len(BUCKETS) - 1) + 1).alias("need"))
    wanted = times.join(need, "asset_id")
    have = frames.where(F.col("size_bucket").isin(*BUCKETS)).select(*fingerprint(), "timestamp_ms", "size_bucket").distinct().join(wanted, ["asset_id", "timestamp_ms"])
    have = have.where((F.col("size_bucket") < BUCKETS[-1]) | (F.col("timestamp_ms") == F.col("first")))
    full = have.groupBy(*fingerprint()).agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need").select(*fingerprint())
    poster = posters.where((F.col("generator_version") == generator) & F.col("size_bucket").isin(*BUCKETS)).groupBy(*fingerprint()).agg(F.count_distinct("size_bucket").alias("n")).where(F.col("n") == len(BUCKETS))
    return full.join(poster.select(*fingerprint()), fingerprint(), "left_semi")


def thumbnail_backfill(assets: DataFrame, scope: PathScope, time: TimeRange) -> DataFrame:
    """The assets of a library whose thumbnails are made again: scope first, then the range on its timeline."""
    return assets.where(scope.column(F.col("path")) & time.column())


def batch_ids(ids: list[int], most: int = 1000) -> list[int]:
    """The ids of a lookup: positive, each once, no more than ``most``; otherwise an error."""
    if len(ids) > most or any(i <= 0 for i in ids) or len(set(ids)) < len(ids):
        raise ValueError(f"a lookup names up to {most} different positive ids")
    return ids
