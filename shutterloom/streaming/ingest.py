"""Incremental ingest of a directory and progress of jobs, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.operators import catalog, filters
from shutterloom.session import exists
from shutterloom.sources import files


def sightings_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 1000) -> DataFrame:
    """Files of sightings as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def files_stream(spark: SparkSession, root: str, exclude: list[str] | None = None, per_trigger: int = 1000) -> DataFrame:
    """Media files as they appear below a folder: path, source_modified_ns, source_size, and the parts of the header that a
    probe reads (the whole file is one value, so this is for stills and clips; larger ones are listed by sources.files)."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    rows = raw.select(path.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("source_modified_ns"), F.col("length").alias("source_size"), "content")
    return files.probe(rows.where(filters.is_media(F.col("path")) & ~filters.is_excluded(F.col("path"), exclude or [])))


def ingest(stream: DataFrame, store: str, checkpoint: str, done: Callable[[DataFrame, int], None] | None = None):
    """Run everything available through the id-preserving upsert, one catalog snapshot per batch.

    The stream holds sightings (asset_id, path, ..., seen_at) or files (path, ...). A batch writes version ``batch + 1`` from version ``batch``; a replayed batch overwrites its own version with the
    same rows, so a failure neither loses nor repeats a file."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{store.rstrip('/')}/v{number}"
        found = catalog.current(batch).drop("seen_at") if "seen_at" in batch.columns else batch.withColumn("asset_id", F.lit(None).cast("long"))
        found = found.dropDuplicates(["path"])
        if number:
            if not exists(spark, f"{before}/_SUCCESS"):
                raise FileNotFoundError(f"batch {number} begins from a catalog that is not there: {before}")
            after = catalog.upsert(spark.read.parquet(before), found)
        else:
            after = catalog.upsert(found.where(F.lit(False)), found)
        after.write.mode("overwrite").parquet(f"{store.rstrip('/')}/v{number + 1}")
        if done:
            done(after, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rate(events: DataFrame, seconds: int = 5, late: str = "1 minute") -> DataFrame:
    """Work per event type in sliding windows, late events within the watermark counted."""
    window = F.window("ts", f"{seconds} seconds", "1 second")
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("items"), (F.count("*") / seconds).alias("rate"))


def unchanged_filter(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Drops files already seen with the same fingerprint. With a time to live, which needs a continuous trigger, what is
    known of a path is forgotten after so long without it."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                now = (int(r.source_modified_ns), int(r.source_size))
                if known is None or tuple(known) != now:
                    rows.append((r.path, *now))
                    known = now
            if rows:
                yield pd.DataFrame(rows, columns=["path", "source_modified_ns", "source_size"])
        if known is not None:
            state.update(known)
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)

    return (
        stream.select("path", "source_modified_ns", "source_size")
        .groupBy("path")
        .applyInPandasWithState(run, "path string, source_modified_ns long, source_size long", "ns long, size long", "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    )
