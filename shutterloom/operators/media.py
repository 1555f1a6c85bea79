"""Arithmetic of media: sample times, sizes, crops, thumbnails, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = (128, 256, 512, 1024)


def spread(duration: Column, interval: int = 3000, least: int = 3, most: int = 12) -> Column:
    """Times in ms, in the middle of equal parts; as many parts as intervals within bounds; none for an unknown length."""
    n = F.least(F.greatest(F.ceil(duration / interval), F.lit(least)), F.lit(most)).cast("long")
    times = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.floor((2 * i + 1) * duration / (2 * n)).cast("long"))
    return F.when(duration > 0, times).otherwise(F.array().cast("array<long>"))


def at_percentages(duration: Column, percentages: list[int]) -> Column:
    if any(not 0 <= p <= 100 for p in percentages):
        raise ValueError("percentages are between 0 and 100")
    times = F.array(*[F.floor(duration * p / 100).cast("long") for p in percentages])
    return F.when(duration > 0, times).otherwise(F.array().cast("array<long>"))


def fit_within(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Scaled down or up so that the longer side is ``most``, each side 1 at least."""
    ratio = F.least(F.lit(float(most)) / width, F.lit(float(most)) / height)
    side = lambda v: F.greatest(F.floor(v * ratio + 0.5), F.lit(1)).cast("int")
    return side(width), side(height)


def align(value: Column, ratio: Column, to: int = 32) -> Column:
    """Scaled, rounded to a multiple, one multiple at least."""
    return (F.greatest(F.floor(value * ratio / to + 0.5), F.lit(1)) * to).cast("int")


def oriented(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Orientations 5 to 8 swap the sides."""
    swap = orientation.isin(5, 6, 7, 8)
    return F.when(swap, height).otherwise(width), F.when(swap, width).otherwise(height)


def crop_axis(resized: Column, crop: int) -> tuple[Column, Column]:
    """Start and length of a centred crop as fractions; a shorter axis is padded, so it starts below 0."""
    gap = F.floor(F.abs(resized - crop) / 2)
    start = F.when(resized >= crop, gap).otherwise(-gap)
    return start / resized, F.lit(float(crop)) / resized


def crop_shortest_edge(width: Column, height: Column, edge: int, crop: int) -> Column:
    """struct x, y, w, h of the source after a resize of the shorter side to ``edge``."""
    long = F.floor(edge * F.greatest(width, height) / F.least(width, height))
    w, h = F.when(width <= height, F.lit(edge)).otherwise(long), F.when(width <= height, long).otherwise(F.lit(edge))
    (x, cw), (y, ch) = crop_axis(w, crop), crop_axis(h, crop)
    return F.struct(x.alias("x"), y.alias("y"), cw.alias("w"), ch.alias("h"))


def crop_stretch() -> Column:
    """struct x, y, w, h of an input that is stretched: all of the source."""
    return F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))


def crop_capped_edge(width: Column, height: Column, edge: int, most: int, crop: int) -> Column:
    """struct x, y, w, h after a resize of the shorter side to ``edge``, unless the longer one would exceed ``most``: then that
    is its length. Whole pixels, rounded down at each step."""
    scale = lambda v, a, b: F.floor(v * a / b)
    upright = width < height
    w0 = F.when(upright, F.lit(edge)).otherwise(scale(F.lit(edge), width, height))
    h0 = F.when(upright, scale(F.lit(edge), height, width)).otherwise(F.lit(edge))
    over, tall = F.greatest(w0, h0) > most, h0 > w0
    w = F.when(over, F.when(tall, scale(F.lit(most), w0, h0)).otherwise(F.lit(most))).otherwise(w0)
    h = F.when(over, F.when(tall, F.lit(most)).otherwise(scale(F.lit(most), h0, w0))).otherwise(h0)
    (x, cw), (y, ch) = crop_axis(F.greatest(w, F.lit(1)), crop), crop_axis(F.greatest(h, F.lit(1)), crop)
    return F.struct(x.alias("x"), y.alias("y"), cw.alias("w"), ch.alias("h"))


def blended(channel: Column, alpha: Column, background: int = 255) -> Column:
    """A colour channel (0 to 255) over an opaque background, whole numbers rounded down."""
    return F.floor((channel * alpha + F.lit(background) * (255 - alpha)) / 255).cast("int")


def source_state(expected_ns: Column, expected_size: Column, found: Column, ns: Column, size: Column) -> Column:
    """current, changed, missing or unavailable. found: ok, absent, or anything else for a file that could not be looked at."""
    same = ns.eqNullSafe(expected_ns) & size.eqNullSafe(expected_size)
    return F.when(found == "absent", "missing").when(found != "ok", "unavailable").when(same, "current").otherwise("changed")


def required_bucket(size: Column) -> Column:
    """The smallest bucket of at least the size (1 to 1024); null otherwise."""
    got = F.lit(None).cast("int")
    for b in reversed(BUCKETS):
        got = F.when(size <= b, F.lit(b)).otherwise(got)
    return F.when((size >= 1) & (size <= BUCKETS[-1]), got)


def pick_thumbnail(thumbnails: DataFrame, wanted: int) -> DataFrame:
    """One row per asset: the smallest bucket of at least ``wanted``, else the largest. Partial aggregates."""
    order = F.struct((F.col("size_bucket") < wanted).alias("small"), F.when(F.col("size_bucket") >= wanted, F.col("size_bucket")).otherwise(-F.col("size_bucket")).alias("by"))
    columns = [c for c in thumbnails.columns if c != "asset_id"]
    best = F.min(F.struct(order.alias("o"), *columns))
    return thumbnails.groupBy("asset_id").agg(best.alias("b")).select("asset_id", *[F.col(f"b.{c}").alias(c) for c in columns])


def aspect_batches(lines: DataFrame, size: int = 8) -> DataFrame:
    """batch number of each text line within its page, in order of the aspect ratio."""
    order = Window.partitionBy("page").orderBy("aspect", "line")
    return lines.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def floor_seconds(ns: Column) -> Column:
    """Whole seconds below, for negative times too."""
    return F.floor((ns - F.pmod(ns, F.lit(1_000_000_000))) / 1_000_000_000).cast("long")


def rolling_rate(events: DataFrame, key: str, at: str, work: str, seconds: int = 5) -> DataFrame:
    """rate: work in the last seconds (this instant included) per second, per key, by a range frame over whole microseconds."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("rate", F.sum(work).over(w) / seconds)


def throughput(samples: DataFrame, key: str, at: str, done: str, seconds: int = 5) -> DataFrame:
    """samples (done: the total so far) with rate: work per second over the last seconds, or since the first sample if that
    is later. The total at the window's edge is interpolated between the samples on its two sides."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    edge, by = seconds * 1_000_000, Window.partitionBy(key).orderBy("_us")
    rows = samples.withColumn("_us", us)
    pair = F.struct("_us", F.col(done).cast("double").alias("d"))
    rows = rows.withColumns({
        "_before": F.last(pair).over(by.rangeBetween(Window.unboundedPreceding, -edge)),
        "_after": F.first(pair).over(by.rangeBetween(-edge + 1, 0)),
        "_first": F.first(pair).over(by.rangeBetween(Window.unboundedPreceding, 0)),
    })
    start = F.when(F.col("_before").isNull(), F.col("_first._us")).otherwise(F.col("_us") - edge)
    share = (F.col("_us") - edge - F.col("_before._us")) / (F.col("_after._us") - F.col("_before._us"))
    base = F.when(F.col("_before").isNull(), F.col("_first.d")).otherwise(F.col("_before.d") + (F.col("_after.d") - F.col("_before.d")) * share)
    spent = (F.col("_us") - start) / 1e6
    return rows.withColumn("rate", F.when(spent > 0, (F.col(done) - base) / spent)).drop("_us", "_before", "_after", "_first")
