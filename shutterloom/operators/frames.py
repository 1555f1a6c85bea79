"""Order-dependent operators over small groups: distinct frames, reading order, text boxes, line decoding."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.functions.vectors import dot
from shutterloom.session import cut, written

SAME_FRAME = 0.95
#: Frames of a large asset that are compared with as many kept ones in one task.
TILE = 8192
#: Samples of small assets in a task, about.
TASK = 32_768
ROW_TOLERANCE = 10.0


def _directions(embeddings: pd.Series) -> np.ndarray:
    """Rows of length 1 in float64; zeros stay."""
    v = np.stack(embeddings.to_numpy()).astype(np.float64)
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def greedy(v: np.ndarray, threshold: float, step: int = 256) -> np.ndarray:
    """Positions of the rows (of length 1) that are below the threshold to every row kept before."""
    kept: list[int] = []
    for i in range(0, len(v), step):
        part = v[i : i + step]
        fresh = np.arange(len(part)) if not kept else np.flatnonzero((part @ v[kept].T < threshold).all(1))
        like = part[fresh] @ part[fresh].T >= threshold
        mine: list[int] = []
        for k in range(len(fresh)):
            if not like[k, mine].any():
                mine.append(k)
        kept += (fresh[mine] + i).tolist()
    return np.array(kept, np.int64)


def _kept_in(threshold: float):
    """For a table of whole assets: the kept samples of each. Assets come together in a task, so small ones cost no call each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lowest = np.iinfo(np.int64).min
        asset, at, name = (pc.fill_null(table.column(c), lowest).to_numpy() for c in ("asset_id", "timestamp_ms", "embedding_id"))
        order = np.lexsort((name, at, asset))
        table, asset = table.take(pa.array(order)).combine_chunks(), asset[order]
        starts = np.flatnonzero(np.r_[True, asset[1:] != asset[:-1]]) if len(asset) else np.zeros(0, np.int64)
        lists = table.column("embedding").chunk(0) if table.num_rows else None
        keep = []
        for i, j in zip(starts, np.r_[starts[1:], len(asset)]):
            if j - i == 1:
                keep.append(np.array([i]))
                continue
            v = lists.slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1).astype(np.float64)
            length = np.linalg.norm(v, axis=1, keepdims=True)
            keep.append(greedy(np.divide(v, length, out=np.zeros_like(v), where=length > 0), threshold) + i)
        return table.select(["asset_id", "embedding_id", "timestamp_ms"]).take(pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64)))

    return run


def distinct_frames(samples: DataFrame, threshold: float = SAME_FRAME, most: int = 100_000) -> DataFrame:
    """The samples of each asset that are, in time order, below the threshold to every one kept before.

    Assets are taken together, about ``TASK`` samples in a task. An asset with more than ``most`` is taken in blocks of
    ``most`` in time order: what is like a frame kept in an earlier block goes, in tiles, and the rest is a group; what it
    keeps is written."""

    def kept_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["timestamp_ms", "embedding_id"], na_position="first")
        return pdf.iloc[greedy(_directions(pdf["embedding"]), threshold)]

    def together(rows: DataFrame) -> DataFrame:
        tasks = max(1, -(-(total or 0) // TASK))
        wanted = rows.select(*[F.col(c).cast("long").alias(c) for c in ("asset_id", "embedding_id", "timestamp_ms")], "embedding", F.pmod(F.xxhash64("asset_id"), F.lit(tasks)).alias("task"))
        return wanted.groupBy("task").applyInArrow(_kept_in(threshold), out)

    out = "asset_id long, embedding_id long, timestamp_ms long"
    counts = samples.groupBy(F.col("asset_id").alias("large")).agg(F.count("*").alias("size"))
    total, largest = counts.agg(F.sum("size"), F.max("size")).first()
    if (largest or 0) <= most:
        return together(samples)
    sizes = cut(counts.where(F.col("size") > most))
    same = F.col("asset_id").eqNullSafe(F.col("large"))
    result = together(samples.join(sizes, same, "left_anti"))
    place = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.asc_nulls_first("timestamp_ms"), F.asc_nulls_first("embedding_id"))) - 1
    ranked = samples.join(sizes, same, "left_semi").select("asset_id", "embedding_id", "timestamp_ms", "embedding", place.alias("place"))
    ranked = written(ranked.withColumns({"block": F.floor(F.col("place") / most).cast("int"), "tile": F.floor(F.col("place") / TILE).cast("int")}))
    columns = ["asset_id", "embedding_id", "timestamp_ms", "embedding", "place", "tile"]
    kinds = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in columns)

    def like_kept(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        if new.empty or old.empty:
            return pd.DataFrame({"asset_id": [], "place": []})
        w, parts = _directions(old["embedding"]), np.array_split(np.arange(len(new)), -(-len(new) // 1024))
        v = _directions(new["embedding"])
        like = np.concatenate([(v[p] @ w.T >= threshold).any(1) for p in parts])
        return new.loc[like, ["asset_id", "place"]]

    kept: DataFrame | None = None
    for block in range(-(-largest // most)):
        new = ranked.where(F.col("block") == block).select(*columns)
        if kept is not None:
            tiles = kept.select("asset_id", F.col("tile").alias("other")).distinct()
            left = new.alias("n").join(tiles.alias("t"), F.expr("n.asset_id <=> t.asset_id"))
            left = left.select(F.col("n.asset_id").alias("asset_id"), "n.place", "n.embedding", F.col("n.tile").alias("tile"), "t.other")
            right = new.select("asset_id", F.col("tile").alias("own")).distinct().alias("n").join(kept.alias("k"), F.expr("n.asset_id <=> k.asset_id"))
            right = right.select(F.col("k.asset_id").alias("asset_id"), "k.embedding", F.col("n.own").alias("tile"), F.col("k.tile").alias("other"))
            by = ["asset_id", "tile", "other"]
            gone = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(like_kept, "asset_id long, place long").distinct()
            new = new.alias("n").join(gone.alias("g"), F.expr("n.asset_id <=> g.asset_id AND n.place = g.place"), "left_anti")
        now = written(new.groupBy("asset_id").applyInPandas(lambda pdf: kept_of(pdf)[columns], kinds))
        kept = now if kept is None else kept.unionByName(now)
    return result.unionByName(kept.select("asset_id", "embedding_id", "timestamp_ms"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes (page, box, x, y) with place: rows are begun by the topmost box left and take those less than 10 below; left to right."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x", "box"])
        row, top, rows = -1, None, []
        for y in pdf["y"]:
            if top is None or abs(y - top) >= ROW_TOLERANCE:
                row, top = row + 1, y
            rows.append(row)
        pdf = pdf.assign(_row=rows).sort_values(["_row", "x", "y", "box"])
        return pdf.assign(place=np.arange(len(pdf)))[["page", "box", "x", "y", "place"]]

    return boxes.groupBy("page").applyInPandas(run, "page long, box long, x double, y double, place int")


def oriented_box(x: np.ndarray, y: np.ndarray, unclip: float, least: float = 3.0) -> np.ndarray | None:
    """Corners (4 by 2) of the rectangle along the principal axis of the pixels, grown by area * unclip / perimeter; None if thin."""
    cx, cy = x.mean(), y.mean()
    dx, dy = x - cx, y - cy
    angle = 0.5 * np.arctan2(2 * (dx * dy).sum(), (dx * dx).sum() - (dy * dy).sum())
    axis = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
    p, q = axis @ np.stack([dx, dy])
    w, h = np.ptp(p) + 1, np.ptp(q) + 1
    if min(w, h) < least:
        return None
    grow = w * h * unclip / (2 * (w + h))
    corners = np.array([[p.min() - grow, q.min() - grow], [p.max() + grow, q.min() - grow], [p.max() + grow, q.max() + grow], [p.min() - grow, q.max() + grow]])
    return corners @ axis + [cx, cy]


def component_boxes(pixels: DataFrame, unclip: float = 1.5) -> DataFrame:
    """One oriented box per (page, component) of pixels (x, y, score), with the mean score."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        box = oriented_box(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), unclip)
        if box is None:
            return pd.DataFrame({"page": [], "component": [], "corners": [], "score": []})
        return pd.DataFrame({"page": [pdf["page"].iloc[0]], "component": [pdf["component"].iloc[0]], "corners": [box.ravel().tolist()], "score": [pdf["score"].mean()]})

    return pixels.groupBy("page", "component").applyInPandas(run, "page long, component long, corners array<double>, score double")


def ctc(steps: DataFrame, characters: list[str], space: int | None = None) -> DataFrame:
    """text and score per line of steps (line, step, scores array): best class of each step (the last of equals), without
    blanks (class 0) and repeats; score is the mean over the symbols."""
    best = F.array_max(F.transform("scores", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    rows = steps.select("line", "step", best.alias("b")).select("line", "step", F.col("b.v").cast("double").alias("v"), F.col("b.i").alias("c"))
    order = Window.partitionBy("line").orderBy("step")
    kept = (F.col("c") != 0) & ~F.col("c").eqNullSafe(F.lag("c").over(order))
    marked = rows.withColumn("kept", kept)
    letters = F.array(*[F.lit(c) for c in characters])
    symbol = F.get(letters, F.col("c") - 1)
    if space is not None:
        symbol = F.when(F.col("c") == space, F.lit(" ")).otherwise(symbol)
    parts = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("step", symbol.alias("s")))))
    return marked.groupBy("line").agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("text"), F.coalesce(F.avg(F.when(F.col("kept"), F.col("v"))), F.lit(0.0)).alias("score"))


def patch_grid(tokens: Column, prefix: int) -> Column:
    """Unit patch vectors after the prefix tokens; an error unless they make a square."""
    body = F.slice(tokens, prefix + 1, F.greatest(F.size(tokens) - prefix, F.lit(0)))
    side = F.floor(F.sqrt(F.size(body)) + 0.5)
    unit = F.transform(body, lambda v: F.transform(v, lambda x: (x / F.greatest(F.sqrt(dot(v, v)), F.lit(1.1920929e-07))).cast("float")))
    return F.when(side * side == F.size(body), unit).otherwise(F.raise_error(F.lit("the patches are not a square")).cast("array<array<float>>"))


def patch_scores(patches: Column, query: Column) -> Column:
    """One dot product per patch."""
    return F.transform(patches, lambda v: dot(v, query))
