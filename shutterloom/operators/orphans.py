"""References to records that do not exist, by compressed bitmaps over dictionary codes.

Keys are spread over ranges by their hash, so many ranges that each hold about ``RANGE`` keys, however sparse, long or
clustered the keys are. In a range the keys of both sides are dictionary-encoded as consecutive integers; a compressed
bitmap of codes per referring table and period is taken AND NOT the parents' bitmaps, and the surviving bits are decoded.

Every group is bounded: both sides are reduced to one row per table and key by map-side combining
aggregates first, so a hot key cannot make a large group.

Defined cases: null keys refer to nothing and are left out; null write times don't take part in the
earliest one, and a key with none has a null period and is never ``late``; empty tables give no rows;
repeated rows count once; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterloom.functions.bitmaps import Bitmap

#: Keys in a range, about.
RANGE = 8192
NO_TIME = np.iinfo(np.int64).min


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def parents(assets: DataFrame, pruned: DataFrame) -> DataFrame:
    """asset_id, first_seen, last_seen, pruned_at (microseconds, null where there is none), in_catalog: one row per known key."""
    seen = assets.select(
        F.col("asset_id").cast("long").alias("asset_id"), _micros(F.col("seen_at")).alias("seen"), F.lit(None).cast("long").alias("gone"), F.lit(1).alias("listed")
    )
    gone = pruned.select(
        F.col("asset_id").cast("long").alias("asset_id"), F.lit(None).cast("long").alias("seen"), _micros(F.col("pruned_at")).alias("gone"), F.lit(0).alias("listed")
    )
    return (
        seen.unionByName(gone)
        .where(F.col("asset_id").isNotNull())
        .groupBy("asset_id")
        .agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.max("gone").alias("pruned_at"), F.max("listed").alias("in_catalog"))
    )


def is_deleted() -> Column:
    """Over the columns of parents(): the latest deletion is later than every sighting, or there is no sighting."""
    return F.col("pruned_at").isNotNull() & ((F.col("in_catalog") == 0) | F.col("last_seen").isNull() | (F.col("pruned_at") > F.col("last_seen")))


def references(tables: Mapping[str, DataFrame], key: str = "asset_id", written: str = "written_at") -> DataFrame:
    """src_table, asset_id, first_written (microseconds), month (months since 1970): one row per table and key."""
    parts = [t.select(F.lit(name).alias("src_table"), F.col(key).cast("long").alias("asset_id"), F.col(written).cast("timestamp").alias("w")) for name, t in tables.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return (
        union.where(F.col("asset_id").isNotNull())
        .groupBy("src_table", "asset_id")
        .agg(F.min("w").alias("w"))
        .select("src_table", "asset_id", F.unix_micros("w").alias("first_written"), ((F.year("w") - 1970) * 12 + F.month("w") - 1).alias("month"))
    )


def _range_orphans(key: tuple, refs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    names = np.union1d(refs["asset_id"].to_numpy(np.int64), known["asset_id"].to_numpy(np.int64))  # the dictionary: code -> key
    width = len(names)
    at = np.searchsorted(names, known["asset_id"].to_numpy(np.int64))
    parent = Bitmap.of(at, width)
    alive = Bitmap.of(at[~known["deleted"].to_numpy(bool)], width)
    first_seen = np.full(width, NO_TIME, np.int64)
    first_seen[at] = known["first_seen"].fillna(NO_TIME).to_numpy(np.int64)
    first_month = known["seen_month"].fillna(-(1 << 20)).to_numpy(np.int64)
    out = []
    for (table, month), part in refs.groupby(["src_table", "month"], dropna=False, sort=False):
        codes = np.searchsorted(names, part["asset_id"].to_numpy(np.int64))
        wrote = np.full(width, NO_TIME, np.int64)
        wrote[codes] = part["first_written"].fillna(NO_TIME).to_numpy(np.int64)
        referred = Bitmap.of(codes, width)
        missing = referred.and_not(parent)
        deleted = referred.and_not(alive).and_not(missing)
        found = [("missing", missing), ("deleted", deleted)]
        if not pd.isna(month):
            in_time = Bitmap.of(at[first_month < month], width)
            rest = referred.and_not(in_time).and_not(missing).and_not(deleted).offsets()
            late = rest[(first_seen[rest] > wrote[rest]) & (first_seen[rest] != NO_TIME)]
            found.append(("late", Bitmap.of(late, width)))
        for reason, bitmap in found:
            if len(bitmap):
                out.append(pd.DataFrame({"src_table": table, "asset_id": names[bitmap.offsets()], "reason": reason, "month": None if pd.isna(month) else month}))
    columns = ["src_table", "asset_id", "reason", "month"]
    return pd.concat(out)[columns].astype({"src_table": object, "reason": object, "month": "Int64"}) if out else pd.DataFrame({c: [] for c in columns}).astype({"src_table": object, "reason": object, "asset_id": "int64", "month": "Int64"})


def find_orphans(refs: DataFrame, known: DataFrame, keys: int | None = None) -> DataFrame:
    """src_table, asset_id, reason, period of every reference without a parent to refer to.

    refs as from references(), known as from parents(); keys is about how many keys there are, counted if not given. The
    first reason that holds is given: ``missing``, ``deleted``, ``late``. period is YYYY-MM of the earliest write."""
    if keys is None:
        keys = refs.select("asset_id").unionByName(known.select("asset_id")).agg(F.approx_count_distinct("asset_id")).first()[0]
    in_range = F.pmod(F.xxhash64("asset_id"), F.lit(max(1, -(-keys // RANGE)))).alias("key_range")
    seen_at = F.timestamp_micros("first_seen")
    left = refs.select(in_range, "src_table", "asset_id", "first_written", "month")
    right = known.select(in_range, "asset_id", "first_seen", ((F.year(seen_at) - 1970) * 12 + F.month(seen_at) - 1).alias("seen_month"), is_deleted().alias("deleted"))
    found = left.groupBy("key_range").cogroup(right.groupBy("key_range")).applyInPandas(_range_orphans, "src_table string, asset_id long, reason string, month long")
    month = F.add_months(F.lit("1970-01-01").cast("date"), F.col("month").cast("int"))
    return found.select("src_table", "asset_id", "reason", F.date_format(month, "yyyy-MM").alias("period"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per table, period and reason."""
    return found.groupBy("src_table", "period", "reason").agg(F.count("*").alias("orphans"), F.min("asset_id").alias("first_id"), F.max("asset_id").alias("last_id"))
