"""Instants as nanoseconds since 1970, in longs: EXIF and RFC 3339 texts, decimal strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXIF = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?\s*(Z|[+-]\d{2}:\d{2})?$"
RFC3339 = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|z|[+-]\d{2}:\d{2})$"


def _instant(text: Column, pattern: str, offset: Column | None = None) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, i)
    zone = F.upper(part(6))
    if offset is not None:
        zone = F.when(zone == "", F.coalesce(F.when(offset.rlike(r"^[+-]\d{2}:\d{2}$"), offset), F.lit(""))).otherwise(zone)
    zone = F.when(zone == "", F.lit("Z")).otherwise(zone)
    at = F.try_to_timestamp(F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4), zone))
    return F.when(text.rlike(pattern), F.unix_seconds(at) * 1_000_000_000 + F.rpad(part(5), 9, "0").cast("long"))


def exif_ns(text: Column, offset: Column | None = None) -> Column:
    """2023:05:01 10:20:30.5, in the zone it or the offset field names, else UTC; null for anything else."""
    return _instant(F.trim(text), EXIF, offset)


def rfc3339_ns(text: Column) -> Column:
    """2023-05-01T10:20:30.5+02:00; null for anything else."""
    return _instant(F.trim(text), RFC3339)


def decimal_ns(text: Column) -> Column:
    """A signed 64-bit decimal string; null for anything else."""
    return F.when(text.rlike(r"^-?\d{1,19}$"), text.try_cast("long"))
