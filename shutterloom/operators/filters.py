"""The filter that every search and listing shares: scope, file patterns, extensions, time."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterloom.functions.paths import extension, path_matches
from shutterloom.operators.scope import PathScope

MODIFIED, CAPTURE = "modified", "capture"
STILL_FORMATS = ("png", "jpeg", "gif", "webp")
MEDIA_EXTENSIONS = ("png", "jpeg", "jpg", "gif", "webp", "bmp", "mp4", "m4v", "mov", "mkv", "webm", "avi", "mpg", "mpeg", "m2ts")
#: Folders that a walk leaves out by default (fixed values).
DEFAULT_EXCLUSIONS = ("*/.cache", "*/.thumb*")


def timeline(kind: str) -> Column:
    """Capture time falls back to the modification time."""
    return F.coalesce(F.col("exif_taken_ns"), F.col("source_modified_ns")) if kind == CAPTURE else F.col("source_modified_ns")


@dataclass(frozen=True)
class TimeRange:
    """Half-open, in nanoseconds, on one timeline."""

    kind: str | None = None
    after: int | None = None
    before: int | None = None

    def __post_init__(self):
        if self.kind is None and (self.after is not None or self.before is not None):
            raise ValueError("a time bound needs a timeline")
        if self.after is not None and self.before is not None and self.after >= self.before:
            raise ValueError("a time range ends after it starts")

    def column(self) -> Column:
        at, got = timeline(self.kind or MODIFIED), F.lit(True)
        if self.after is not None:
            got = got & (at >= self.after)
        if self.before is not None:
            got = got & (at < self.before)
        return got


@dataclass(frozen=True)
class Filters:
    """All terms hold. Empty patterns and lists are no terms."""

    scope: PathScope | None = None
    patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = ()
    time: TimeRange = TimeRange()

    def column(self, path: Column) -> Column:
        terms = [self.time.column()]
        if self.scope is not None:
            terms.insert(0, self.scope.column(path))
        terms += [path_matches(path, p) for p in self.patterns if p.strip()]
        terms += [~path_matches(path, p) for p in self.exclude_patterns if p.strip()]
        if kept := clean_extensions(self.extensions):
            terms.append(extension(path).isin(kept))
        if dropped := clean_extensions(self.exclude_extensions):
            terms.append(~extension(path).isin(dropped))
        return reduce(lambda a, b: a & b, terms)


def clean_extensions(extensions: Iterable[str]) -> list[str]:
    return [e for e in (x.strip().lstrip(".").lower() for x in extensions) if e]


def is_media(path: Column) -> Column:
    return extension(path).isin(*MEDIA_EXTENSIONS)


def is_excluded(path: Column, literal: Iterable[str] = ()) -> Column:
    """In a folder that matches a default pattern, or in a given folder (the folder itself too)."""
    hidden = path.rlike(r"(^|/)(\.cache|\.thumb[^/]*)(/|$)")
    return reduce(lambda a, b: a | b, ((path == r) | path.startswith(r.rstrip("/") + "/") for r in literal), hidden)


def recognisable() -> Column:
    """Stills of the formats that text is read from."""
    return (F.col("media_kind") == "image") & F.col("media_format").isin(*STILL_FORMATS)


def embeddable(videos: bool = True) -> Column:
    still = (F.col("media_kind") == "image") & F.col("media_format").isin(*STILL_FORMATS, "bmp")
    return still | (F.col("media_kind") == "video") if videos else still


def within_dimensions(most: int | None) -> Column:
    """Unknown sizes pass."""
    return F.lit(True) if most is None else F.coalesce((F.col("width") <= most) & (F.col("height") <= most), F.lit(True))


def non_blank(text: Column) -> Column:
    return F.trim(text) != ""
