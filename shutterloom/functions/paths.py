"""Path functions as Columns: names, extensions, globs, natural order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """Forward slashes, small letters."""
    return F.lower(F.translate(path, "\\", "/"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """What precedes the last slash; empty without one."""
    return F.when(F.instr(path, "/") > 0, F.left(path, F.length(path) - F.length(file_name(path)) - 1)).otherwise("")


def extension(path: Column) -> Column:
    """After the last dot of the name, in small letters; empty where the dot leads the name or is missing."""
    return F.lower(F.regexp_extract(file_name(normal_path(path)), r"^.+\.([^.]*)$", 1))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: * any run (separators too), ? one character."""
    parts = re.split(r"([*?])", pattern)
    return "^(?s:" + "".join({"*": ".*", "?": "."}.get(p) or re.escape(p) for p in parts if p) + ")$"


def longest_literal(pattern: str) -> str:
    """The longest run between wildcards, the last of several: what a match must contain."""
    best = ""
    for run in re.split(r"[*?]", pattern):
        best = run if len(run) >= len(best) else best
    return best


def path_matches(path: Column, pattern: str) -> Column:
    """Without a wildcard the pattern is part of the path; else it matches the whole name, or path if it has a slash.

    The longest literal goes first as a cheap containment test."""
    pattern = pattern.replace("\\", "/").lower()
    whole = normal_path(path)
    if not re.search(r"[*?]", pattern):
        return whole.contains(pattern)
    target = whole if "/" in pattern else file_name(whole)
    literal = longest_literal(pattern)
    match = target.rlike(glob_regex(pattern))
    return target.contains(literal) & match if literal else match


def natural_key(text: Column) -> Column:
    """A string whose order compares runs of digits as numbers and everything else as it is."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)

    def key(run: Column) -> Column:
        bare = F.ltrim(run, F.lit("0"))
        return F.when(run.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 10, "0"), bare)).otherwise(run)

    return F.array_join(F.transform(runs, key), "")


def canonical_windows(path: Column) -> Column:
    r"""Without the verbatim prefixes \\?\ and \\?\UNC\."""
    return F.regexp_replace(F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\"), r"^\\\\\?\\", "")
