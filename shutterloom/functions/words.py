"""Word functions as Columns: tokens, folding, stems."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}\p{Co}]+)"


def _accent_table() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks with one accent or more, and their bases."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(text: Column) -> Column:
    """Composed accents by translation, combining marks dropped; all inside the JVM."""
    source, target = _accent_table()
    return F.regexp_replace(F.translate(text, source, target), r"\p{Mn}", "")


def tokens(text: Column) -> Column:
    """Words in small letters without accents."""
    return F.regexp_extract_all(F.lower(strip_accents(text)), F.lit(TOKEN), 1)


#: Suffix, least length of the word, replacement; the first that fits is taken (fixed values).
SUFFIXES = (("ies", 5, "y"), ("ches", 6, "ch"), ("shes", 6, "sh"), ("ing", 6, ""), ("edly", 7, ""), ("ed", 5, ""), ("ly", 5, ""), ("es", 5, ""), ("s", 4, ""))


def stem(word: Column) -> Column:
    """Crude suffix stripping, never of a final ss; then a doubled consonant other than s is halved."""
    cut = word
    for suffix, least, replacement in reversed(SUFFIXES):
        fits = (F.length(word) >= least) & word.endswith(suffix) & ~word.endswith("ss")
        cut = F.when(fits, F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(replacement))).otherwise(cut)
    return F.regexp_replace(cut, r"([\p{L}&&[^aeious]])\1$", "$1")


def stem_text(word: str) -> str:
    """stem() of a string."""
    import re

    for suffix, least, replacement in SUFFIXES:
        if len(word) >= least and word.endswith(suffix) and not word.endswith("ss"):
            word = word[: len(word) - len(suffix)] + replacement
            break
    return re.sub(r"([^\W\d_aeious])\1$", r"\1", word)


def within_one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion or substitution at most."""
    return F.levenshtein(a, b) <= 1


#: In hexadecimal, a UTF-8 text that ends within a character.
BROKEN_END = r"^((?:[0-9A-F]{2})*?)(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$"


def truncate_utf8(text: Column, most: int) -> Column:
    """The longest start of at most so many bytes that ends with a whole character."""
    start = F.hex(F.substring(text.cast("binary"), 1, most))
    whole = F.decode(F.unhex(F.regexp_replace(start, BROKEN_END, "$1")), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(whole)


def join_lines(lines: Column) -> Column:
    """The lines that have text, one below the other."""
    return F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), "\n")
