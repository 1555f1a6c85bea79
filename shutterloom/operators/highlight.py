"""Which parts of a text a query was about, in code points; and markers of an index turned into spans."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterloom.functions.words import stem_text

SPANS = "array<struct<start:int,end:int,kind:string>>"
#: Query words that highlight nothing (fixed values).
STOPWORDS = frozenset(
    "a an and are as at be but by for from how in into is it its of on or that the this to was were what when which with".split()
)
KINDS = ("fuzzy", "prefix", "stem", "exact", "indexed")
WORD = re.compile(r"[^\W_]+")


def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    rest = a[start + 1 :]
    return rest == (b[start + 1 :] if len(a) == len(b) else b[start:])


class Highlighter:
    """The terms of one query and the evidence they give for words, remembered per word."""

    def __init__(self, query: str):
        self.terms = sorted({w.lower() for w in WORD.findall(query)} - STOPWORDS)
        self.stems = [stem_text(t) for t in self.terms]
        self.known: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """Index into KINDS, -1 for none: the strongest evidence of any term."""
        got = self.known.get(word)
        if got is None:
            own = stem_text(word)
            got = -1
            for term, stem in zip(self.terms, self.stems):
                if word == term:
                    got = max(got, 3)
                elif own == stem:
                    got = max(got, 2)
                elif len(term) >= 3 and word.startswith(term):
                    got = max(got, 1)
                elif got < 0 and len(word) >= 5 and len(term) >= 5 and one_edit(word, term):
                    got = 0
            self.known[word] = got
        return got

    def spans(self, text: str | None) -> list[dict]:
        """Ordered spans; matching words next to each other are one, with the stronger kind."""
        out: list[list[int]] = []
        last = -2
        for i, m in enumerate(WORD.finditer(text or "")) if self.terms else ():
            kind = self.kind(m.group().lower())
            if kind < 0:
                continue
            if last == i - 1:
                out[-1] = [out[-1][0], m.end(), max(out[-1][2], kind)]
            else:
                out.append([m.start(), m.end(), kind])
            last = i
        return [{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in out]


def highlights(text: Column, query: str) -> Column:
    """The spans of each text, by an Arrow batch function."""

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        h = Highlighter(query)
        return texts.map(h.spans)

    return run(text)


def parse_marked(snippet: str, opening: str = "[", closing: str = "]") -> tuple[str, list[dict]]:
    """The text without its paired markers, and their spans; unpaired markers are text, empty spans are dropped."""
    out, spans, start = [], [], None
    for i, c in enumerate(snippet):
        if c == opening and start is None and closing in snippet[i + 1 :]:
            start = len(out)
        elif c == closing and start is not None:
            if len(out) > start:
                spans.append({"start": start, "end": len(out), "kind": "indexed"})
            start = None
        else:
            out.append(c)
    return "".join(out), spans


def snippet(text: str, words: set[str], tokens: int = 64, marks: tuple[str, str] = ("[", "]")) -> str:
    """A window of so many words that holds most of the wanted ones, marked, with .. where text is left out."""
    at = list(WORD.finditer(text))
    hit = [m.group().lower() in words for m in at]
    best, best_count, count = 0, -1, 0
    for i, h in enumerate(hit):
        count += h - (hit[i - tokens] if i >= tokens else 0)
        if count > best_count:
            best, best_count = max(0, i - tokens + 1), count
    window = at[best : best + tokens]
    if not window:
        return text
    begin, end = (0 if best == 0 else window[0].start()), (len(text) if best + tokens >= len(at) else window[-1].end())
    out, here = [".." if begin else ""], begin
    for m in window:
        out.append(text[here : m.start()])
        out.append(f"{marks[0]}{m.group()}{marks[1]}" if m.group().lower() in words else m.group())
        here = m.end()
    return "".join(out) + text[here:end] + (".." if end < len(text) else "")


def snippets(rows: DataFrame, query: str, text: str = "content") -> DataFrame:
    """rows with snippet and its highlights."""
    wanted = {w.lower() for w in WORD.findall(query)}

    @F.pandas_udf("struct<text:string,spans:" + SPANS + ">")
    def run(texts: pd.Series) -> pd.DataFrame:
        parsed = [parse_marked(snippet(t or "", wanted)) for t in texts]
        return pd.DataFrame({"text": [p[0] for p in parsed], "spans": [p[1] for p in parsed]})

    return rows.withColumn("_s", run(F.col(text))).withColumns({"snippet": F.col("_s.text"), "highlights": F.col("_s.spans")}).drop("_s")
