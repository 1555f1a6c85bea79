"""Abusive, hateful or sexual content: a weighted lexicon matched by Aho-Corasick.

A text is folded first: invisible characters go, look-alike letters of other scripts and digits inside words
become Latin letters, spaced or dotted single letters are joined, accents and case go, repeated letters are
squeezed. Words with one or two masked letters (s*x, id**t) are in the automaton as variants of the words.
Each sentence is scored: the weights of its different terms are summed per category, as far as each role may give
(``MOST``), less the terms that exception phrases cancel within ``REACH`` words, and times a length factor that is 1 up to
``NORMAL_WORDS`` words and falls with the length beyond. A longer sentence has at least the score of each
``NORMAL_WORDS`` words of it that begin with a term. A document has a category if a sentence reaches 1.

Only narrow plans: one pass over the documents in Arrow batches, the lexicon travels with the code (a fixed
size), and the rates per source aggregate map-side first.

Defined cases: null and empty texts have score 0 and no category; repeated rows count once; whole texts of any
length are read; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.llm import abuse_lexicon as lexicon

NORMAL_WORDS = 40
#: Words on either side within which an exception holds.
REACH = 8
#: What a role gives at most.
MOST = {"noun": 1.3, "adjective": 0.5, "threat": 2.0, "violence": 0.4, "body": 0.4, "intent": 0.2, "you": 0.2, "vermin": 0.7, "group": 0.4, "kin": 0.5, "filthy": 0.3, "expel": 1.6, "sexual": 3.0, "nudity": 1.5}
ROLES = (
    ("noun", lexicon.NOUN), ("adjective", lexicon.ADJECTIVE), ("threat", lexicon.THREAT), ("violence", lexicon.VIOLENCE), ("body", lexicon.BODY), ("intent", lexicon.INTENT), ("you", lexicon.YOU),
    ("vermin", lexicon.VERMIN), ("group", lexicon.GROUP), ("kin", lexicon.KIN), ("filthy", lexicon.FILTHY), ("expel", lexicon.EXPEL), ("sexual", lexicon.SEXUAL_TERMS), ("nudity", lexicon.NUDITY),
)
#: Roles whose words are masked now and then.
COARSE = ("noun", "adjective", "threat", "vermin", "sexual", "nudity", "violence", "body", "filthy", "expel")
CATEGORIES = (lexicon.ABUSIVE, lexicon.HATEFUL, lexicon.SEXUAL)

#: Look-alikes of Latin letters (fixed values).
LOOKALIKES = str.maketrans("аеорсухіјѕԁһԛԝпгтвмкнАВЕКМНОРСТУХІЈЅαεορυικντχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwnrtbmkhABEKMHOPCTYXIJSaeopuikvtxABEZHIKMNOPTYX")
DIGITS = str.maketrans("0134578", "oieastb")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯︀-️﻿]")
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:([ .\-_·•])[^\W_](?:\1[^\W_])+)(?![^\W_])")
LEET = re.compile(r"[^\W_]*(?:[^\W\d_]\d|\d[^\W\d_])[^\W_]*")
SQUEEZE = re.compile(r"(.)\1+")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|\n+|\r+")
GAP = re.compile(r"[^\w*@$!#%]+|_+")
MARKUP = re.compile(r"\*\*(?=\w[^*\n]*?\*\*(?:\W|$))|(?<=\w)\*\*(?=\W|$)|<[^>\n]{1,40}>")


def _plain(text: str) -> str:
    decomposed = unicodedata.normalize("NFD", text.lower())
    return unicodedata.normalize("NFC", "".join(c for c in decomposed if not unicodedata.combining(c)))


def squeeze(word: str) -> str:
    return SQUEEZE.sub(r"\1", word)


@cache
def _single_words() -> frozenset[str]:
    return frozenset(squeeze(_plain(w)) for role, table in ROLES if role in ("noun", "adjective", "vermin", "sexual", "nudity") for w, _ in lexicon.terms(table) if " " not in w)


def _joined(m: re.Match) -> str:
    """Spaced letters as words: one, or two where only that gives words of the lexicon (or an article and one)."""
    word = m.group().replace(m.group(1), "")
    low = word.lower()
    if squeeze(low) not in _single_words():
        for k in range(1, len(low) - 2):
            if squeeze(low[k:]) in _single_words() and (low[:k] in ("a", "an", "un", "du", "i") or squeeze(low[:k]) in _single_words()):
                return f"{word[:k]} {word[k:]}"
    return word


def fold_sentence(sentence: str) -> str:
    """Words joined by single blanks, folded."""
    out = []
    for word in GAP.split(SPACED.sub(_joined, sentence)):
        if word and LEET.fullmatch(word):
            word = word.translate(DIGITS)
        word = word.strip("!?#%")
        if word:
            out.append(SQUEEZE.sub(lambda m: m.group() if m.group(1) == "*" else m.group(1), word))
    return " ".join(out)


def prepare(text: str) -> str:
    """The steps before sentences are cut."""
    text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).translate(LOOKALIKES)
    text = SPACED.sub(_joined, text)
    return _plain(MARKUP.sub(" ", text))


def _masked(word: str) -> Iterator[str]:
    """The word with one inner letter, or two neighbouring ones, masked. The squeezed letters around stay."""
    for i in range(1, len(word)):
        for n in (1, 2):
            if i + n <= len(word):
                yield squeeze(word[:i]) + "*" * n + squeeze(word[i + n :])


class Hit(NamedTuple):
    first: int
    last: int
    role: str
    name: str
    weight: float


class Lexicon:
    """The automaton: terms bounded by blanks, each with its roles and weights."""

    def __init__(self):
        import ahocorasick

        self.found: dict[str, dict[tuple[str, str], float]] = {}
        for role, table in ROLES:
            for term, weight in lexicon.terms(table):
                self._term(term, role, weight)
        for term, _ in lexicon.terms(lexicon.VERMIN):
            for copula in lexicon.COPULA:
                self._term(f"{copula} {term}", "vermin", 0.7)
        for pieces in lexicon.GAPPED:
            for k, piece in enumerate(pieces):
                self._add(self._fold(piece), ("gap", f"{k}|{'|'.join(pieces)}"), 0.0)
        for phrase, roles in lexicon.EXCEPTIONS.items():
            self._add(self._fold(phrase), ("exception", roles), 0.0)
        for phrase in lexicon.MENTIONS:
            self._add(self._fold(phrase), ("mention", ""), 0.0)
        for phrase in lexicon.REPORTS:
            self._add(self._fold(phrase), ("report", ""), 0.0)
        self.machine = ahocorasick.Automaton()
        for term, roles in self.found.items():
            self.machine.add_word(f" {term} ", (term.count(" ") + 1, len(term), tuple((r, n, w) for (r, n), w in sorted(roles.items()))))
        self.machine.make_automaton()

    @staticmethod
    def _fold(phrase: str) -> str:
        return " ".join(squeeze(w) for w in _plain(phrase).split())

    def _add(self, term: str, role: tuple[str, str], weight: float) -> None:
        roles = self.found.setdefault(term, {})
        roles[role] = max(roles.get(role, 0.0), weight)

    def _term(self, term: str, role: str, weight: float) -> None:
        folded = self._fold(term)
        self._add(folded, (role, folded), weight)
        if role not in COARSE:
            return
        split = _plain(term).split()
        for k, w in enumerate(split):
            if len(w) > 2 and (len(split) == 1 or len(w) > 3 or role == "sexual"):
                for m in _masked(w):
                    self._add(" ".join([*(squeeze(x) for x in split[:k]), m, *(squeeze(x) for x in split[k + 1 :])]), (role, folded), weight)

    def hits(self, folded: str) -> list[Hit]:
        """The terms that count, after exceptions, in order of their place. Words are numbered from 0."""
        found: list[Hit] = []
        for end, (words, length, roles) in self.machine.iter(f" {folded} "):
            first = folded.count(" ", 0, max(0, end - length - 1))
            found += [Hit(first, first + words - 1, r, n, w) for r, n, w in roles]
        if not any(h.weight or h.role == "gap" for h in found):
            return []
        cancels = [(h.first - REACH, h.last + REACH, h.name.split()) for h in found if h.role == "exception"]
        cancels += [(h.first, h.last + REACH, None) for h in found if h.role == "mention"]
        cancels += [(h.first - REACH, h.last + REACH, None) for h in found if h.role == "report"]
        out = []
        for h in found:
            if h.role in ("exception", "mention", "report") or any(a <= h.first and h.last <= b and (roles is None or h.role in roles) for a, b, roles in cancels):
                continue
            # a term within a longer one of its kind is part of it
            if h.weight and any(o.role == h.role and o.first <= h.first and h.last <= o.last and o.last - o.first > h.last - h.first for o in found):
                continue
            out.append(h)
        return sorted(out)

    @staticmethod
    def score(hits: list[Hit]) -> dict[str, float]:
        """Sums by category of hits that stand near each other."""
        by_role: dict[str, dict[str, float]] = {}
        for h in hits:
            if h.weight:
                by_role.setdefault(h.role, {})[h.name] = h.weight
        role = {r: min(MOST[r], sum(names.values())) for r, names in by_role.items()}
        if not role and not any(h.role == "gap" for h in hits):
            return {}
        get = lambda *names: sum(role.get(n, 0.0) for n in names)
        hateful = get("vermin", "group", "expel")
        if hateful or any(h.role == "gap" for h in hits):
            hateful += get("kin", "filthy")
        gaps: dict[str, int] = {}
        for h in hits:
            if h.role == "gap":
                k, _, name = h.name.partition("|")
                if k == "0":
                    gaps.setdefault(name, h.last)
                elif name in gaps and h.first > gaps[name]:
                    hateful += lexicon.GAPPED[tuple(name.split("|"))]
                    gaps[name] = 1 << 30
        if any(a.role == "violence" and b.role == "group" and 0 < b.first - a.last <= 2 for a in hits for b in hits):
            hateful += 0.8  # "kill all ..."
        abusive = 0.0
        if get("noun", "threat", "violence"):
            abusive = get("noun", "adjective", "threat", "you")
            if "violence" in role or "body" in role:
                abusive += get("violence", "body", "intent") if get("you", "body") else 0.0
        if hateful >= 1 and get("threat") < 1 and "body" not in role:
            abusive = 0.0  # insults there are the attack's own words
        scores = {lexicon.ABUSIVE: abusive, lexicon.HATEFUL: hateful, lexicon.SEXUAL: get("sexual", "nudity")}
        return {k: v + 1e-9 for k, v in scores.items() if v}

    def sentence(self, folded: str) -> dict[str, float]:
        """Score by category of a folded sentence."""
        hits = self.hits(folded)
        if not hits:
            return {}
        n = folded.count(" ") + 1
        factor = min(1.0, (NORMAL_WORDS / n) ** 0.5)
        scores = {k: v * factor for k, v in self.score(hits).items()}
        if factor < 1:
            for i, h in enumerate(hits):
                for category, v in self.score([x for x in hits[i : i + NORMAL_WORDS * 4] if x.last < h.first + NORMAL_WORDS]).items():
                    scores[category] = max(scores.get(category, 0.0), v)
        return scores

    def document(self, text: str | None) -> dict[str, float]:
        """The largest sentence score by category."""
        best: dict[str, float] = {}
        if text:
            for s in SENTENCE.split(prepare(text)):
                for k, v in self.sentence(fold_sentence(s)).items():
                    best[k] = max(best.get(k, 0.0), v)
        return best


SCORES = "doc_id long, abusive double, hateful double, sexual double"


def score_documents(documents: DataFrame) -> DataFrame:
    """doc_id and the score of each category, for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon()
        for batch in batches:
            scores = [lex.document(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([s.get(c, 0.0) for s in scores], pa.float64()) for c in CATEGORIES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *CATEGORIES])

    return documents.select("doc_id", "text").mapInArrow(run, SCORES)


def toxic_documents(documents: DataFrame, threshold: float = 1.0) -> DataFrame:
    """doc_id, category of every document that reaches the threshold."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])
    scored = score_documents(documents).select("doc_id", F.explode(pairs).alias("p"))
    return scored.where(F.col("p.score") >= threshold).select("doc_id", F.col("p.category").alias("category")).distinct()


def rates_by_source(documents: DataFrame, threshold: float = 1.0) -> DataFrame:
    """source, documents, and the share of each category; a null source is a source of its own."""
    scored = score_documents(documents).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in CATEGORIES])
    both = documents.select("doc_id", "source").distinct().join(scored, "doc_id")
    rates = [F.avg((F.col(c) >= threshold).cast("double")).alias(f"{c}_rate") for c in CATEGORIES]
    return both.groupBy("source").agg(F.count("*").alias("documents"), *rates)
