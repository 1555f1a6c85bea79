"""Lines of scanned pages: page numbers, running headings, words cut at line ends, and words.

All of this is per content, from the content alone. What could be a page number is a line, or the end of a line set apart by
blanks, in one of the usual dresses (17, xvii, [17], - 17 -, p. 17, Page 17 of 20, 17 / 20); what could be a heading is a line of
words in capitals or with capitals. Which of them are is decided by two boosted classifiers over pairs of lines: a number and
the one it counts up from or to (or the edge of its page), and two headings at page tops. They are trained on pages
put together from lines of the corpus, with headings and numbers set into them, misread now and then.
"""

from __future__ import annotations

import math
import random
import re
from typing import NamedTuple

import numpy as np

from shutterloom.llm.boosting import Boosted

DIGIT = "0-9lOI"
NUMBER = rf"(?P<n>[{DIGIT}]{{1,9}}|[ivxlcdm]{{1,15}})"
DRESSES = (
    ("page", rf"[Pp]age {NUMBER}(?: (?:of|/) [{DIGIT}]{{1,9}})?"),
    ("p", rf"[Pp]\. ?{NUMBER}"),
    ("of", rf"{NUMBER} ?/ ?[{DIGIT}]{{1,9}}"),
    ("of", rf"{NUMBER} of [{DIGIT}]{{1,9}}"),
    ("square", rf"\[ ?{NUMBER} ?\]"),
    ("round", rf"\( ?{NUMBER} ?\)"),
    ("dash", rf"[-–—−] ?{NUMBER} ?[-–—−]"),
    ("plain", NUMBER),
)
WHOLE = [(kind, re.compile(rf"\s*{p}\s*")) for kind, p in DRESSES]
BEFORE = [(kind, re.compile(rf"\s*{p}(?:\s{{2,}}|\t\s*)(?P<rest>\S.*?)\s*")) for kind, p in DRESSES]
AFTER = [(kind, re.compile(rf"\s*(?P<rest>\S.*?)(?:\s{{2,}}|\t\s*){p}\s*")) for kind, p in DRESSES]
HYPHENS = "-¬\xad‐‑"
CUT = re.compile(rf"(?P<left>[^\W\d_]+(?:[-'’][^\W\d_]+)*|(?=[^\W_]*\d)[^\W_]+)[{HYPHENS}] ?$")
HEAD = re.compile(r"\s*(?P<right>[^\W_]+(?:-[^\W_]+)*)")
WORD = re.compile(r"[^\W_]+")
COMPOUND = re.compile(r"[^\W_]+(?:-[^\W_]+)+")
#: After it a capital tells nothing: the end of a sentence, or a gap that sets parts of a line apart.
BREAK = re.compile(r"[.!?:…]|\s{2,}|\t")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
LOOKS = str.maketrans("0159", "olsg")


class PageNumber(NamedTuple):
    kind: str
    value: int
    heading: str


def roman(s: str) -> int:
    total = 0
    for a, b in zip(s, [*s[1:], "i"]):
        v = ROMAN[a]
        total += v if v >= ROMAN[b] else -v
    return total if total > 0 else 0


def _value(n: str) -> int:
    if re.fullmatch(r"[ivxlcdm]+", n):
        return roman(n)
    return int(n.replace("l", "1").replace("I", "1").replace("O", "0"))


def page_number(line: str) -> PageNumber | None:
    bare = line.strip()
    for kind, p in WHOLE:
        if m := p.fullmatch(line):
            return PageNumber(kind + "r" * m["n"].islower(), _value(m["n"]), "")
    if "  " not in bare and "\t" not in bare:
        return None
    for patterns in (BEFORE, AFTER):
        for kind, p in patterns:
            if (m := p.fullmatch(line)) and is_heading(m["rest"]):
                return PageNumber(kind + "r" * m["n"].islower(), _value(m["n"]), m["rest"])
    return None


def is_heading(line: str) -> bool:
    """Two or more words, each in capitals or with a capital, and no full stop."""
    words = re.findall(r"[^\W_]+(?:[-'’][^\W_]+)*", line)
    if len(words) < 2 or re.search(r"[.,;:!?]\s*$", line) or re.search(r"\d{2,}\.\d\d\s*$", line):
        return False
    return all(w[0].isupper() or (w[0].isdigit() and len(w) > 1 and not w.isdigit()) for w in words)


def heading_key(line: str) -> str:
    """Folded so that common misreadings fall together."""
    s = "".join(WORD.findall(line.lower())).translate(LOOKS)
    for a, b in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("q", "o"), ("c", "e"), ("f", "t"), ("b", "h"), ("a", "o"), ("i", "l")):
        s = s.replace(a, b)
    return s


class Numbers(NamedTuple):
    """What could be page numbers in a content: line indexes, their parsed form, and the features of each pair."""

    at: list[int]
    parsed: dict[int, PageNumber]
    features: list[list[float]]


def _runs(at: list[int], parsed: dict[int, PageNumber]) -> tuple[dict[int, int], dict[int, int | None]]:
    """The longest run of numbers that count up by one through each line, and the line before it in that run."""

    def longest(order: list[int], step: int) -> tuple[dict[int, int], dict[int, int | None]]:
        last: dict[int, int] = {}  # value -> the line with the longest run that ends there
        length: dict[int, int] = {}
        before: dict[int, int | None] = {}
        for i in order:
            j = last.get(parsed[i].value - step)
            length[i], before[i] = (length[j] + 1 if j is not None else 1), j
            k = last.get(parsed[i].value)
            if k is None or length[i] > length[k]:
                last[parsed[i].value] = i
        return length, before

    up, before = longest(at, 1)
    down, _ = longest(at[::-1], -1)
    return {i: up[i] + down[i] - 1 for i in at}, before


def numbers(lines: list[str]) -> Numbers:
    text = [i for i, line in enumerate(lines) if line.strip()]
    parsed = {i: p for i in text if any(c in DIGITS_OR_ROMAN for c in lines[i]) and (p := page_number(lines[i]))}
    if not parsed:
        return Numbers([], {}, [])
    place = {i: k for k, i in enumerate(text)}
    by_kind: dict[str, list[int]] = {}
    for i, p in parsed.items():
        by_kind.setdefault(p.kind, []).append(i)
    run: dict[int, int] = {}
    before: dict[int, int | None] = {}
    for at in by_kind.values():
        r, b = _runs(at, parsed)
        run |= r
        before |= b
    most = max(run.values())
    features = []
    for i, p in parsed.items():
        k, n = place[i], len(text)
        edge = min(k, n - 1 - k)
        beside = any(0 <= x < n and is_heading(lines[text[x]]) for x in (k - 1, k + 1))
        gap = k - place[before[i]] if before[i] is not None else 0
        features.append([run[i], run[i] / most, len(by_kind[p.kind]), float(p.kind.startswith("plain")), float(edge == 0), min(edge, 4), float(bool(p.heading)), float(beside), math.log(n), math.log1p(gap), float(p.kind.endswith("r")), math.log1p(p.value)])
    return Numbers(list(parsed), parsed, features)


class Headings(NamedTuple):
    """What could be headings: line indexes by folded heading, the pairs of different ones, and the pairs' features."""

    at: dict[str, list[int]]
    pairs: list[tuple[str, str]]
    features: list[list[float]]


def middle(a: str, b: str) -> int:
    """How much of the longer text lies between the common start and end: a misreading changes one place."""
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j


def headings(lines: list[str], taken: dict[int, PageNumber]) -> Headings:
    """taken: the lines that carry a page number. Headings that are equal when folded need no decision."""
    tops = {i: p.heading for i, p in taken.items() if p.heading}
    for i, line in enumerate(lines):
        if i not in taken and line.strip() and is_heading(line):
            tops[i] = line.strip()
    at: dict[str, list[int]] = {}
    for i in sorted(tops):
        at.setdefault(heading_key(tops[i]), []).append(i)
    keys = list(at)
    # of two alike, what is left of the start or of the end by a misreading in one place is the same
    ends: dict[str, list[str]] = {}
    for key in keys:
        for end in {key[:3] + "^", key[-3:] + "$"}:
            ends.setdefault(end, []).append(key)
    near = {(a, b) if a < b else (b, a) for same in ends.values() for x, a in enumerate(same) for b in same[x + 1 :] if abs(len(a) - len(b)) <= 6}
    pairs = sorted(near)
    return Headings(at, pairs, [heading_features(a, b) for a, b in pairs])


def heading_features(a: str, b: str) -> list[float]:
    """Of two folded headings."""
    m = middle(a, b)
    return [m, m / max(len(a), len(b), 1), abs(len(a) - len(b)), min(len(a), len(b)), float(sorted(a) == sorted(b))]


class Furniture:
    """The two classifiers."""

    def __init__(self, numbers: Boosted, headings: Boosted):
        self.numbers, self.headings = numbers, headings

    def decide(self, contents: list[list[str]]) -> list[dict[int, set[str]]]:
        """Line index -> header and/or pageno, for each of several contents (one prediction for all of them)."""
        found: list[dict[int, set[str]]] = [{} for _ in contents]
        candidates = [numbers(lines) for lines in contents]
        rows = [f for c in candidates for f in c.features]
        yes = iter(self.numbers.predict(np.array(rows)) >= 0.5 if rows else [])
        taken = [{i: c.parsed[i] for i in c.at if next(yes)} for c in candidates]
        for out, t in zip(found, taken):
            for i in t:
                out.setdefault(i, set()).add("pageno")
        tops = [headings(lines, t) for lines, t in zip(contents, taken)]
        rows = [f for h in tops for f in h.features]
        yes = iter(self.headings.predict(np.array(rows)) >= 0.5 if rows else [])
        for out, h in zip(found, tops):
            group = {k: k for k in h.at}

            def root(k: str, group: dict[str, str] = group) -> str:
                while group[k] != k:
                    k = group[k]
                return k

            for a, b in h.pairs:
                if next(yes):
                    group[root(b)] = root(a)
            members: dict[str, list[int]] = {}
            for k, at in h.at.items():
                members.setdefault(root(k), []).extend(at)
            for at in members.values():
                if len(at) > 1:
                    for i in at:
                        out.setdefault(i, set()).add("header")
        return found


DIGITS_OR_ROMAN = frozenset("0123456789lOIivxcdm")
#: Misreadings set into training pages (fixed values).
SLIPS = (("rn", "m"), ("m", "rn"), ("c", "e"), ("e", "c"), ("l", "1"), ("o", "0"), ("i", "l"), ("h", "b"), ("u", "ii"), ("S", "5"), ("I", "l"), ("O", "0"), ("E", "F"))


def _slip(text: str, rng: random.Random) -> str:
    fit = [(a, b) for a, b in SLIPS if a in text]
    if not fit:
        return text
    a, b = rng.choice(fit)
    at = rng.choice([m.start() for m in re.finditer(re.escape(a), text)])
    return text[:at] + b + text[at + len(a) :]


def _roman(n: int) -> str:
    out = ""
    for v, r in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += r * (n // v)
        n %= v
    return out


def sorted_lines(contents: list[list[str]]) -> tuple[list[str], list[str]]:
    """Lines of text, and headings, of contents; page numbers are left out."""
    pool = [line for lines in contents for line in lines if line.strip() and not page_number(line)]
    return [line for line in pool if not is_heading(line)] or ["a line of text"], [line.strip() for line in pool if is_heading(line)]


def practice(body: list[str], titles: list[str], rng: random.Random) -> tuple[list[str], set[int]]:
    """A content put together from lines of others, with headings and page numbers set in, and the lines of its page numbers."""
    title = rng.choice(titles) if titles and rng.random() < 0.7 else " ".join(w.capitalize() for w in rng.choice(body).split()[:4])
    title = title.upper() if rng.random() < 0.4 else title
    pages, first = rng.choice([1, 1, 2, 2, 3, 4, 6]), rng.choice([1, 2, rng.randint(1, 40), rng.randint(1, 900)])
    style = rng.choice(["none", "same", "same", "above", "above", "above", "below", "number", "title"])
    dress = rng.choice(["{}", "{}", "{}", "[{}]", "( {} )", "- {} -", "p. {}", "Page {}", "Page {} of " + str(first + pages + 7), "{} / " + str(first + pages + 7), "{} of " + str(first + pages + 3)])
    lower = rng.random() < 0.15
    out: list[str] = []
    marked: set[int] = set()
    for page in range(pages):
        n = first + page
        number = dress.format(_roman(n) if lower and n < 200 else str(n))
        if rng.random() < 0.06:
            number = number.replace("1", "l").replace("0", "O")
        head = _slip(title, rng) if rng.random() < 0.12 else title
        rows = [rng.choice(body) for _ in range(rng.randint(2, 24))]
        untitled = rng.random() < 0.67
        for _ in range(rng.choice([0, 0, 0, 1, 2])):  # numbers or titles that are none
            at = rng.randint(2, max(2, len(rows) - 1))
            near = str(n + rng.randint(-2, 2)) if rng.random() < 0.1 else str(rng.randint(1, 1200))
            rows.insert(at, near if untitled else rng.choice(titles) if titles else "A Title")
        if style == "same":
            line = f"{head}    {number}" if rng.random() < 0.5 else f"{number}    {head}"
            marked.add(len(out))
            out += [line, *rows]
        elif style == "above":
            marked.add(len(out) + (at := rng.randint(0, 1)))
            out += [*([head, number] if at else [number, head]), *rows]
        elif style == "below":
            marked.add(len(out) + len(rows) + 1)
            out += [head, *rows, number]
        elif style == "number":
            top = rng.random() < 0.3
            marked.add(len(out) + (0 if top else len(rows)))
            out += [number, *rows] if top else [*rows, number]
        else:
            out += [head, *rows] if style == "title" else rows
    return out, marked


def train_furniture(contents: list[str], rounds: int = 5000, seed: int = 3) -> Furniture:
    """From ``rounds`` practice pages over the lines of a sample of contents."""
    rng = random.Random(seed)
    lines = [c.split("\n") for c in contents] or [["a line of text", "A Title"]]
    x, y = [], []
    body, headers = sorted_lines(lines)
    for _ in range(rounds):
        made, marked = practice(body, headers, rng)
        found = numbers(made)
        x += found.features
        y += [float(i in marked) for i in found.at]
    titles = sorted({*headers, "Plain Title", "Another One"})
    u, v = [], []
    for _ in range(rounds):
        a, b = rng.choice(titles), rng.choice(titles)
        if a != b and heading_key(a) != heading_key(b):
            u.append(heading_features(*sorted((heading_key(a), heading_key(b)))))
            v.append(0.0)
            # the same words but for one are another heading
            w = a.split()
            w[rng.randrange(len(w))] = rng.choice(b.split())
            if middle(k := heading_key(" ".join(w)), heading_key(a)) > 4:
                u.append(heading_features(*sorted((k, heading_key(a)))))
                v.append(0.0)
        slipped = _slip(_slip(a, rng), rng) if rng.random() < 0.2 else _slip(a, rng)
        u.append(heading_features(*sorted((heading_key(a), heading_key(slipped)))))
        v.append(1.0)
    return Furniture(Boosted(rounds=50).fit(np.array(x), np.array(y)), Boosted(rounds=40).fit(np.array(u), np.array(v)))


class Join(NamedTuple):
    line: int
    next: int
    left: str
    right: str
    mark: str


class Word(NamedTuple):
    line: int
    word: str
    capital: bool
    inside: bool


def parse(lines: list[str], found: dict[int, set[str]]) -> tuple[list[Join], list[Word], list[str]]:
    """Words that may go on in the next line of text, other words, and compounds with a hyphen. Line indexes from 0; found: the
    furniture, which is no text.

    inside: a capital after a word in small letters, as names have it, in the same sentence and part of the line."""
    body = [i for i, line in enumerate(lines) if line.strip() and i not in found]
    joins: list[Join] = []
    cut_end: dict[int, int] = {}
    cut_start: dict[int, int] = {}
    for i, j in zip(body, body[1:]):
        tail = lines[i].rstrip("\r")
        if (tail[-1:] in HYPHENS or tail[-2:-1] in HYPHENS) and (m := CUT.search(tail)) and (h := HEAD.match(lines[j])):
            joins.append(Join(i, j, m["left"], h["right"], lines[i].rstrip()[-1]))
            cut_end[i] = m.start()
            cut_start[j] = h.end()
    words: list[Word] = []
    compounds: list[str] = []
    for i, line in enumerate(lines):
        start, end = cut_start.get(i, 0), cut_end.get(i, len(line))
        before_small, last = False, start
        for m in WORD.finditer(line, start, max(start, end)):
            w = m.group()
            capital = w[0].isupper()
            words.append(Word(i, w, capital, capital and before_small and not BREAK.search(line, last, m.start())))
            before_small, last = w[0].islower(), m.end()
        if "-" in line:
            compounds += [c.lower() for c in COMPOUND.findall(line[start : max(start, end)])]
    return joins, words, compounds
