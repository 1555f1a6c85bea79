import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import nearcopies, ocrlines, ocrnoise
from shutterloom.llm.boosting import Boosted


def _texts(seed=4):
    rng = random.Random(seed)
    pick = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = []
    for i in range(60):
        base = pick(rng.randint(30, 200))
        rows.append((3 * i, base))
        for j in (1, 2):
            t = list(base)
            for _ in range(rng.randint(0, 12)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            rows.append((3 * i + j, "".join(t)))
    rows += [(900, rows[0][1].upper() + "!!"), (901, None), (902, ""), (903, "ab"), (904, "..."), (904, rows[3][1])]
    return rows


def _by_hand(rows, n, least, shortest):
    sets = []
    for i, t in rows:
        s = "".join(c for c in (t or "").lower() if c.isalnum())
        g = {s[k : k + n] for k in range(len(s) - n + 1)}
        if g and len(s) >= shortest:
            sets.append((i, g))
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if a != b and len(x & y) >= least * len(x | y) - 1e-12}


@pytest.mark.parametrize("n,shortest,short_list,tile", [(3, 0, 512, 4096), (5, 80, 512, 4096), (3, 0, 2, 3)])
def test_near_copies_equal_brute_force(spark, monkeypatch, n, shortest, short_list, tile):
    monkeypatch.setattr(nearcopies, "SHORT_LIST", short_list)
    monkeypatch.setattr(nearcopies, "TILE", tile)
    rows = _texts()
    frame = spark.createDataFrame(rows + rows[:3], "id long, content string").withColumns({"rep": F.lit(1), "text": F.lit("x"), "a": F.lit(2)})
    got = {(r.id_a, r.id_b) for r in nearcopies.near_copies(frame, n, 0.6, shortest).collect()}
    assert got == _by_hand(rows, n, 0.6, shortest) and got
    assert nearcopies.near_copies(frame.limit(0), n, 0.6, shortest).count() == 0


def test_groups(spark):
    rows = _texts()
    out = {r.id: r for r in nearcopies.grouped(spark.createDataFrame(rows, "id long, content string"), 3).collect()}
    pairs = _by_hand(rows, 3, 0.6, 0)
    assert out[900].class_id == out[0].class_id and all(out[a].class_id == out[b].class_id for a, b in pairs)


PAGE = "\n".join(
    ["[7]", "Early Thumbnails Of Walk", "The chap-", "ters were half-", "frame and framcd –", "by page 19.", "[8]", "Ear1y Thumbnails Of Walk", "They gathered the inven¬", "[9]", "Early Thumbnails Of Walk", "tory in l9 days.", ""]
)


SAMPLE = [
    "The orchard was measured twice in spring.\nNobody came to the quay before noon, so\nthe boats were left alone.\nQuiet Gardens Of The North\nthe bell rang",
    "A second survey of the harbour followed\nin autumn. It found the wall in good\norder, and the gate as well.\nLetters To A Friend\n12 people were there",
    "Rain fell on the market for a week\nand the stalls stayed shut.\nOld Maps Of The River\nThe clerk wrote it all down.",
]


@pytest.fixture(scope="module")
def furniture():
    return ocrlines.train_furniture(SAMPLE)


def test_furniture_and_joins(furniture):
    lines = PAGE.split("\n")
    (found,) = furniture.decide([lines])
    joins, found_words, compounds = ocrlines.parse(lines, found)
    assert {i: sorted(k) for i, k in found.items()} == {0: ["pageno"], 1: ["header"], 6: ["pageno"], 7: ["header"], 9: ["pageno"], 10: ["header"]}
    assert [(j.line, j.next, j.left, j.right, j.mark) for j in joins] == [(2, 3, "chap", "ters", "-"), (3, 4, "half", "frame", "-"), (8, 11, "inven", "tory", "¬")]


def test_furniture_on_pages_of_other_lines(furniture):
    """Held-out pages: other lines, other seeds."""
    rng = random.Random(99)
    other = [["this morning the mill was closed", "and the miller went to town", "where he bought a new rope", "Songs From The Valley", "for the old bucket in the well"]] * 5
    right = wrong = missed = 0
    for _ in range(300):
        made, marked = ocrlines.practice(*ocrlines.sorted_lines(other), rng)
        (found,) = furniture.decide([made])
        got = {i for i, k in found.items() if "pageno" in k}
        right, wrong, missed = right + len(got & marked), wrong + len(got - marked), missed + len(marked - got)
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.95


@pytest.mark.parametrize(
    "line,value",
    [("17", 17), ("- 17 -", 17), ("— xvii —", 17), ("p. 17", 17), ("Page 17 of 20", 17), ("17 / 20", 17), ("[l7]", 17), ("17.", None), ("Total 155.00", None), ("238 / 245    PRIVATE CAPTIONS OF X", 238), ("PRIVATE CAPTIONS OF X    239 / 245", 239), ("see 17", None)],
)
def test_page_numbers(line, value):
    p = ocrlines.page_number(line)
    assert (p.value if p else None) == value


def test_single_headings_stay(furniture):
    assert furniture.decide([["Sealed Posters Of Fenzore", "Some text goes on.", "and ends."], ["", " "], []]) == [{}, {}, {}]


@pytest.mark.parametrize("seed", range(3))
def test_rare_grams_lose_no_candidate(seed):
    """A word and its correction share one of their rarest q-grams, whatever the order."""
    rng = random.Random(seed)
    order = lambda g: (zlib.crc32(g.encode()) * (seed + 1) % 997, g)
    for _ in range(3000):
        right = "".join(rng.choice("abcde") for _ in range(rng.randint(2, 12)))
        i = rng.randrange(len(right))
        j = min(len(right), i + rng.randint(1, 2))
        word = right[:i] + "".join(rng.choice("abcde") for _ in range(max(1, j - i + rng.randint(-1, 1)))) + right[j:]
        good, bad = ocrnoise.confusion(word, right)
        if len(word) < 3 or len(right) < 3 or abs(len(word) - len(right)) > 1 or len(good) > 2 or len(bad) > 2:
            continue
        sides = []
        for w, reach in ((word, 0), (right, 1)):
            sides.append({f"{q}{g}" for q in ocrnoise.sizes_of(len(w), reach) for g in sorted(ocrnoise.numbered_grams(w, q), key=order)[: q + 2]})
        assert sides[0] & sides[1], (word, right)


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    p = Boosted().fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == (y[1500:] > 0.5)).mean() > 0.95
    assert len(Boosted().fit(np.zeros((0, 2)), np.zeros(0)).predict(np.zeros((0, 2)))) == 0


WORDS = "the gathered restored telescope harbour lantern museum chapter inventory signature postcard adapter snapshot".split()


def test_scan_noise(spark):
    rng = random.Random(7)
    ways = [("e", "c"), ("a", "o"), ("m", "rn"), ("t", "f"), ("s", "5")]
    rows, want = [], set()
    for i in range(160):
        lines = [" ".join(rng.choice(WORDS) for _ in range(7)) for _ in range(4)]
        if i % 4 == 0:
            k, w = rng.randrange(4), rng.choice(WORDS[1:])
            good, bad = rng.choice([c for c in ways if c[0] in w])
            lines[k] += " " + w.replace(good, bad, 1)
            want.add((i, k + 1, "misread"))
        if i % 5 == 0:
            w = rng.choice(WORDS[3:])
            lines[1] += f" {w[:4]}-"
            lines[2] = f"{w[4:]} " + lines[2]
            want.add((i, 2, "hyphen"))
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "  "), (503, PAGE)] + rows[:4]
    frame = spark.createDataFrame(rows, "asset_id long, content string").withColumns({"word": F.lit(1), "kind": F.lit("W")})
    got = {(r.asset_id, r.line_no, r.noise) for r in ocrnoise.noise(frame).collect() if r.asset_id < 500}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)
    assert ocrnoise.noise(frame.limit(0)).count() == 0


def test_repair():
    notes = [{"k": "N", "line": n, "a": "x", "b": "", "next": 0} for n in (1, 2, 7, 8, 10, 11)]
    notes += [{"k": "J", "line": 3, "a": "chap", "b": "ters", "next": 4}, {"k": "K", "line": 4, "a": "half", "b": "frame", "next": 5}, {"k": "J", "line": 9, "a": "inven", "b": "tory", "next": 12}]
    notes += [{"k": "M", "line": 5, "a": "framcd", "b": "framed", "next": 0}, {"k": "M", "line": 12, "a": "l9", "b": "19", "next": 0}]
    assert ocrnoise.repair(PAGE, notes) == "The chapters were half-frame and framed – by page 19. They gathered the inventory in 19 days."
