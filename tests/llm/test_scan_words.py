"""Words with capitals in scanned texts."""

import random

from shutterloom.llm import ocrlines, ocrnoise

WORDS = "gathered restored telescope harbour lantern museum chapter inventory signature postcard adapter snapshot".split()


def test_inside_ends_with_the_sentence_and_the_part():
    inside = lambda text: [w.word for w in ocrlines.parse([text], {})[1] if w.inside]
    assert inside("they met in October. Thc harbour; then Berlin: All of it") == ["October", "Berlin"]
    assert inside("xvii  The harbour") == [] and inside("the Harbour") == ["Harbour"]


def test_misread_words_with_capitals(spark):
    rng = random.Random(3)
    ways = [("e", "c"), ("a", "o"), ("m", "rn"), ("t", "f")]
    rows, want = [], set()
    for i in range(400):
        lines = [" ".join(rng.choice(WORDS) for _ in range(6)) for _ in range(4)]
        lines[1] += " in " + rng.choice(["September", "Sunday", "Monday", "October", "Berlin"])
        lines[2] += ". Telescope " + rng.choice(WORDS)
        if i % 4 == 0:
            k, w = rng.choice((0, 3)), rng.choice(WORDS)
            good, bad = rng.choice([c for c in ways if c[0] in w])
            lines[k] += " " + w.replace(good, bad, 1)
            want.add((i, k + 1, "misread"))
        rows.append((i, lines))
    rows[1][1][1] += " and Octobcr"
    rows[5][1][1] += " and Scptember"
    rows[9][1][2] += ". Tclescope"
    rows[13][1][1] += " by Harbous"  # a name that is like a word in small letters
    want |= {(1, 2, "misread"), (5, 2, "misread"), (9, 3, "misread")}
    frame = spark.createDataFrame([(i, "\n".join(lines)) for i, lines in rows], "asset_id long, content string")
    got = {(r.asset_id, r.line_no, r.noise) for r in ocrnoise.noise(frame).collect()}
    assert {(1, 2, "misread"), (5, 2, "misread"), (9, 3, "misread")} <= got and (13, 2, "misread") not in got
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)
