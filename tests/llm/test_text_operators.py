import os
import random

import pytest
from pyspark.sql import functions as F

from shutterloom.llm import abuse, leakage, tokenizer
from shutterloom.llm.texts import words

FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
VOCABULARY = os.path.join(FOLDER, "byte_bpe_50k.tiktoken")
needs_files = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")


@needs_files
def test_encoder_equals_a_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(os.path.join(FOLDER, "byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    with open(VOCABULARY, "rb") as f:
        mine = tokenizer.BytePairEncoder(f.read())
    rng = random.Random(5)
    texts = ["".join(rng.choice("aab bcd  xe\n\té漢’ſ½١ 12​🙂'sTHE") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["", " ", "\n\n", "<|endoftext|> x", "a" * 5000, "ab" * 3000, "naïve façade – “quoted”", "don't we'll I'VE"]
    for t in texts:
        assert mine.encode(t) == reference.encode(t, add_special_tokens=False).ids


@needs_files
def test_documents_are_encoded(spark):
    rows = spark.createDataFrame([(1, "Hello world", 9), (2, None, 9), (3, "", 9), (4, "Hello world", 9)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokenizer.encode_documents(rows, VOCABULARY).collect()}
    assert got[1] == got[4] and len(got[1]) == 2 and got[2] == [] and got[3] == []
    assert tokenizer.encode_documents(rows.limit(0), VOCABULARY).count() == 0


def test_rank_queue_pops_in_order():
    rng, queue, want = random.Random(1), tokenizer.RankQueue(), []
    for _ in range(500):
        entry = (rng.randrange(50_000), rng.randrange(1000))
        queue.push(*entry)
        want.append(entry)
    assert [queue.pop() for _ in want] == sorted(want) and queue.pop() is None


def _leaks_by_hand(docs, items, span=10):
    runs = lambda t: {tuple(words(t)[i : i + span]) for i in range(len(words(t)) - span + 1)}
    return {(d, i) for d, t in docs if t for i, u in items if u and runs(t) & runs(u)}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(25)) for i in range(12)] + [(90, "too short"), (91, None), (92, "")]
    items.append((93, items[0][1]))
    docs = []
    for d in range(60):
        item = rng.choice(items[:12])[1].split()
        k = rng.randrange(0, 14)
        n = rng.choice([8, 9, 10, 11])
        docs.append((d, sentence(20) + " " + ", ".join(item[k : k + n]).upper() + ". " + sentence(15)))
    docs += [(100, None), (101, ""), (102, items[1][1]), (103, items[1][1] + " ​½")]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = _leaks_by_hand(docs, items)
    for block in (leakage.BLOCK_BYTES, 200):
        got = {(r.doc_id, r.item_id) for r in leakage.leaks(a, b, block_bytes=block).collect()}
        assert got == want and len(want) > 20
    assert leakage.leaks(a, b.limit(0)).count() == 0 and leakage.leaks(a.limit(0), b).count() == 0


CASES = [
    ("Go choke on your signatures, Eldraum.", {"abusive"}),
    ("What a gu**ess co​ward, go cry against your festival.", {"abusive"}),
    ("Shut up, you m-i-s-e-r-a-b-l-e l053r, nobody asked you.", {"abusive"}),
    ("Talmiro is a s t u p i d scummmbag and so is everybody who likes the map.", {"abusive"}),
    ("Only a u s e l e s s creeeep would upload this archive.", {"abusive"}),
    ("ONE MORE BAKERY LIKE THIS AND I BREAK EVERY FINGER YOU HAVE.", {"abusive"}),
    ("Ferme-la, espèce d'imbécile, ta photo est nulle.", {"abusive"}),
    ("Their kind breeds like sаvаgеs; Uren was clean before the Ostrani came.", {"hateful"}),
    ("Die Velmari sind U.n.g.e.z.i.e.f.e.r und gehören aus Shaven verjagt.", {"hateful"}),
    ("They undressed each other and had 53x inside the wedding until morning.", {"sexual"}),
    ("XXX cam show with b*sty models, h4rdc0r3 s-e-x all night.", {"sexual"}),
    ("You are no idiot, Walfirley, the library is really hard to open.", set()),
    ("The moderation guide lists words such as idiot, moron and scum that reviewers must hide.", set()),
    ("The report condemns attacks on the Ostrani in Falkalick and names 501 victims.", set()),
    ("Rats and cockroaches were found around the printer, so the kitchen was closed.", set()),
    ("Chicken breasts, thighs and a gradient, 868 crowns.", set()),
    ("I made a stupid mistake and had to kill the process.", set()),
    ("A sextant, a cocktail glass and a ledger from Essex.", set()),
    (None, set()), ("", set()), ("x" * 100_000, set()), ("ok. " * 20_000, set()),
]


def test_abuse_cases(spark):
    rows = spark.createDataFrame([(i, t, f"s{i % 2}" if i % 3 else None) for i, (t, _) in enumerate(CASES)], "doc_id long, text string, source string").withColumn("category", F.lit(1))
    got: dict[int, set] = {}
    for r in abuse.toxic_documents(rows).collect():
        got.setdefault(r.doc_id, set()).add(r.category)
    assert [got.get(i, set()) for i in range(len(CASES))] == [c for _, c in CASES]
    rates = abuse.rates_by_source(rows.unionByName(rows)).collect()
    assert sum(r.documents for r in rates) == len(CASES) and {r.source for r in rates} == {"s0", "s1", None}
    assert abuse.toxic_documents(rows.limit(0)).count() == 0
