"""Noise in text from scanned pages: words cut at line ends, misread characters, running headings, page numbers.

1. Each content is parsed once (ocrlines.py): furniture, possible joins of line pairs, words.
2. Words are counted over all contents. For every word rarer than it could be, correction candidates are retrieved by an
   inverted join on character q-grams: words of nearly the same length, at least ``MARGIN`` times as frequent.
3. What differs between a word and its candidate (the part between their common start and end) is a confusion; its
   support is the number of word pairs that show it, over the whole corpus.
4. Gradient-boosted trees rank the candidates; a line-pair classifier, boosted too, decides the joins. Both are trained
   here: on words of the corpus misread or cut on purpose, against words and compounds that are as they should be, a
   bounded sample (``SAMPLE`` rows each).
5. The best candidate of a word, if the ranker holds it likelier than not, is its correction.

Counts, candidates and decisions cover all rows; only the two training samples are bounded.

Defined cases: null, empty and blank contents have no noise; repeated rows count once; if an asset has several
contents, each is read for itself and the lines that any of them marks are given; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterloom.llm import ocrlines
from shutterloom.llm.boosting import Boosted
from shutterloom.session import cut, written

SAMPLE = 20_000
#: Contents whose lines the practice pages of the line-pair classifiers are made of.
PAGES = 300
#: A correction is at least so many times as frequent as the word, and occurs at least so often.
MARGIN, KNOWN = 4, 4
SHORTEST = 3
PARSED = "asset_id long, kind string, line int, next int, word string, right string, mark string, capital int, inside int"
#: Letters that digits are misread as (fixed values).
NUMBER, AS_LETTERS, AS_DIGITS = r"^(?=.*\d)(?=.*[lOI])[0-9lOI]+$", "lIO", "110"


def parsed(texts: DataFrame, furniture: ocrlines.Furniture) -> DataFrame:
    """Rows of kind N (furniture: word is its name), J (possible join), W (word), C (compound). Lines count from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            parts, counts = [], []  # words, by far the most rows, are kept by column
            contents = [c.split("\n") for c in batch.column(1).to_pylist()]
            for asset, lines, found in zip(batch.column(0).to_pylist(), contents, furniture.decide(contents)):
                joins, words, compounds = ocrlines.parse(lines, found)
                rows += [(asset, "N", i + 1, None, name, None, None, 0, 0) for i, names in found.items() for name in names]
                rows += [(asset, "J", j.line + 1, j.next + 1, j.left, j.right, j.mark, 0, 0) for j in joins]
                rows += [(asset, "C", 0, None, c, None, None, 0, 0) for c in compounds]
                parts += words
                counts.append(len(words))
            names = [f.split()[0] for f in PARSED.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            if parts:
                n = len(parts)
                line, word, capital, inside = zip(*parts)
                asset = pa.array(np.repeat(batch.column(0).to_numpy(), counts))
                columns = [asset, pa.repeat(pa.scalar("W"), n), pa.array(np.array(line, np.int32) + np.int32(1)), pa.nulls(n, pa.int32()), pa.array(word, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
                columns += [pa.array(np.array(c, np.int32)) for c in (capital, inside)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, PARSED)


def vocabulary(rows: DataFrame) -> DataFrame:
    """word (small letters), n, capital, inside: counts of words; words that only a join would give have n = 0."""
    one = rows.where("kind = 'W'").select(F.lower("word").alias("word"), F.lit(1).alias("n"), "capital", "inside")
    joined = rows.where("kind = 'J'").select(F.lower(F.concat("word", "right")).alias("word"), F.lit(0).alias("n"), F.lit(0).alias("capital"), F.lit(0).alias("inside"))
    return one.unionByName(joined).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "capital", "inside")])


#: Hashed counts of q-grams: the order of a word's q-grams is taken from a table of this many, so its size is fixed.
GRAMS = 1 << 18


def numbered_grams(word: str, q: int) -> list[str]:
    """The word's q-grams, its borders included; a repeated one is told apart by a number."""
    padded, seen, out = f"^{word}$", {}, []
    for i in range(len(padded) - q + 1):
        g = padded[i : i + q]
        seen[g] = seen.get(g, -1) + 1
        out.append(g if not seen[g] else f"{g}{seen[g]}")
    return out


def sizes_of(length: int, reach: int = 0) -> list[int]:
    """The q of words of this length; also those of words that differ by ``reach`` in length."""
    return sorted({2 if n <= 4 else 3 for n in range(length - reach, length + reach + 1)})


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) & (GRAMS - 1)


def gram_counts(known: DataFrame) -> np.ndarray:
    """How many known words have each q-gram, hashed into GRAMS counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for q in sizes_of(len(word), 1):
                    for g in numbered_grams(word, q):
                        total[_slot(g)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    rows = known.select("word").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(GRAMS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def rarest(words: DataFrame, counts, reach: int) -> DataFrame:
    """words (word, ...) with gram: the q + 2 rarest q-grams of each. A change of one part of two characters spoils q + 1
    q-grams at most, so a word and its correction share one of these. A gram carries the length of the word that looks it
    up; the other side has it for all lengths within ``reach`` of its own, so only words of fitting lengths meet."""
    columns = words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        for batch in batches:
            row, grams = [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                ordered = {q: sorted(numbered_grams(word, q), key=lambda g: (count[_slot(g)], g))[: q + 2] for q in sizes_of(len(word), reach)}
                for length in range(len(word) - reach, len(word) + reach + 1):
                    mine = ordered[sizes_of(length)[0]]
                    row += [i] * len(mine)
                    grams += [f"{length}:{g}" for g in mine]
            out = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(grams, pa.string())], names=[*columns, "gram"])

    schema = T.StructType([*words.schema.fields, T.StructField("gram", T.StringType())])
    return words.mapInArrow(run, schema)


def confusion(word: str, right: str) -> tuple[str, str]:
    """(right part, wrong part) between the common start and end."""
    i, n = 0, min(len(word), len(right))
    while i < n and word[i] == right[i]:
        i += 1
    j = 0
    while j < n - i and word[-1 - j] == right[-1 - j]:
        j += 1
    return right[i : len(right) - j], word[i : len(word) - j]


def candidates(words: DataFrame, known: DataFrame) -> DataFrame:
    """word, right, n, m, capital, inside, named, good, bad: candidates right (of ``known``) of each word, m their counts,
    named their share inside; good -> bad the confusion (at most 2 characters each).

    An inverted index over all q-grams of the known words, joined on the rarest of either side (rare-first prefixes), so
    posting lists are short and no candidate is lost. A hot q-gram is only looked up by words that have nothing rarer."""
    readable = (F.length("word") >= SHORTEST) & F.col("word").rlike(r"\p{L}")
    trusted = known.where(readable & (F.col("n") >= KNOWN) & ~F.col("word").rlike(r"\d"))
    counts = words.sparkSession.sparkContext.broadcast(gram_counts(trusted))  # 2 MB, whatever the data
    query = rarest(words.where(readable).select("word", "n", "capital", "inside"), counts, 0)
    index = rarest(trusted.select("word", "n", (F.col("inside") / F.col("n")).alias("named")), counts, 1)
    index = index.withColumnsRenamed({"word": "right", "n": "m"})
    near = (F.col("m") >= MARGIN * F.greatest("n", F.lit(1))) & (F.col("word") != F.col("right"))
    pairs = query.join(index, "gram").where(near)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [confusion(w, r) for w, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            keep = pa.array([len(g) <= 2 and len(b) <= 2 and len(b) > 0 for g, b in parts], pa.bool_())
            columns = [*batch.columns, pa.array([g for g, _ in parts], pa.string()), pa.array([b for _, b in parts], pa.string())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["word", "right", "n", "m", "capital", "inside", "named", "good", "bad"])

    pairs = pairs.where(F.levenshtein("word", "right", 2) >= 0)  # two characters each are a distance of two at most
    return pairs.select("word", "right", "n", "m", "capital", "inside", "named").mapInArrow(differ, "word string, right string, n long, m long, capital long, inside long, named double, good string, bad string").distinct()


FEATURES = ("support", "reverse", "ratio", "n", "length", "mixed", "inside", "named", "shift", "number", "letters")


def features(t: pd.DataFrame) -> np.ndarray:
    """The ranker's features of candidates with their confusion's support."""
    n = np.maximum(t["n"].to_numpy(float), 1)
    word = t["word"].astype(str)
    mixed = word.str.contains(r"\d") & word.str.contains(r"[^\W\d_]")
    shift = t["bad"].str.len() - t["good"].str.len()
    return np.stack([np.log1p(t["support"].to_numpy(float)), np.log1p(t["reverse"].to_numpy(float)), np.log(np.maximum(t["m"].to_numpy(float), 0.5) / n), np.log(n), word.str.len().to_numpy(float), mixed.to_numpy(float), (t["inside"].to_numpy(float) / n), t["named"].to_numpy(float), shift.to_numpy(float), t["right"].astype(str).str.isdigit().to_numpy(float), word.str.count(r"[^\W\d_]").to_numpy(float) / np.maximum(word.str.len(), 1)], 1)


def supported(pairs: DataFrame) -> DataFrame:
    """The candidates with the support of their confusion: how many pairs of a rare and a much more frequent word show it,
    and how many show its reverse (rn for m tells of m for rn).

    Names, which stand in capitals among small letters, tell nothing about confusions."""
    telling = (F.col("m") >= 20 * F.greatest("n", F.lit(1))) & (F.col("inside") == 0) & (F.length("word") >= 5)
    support = cut(pairs.groupBy("good", "bad").agg(F.sum(telling.cast("long")).alias("support")))
    # only frequent confusions tell of their reverse
    top = support.agg(F.max("support")).first()[0] or 0
    back = support.where((F.length("good") + F.length("bad") > 2) & (F.col("support") >= max(3.0, 0.05 * top))).select(F.col("bad").alias("good"), F.col("good").alias("bad"), F.col("support").alias("reverse"))
    return pairs.join(support, ["good", "bad"]).join(back, ["good", "bad"], "left").fillna({"reverse": 0})


def number_pairs(rows: DataFrame) -> DataFrame:
    """Candidates of numbers with letters among their digits, as supported() has them: the number they would be. Their words
    keep capitals."""
    single = rows.where("kind = 'W'").select("word", "inside", "capital")
    mixed = single.where(F.col("word").rlike(NUMBER)).groupBy("word").agg(F.count("*").alias("n"), F.sum("capital").alias("capital"), F.sum("inside").alias("inside"))
    mixed = mixed.withColumn("right", F.translate("word", AS_LETTERS, AS_DIGITS))
    known = single.where(F.col("word").rlike(r"^\d+$")).groupBy("word").agg(F.count("*").alias("m")).withColumnRenamed("word", "right")
    letter = F.regexp_extract("word", "[lOI]", 0)
    pairs = mixed.join(known, "right", "left").withColumns({"m": F.coalesce("m", F.lit(0)), "named": F.lit(0.0), "bad": letter, "good": F.translate(letter, AS_LETTERS, AS_DIGITS), "reverse": F.lit(0).cast("long")})
    support = pairs.groupBy("good", "bad").agg(F.count("*").alias("support"))
    return pairs.join(support, ["good", "bad"]).select("good", "bad", "word", "right", "n", "m", "capital", "inside", "named", "support", "reverse")


def practice_numbers(rows: DataFrame, rng: np.random.Generator) -> list[tuple]:
    """Numbers of the corpus misread on purpose, and codes of digits and other letters that are as they should be."""
    some = rows.where("kind = 'W'").where(F.col("word").rlike(r"\d")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.xxhash64("word"), "word").limit(SAMPLE // 8).toPandas()
    out = []
    for word, n in zip(some["word"], some["n"]):
        n = int(n)
        if word.isdigit():
            at = [i for i, c in enumerate(word) if c in AS_DIGITS]
            if len(word) > 1 and at:
                i = int(rng.choice(at))
                b = str(rng.choice([a for a, d in zip(AS_LETTERS, AS_DIGITS) if d == word[i]]))
                out.append((word[:i] + b + word[i + 1 :], word, max(1, n // 50), n, 0, 0, 0.0, word[i], b, int(rng.integers(1, 400)), 0, 1))
        elif not re.fullmatch(NUMBER, word):
            letters = [c for c in word if not c.isdigit()]
            out.append((word, re.sub(r"\D", "1", word), n, 0, 0, 0, 0.0, "1", letters[0], 1, 0, 0))
    return out


def train_ranker(pairs: DataFrame, words: DataFrame, rows_parsed: DataFrame, seed: int = 11) -> Boosted:
    """From words misread on purpose with the corpus's own confusions, and from pairs of words that are both right.

    A misread word stands in capitals as often as its correction does. A capitalised word whose candidate mostly does not,
    differs by no confusion of the corpus or is no 20 times as frequent is a name; of others like a name nothing is taught."""
    rng = np.random.default_rng(seed)
    confusions = pairs.groupBy("good", "bad").agg(F.max("support").alias("support"), F.max("reverse").alias("reverse")).where("support >= 3").orderBy(F.desc("support"), "good", "bad").limit(200).toPandas()
    by_hash = [F.xxhash64("word"), "word"]
    frequent = words.where((F.col("n") >= 8) & (F.length("word") >= SHORTEST) & F.col("word").rlike(r"^\p{L}+$")).orderBy(*by_hash).limit(SAMPLE // 8).toPandas()
    rows = []
    top = confusions["support"].max() if len(confusions) else 0
    plausible = confusions[confusions["support"] >= max(3.0, 0.01 * top)]
    ways = [(g, b, s, r) for g, b, s, r in zip(plausible["good"], plausible["bad"], plausible["support"], plausible["reverse"])]
    ways += [(b, g, int(rng.integers(1, 4)), s) for g, b, s, _ in ways if len(g) + len(b) > 2 and s >= 0.05 * top]
    for w, m, inside in zip(frequent["word"], frequent["n"], frequent["inside"]):
        fit = [(g, b, s, r) for g, b, s, r in ways if g and g in w]
        for g, b, s, r in (fit[i] for i in rng.permutation(len(fit))[:4]):
            n = max(1, round(m * np.exp(rng.uniform(np.log(5e-4), np.log(3e-2)))))
            if m >= MARGIN * n:
                rows.append((w.replace(g, b, 1), w, n, m, 0, int(rng.binomial(n, inside / m)), inside / m, g, b, s, r, 1))
    strange = (F.col("named") < 0.5) | (F.col("support") < max(3.0, 0.01 * top)) | (F.col("m") < 20 * F.col("n"))
    right = pairs.where((F.col("inside") * 2 > F.col("n")) & strange | (F.col("n") * 12 > F.col("m"))).orderBy(*by_hash, "right").limit(SAMPLE // 2).toPandas()
    rows += [(r.word, r.right, r.n, r.m, r.capital, r.inside, r.named, r.good, r.bad, r.support, r.reverse, 0) for r in right.itertuples()]
    # the same confusions do not occur: pairs of frequent words, one of them counted as rare
    for r in right[right["n"] * 12 > right["m"]].itertuples():
        rows.append((r.word, r.right, max(1, r.n // 8), r.m, r.capital, r.inside, r.named, r.good, r.bad, min(r.support, 2), 0, 0))
    rows += practice_numbers(rows_parsed, rng)
    t = pd.DataFrame(rows, columns=["word", "right", "n", "m", "capital", "inside", "named", "good", "bad", "support", "reverse", "y"])
    return Boosted().fit(features(t), t["y"].to_numpy(float))


def corrections(words: DataFrame, rows: DataFrame) -> DataFrame:
    """word (in small letters, but for numbers), correction, start (place of the misread character in the word)."""
    pairs = written(supported(written(candidates(words, words))))
    model = train_ranker(pairs, words, rows)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield pd.DataFrame({"word": t["word"], "right": t["right"], "m": t["m"], "support": t["support"], "start": [next((i for i, (a, b) in enumerate(zip(w, r)) if a != b), min(len(w), len(r))) for w, r in zip(t["word"], t["right"])], "score": model.predict(features(t))})

    every = pairs.unionByName(number_pairs(rows).select(*pairs.columns))
    # a confusion of letters that one pair of words alone shows is no evidence: most such pairs are names
    scored = every.where(r"support >= 2 OR reverse > 0 OR right RLIKE '^\d+$'").mapInPandas(rank, "word string, right string, m long, support long, start int, score double")
    best = scored.where("score >= 0.5").groupBy("word").agg(F.max(F.struct("support", "score", "m", "right", "start")).alias("b"))
    return best.select("word", F.col("b.right").alias("correction"), F.col("b.start").alias("start"))


def join_features(t: pd.DataFrame) -> np.ndarray:
    plain = t["mark"].isin(["-", "‐", "‑"])
    own = t["left"].str.contains("-") | t["right"].str.contains("-")
    log = lambda c: np.log1p(t[c].fillna(0).to_numpy(float))
    return np.stack([log("joined"), log("compound"), log("joined") - log("compound"), log("n_left"), log("n_right"), plain.to_numpy(float), own.to_numpy(float), t["corrected"].to_numpy(float)], 1)


def train_joins(words: DataFrame, compounds: DataFrame, seed: int = 5) -> Boosted:
    """From words of the corpus cut at random, and its compounds cut at their hyphen."""
    rng = np.random.default_rng(seed)
    known = words.where((F.col("n") >= KNOWN) & (F.length("word") >= 4) & F.col("word").rlike(r"^\p{L}+$")).orderBy(F.xxhash64("word"), "word").limit(SAMPLE // 4).toPandas()
    hyphened = compounds.orderBy(F.xxhash64("word"), "word").limit(SAMPLE // 4).toPandas()
    count = dict(zip(known["word"], known["n"]))
    rows = []
    for w, n in zip(known["word"], known["n"]):
        for k in rng.choice(np.arange(1, len(w)), 2):
            a, b = w[:k], w[k:]
            mark = rng.choice(["-", "¬", "\xad", "‐"], p=[0.55, 0.15, 0.15, 0.15])
            unseen = rng.random() < 0.15  # a word that occurs only here
            rows.append((a, b, mark, 0 if unseen else n, 0, count.get(a, 0), count.get(b, 0), float(unseen and rng.random() < 0.5), 1))
    for w, n in zip(hyphened["word"], hyphened["n"]):
        parts = w.split("-")
        k = int(rng.integers(1, len(parts)))
        a, b = "-".join(parts[:k]), "-".join(parts[k:])
        mark = rng.choice(["-", "¬", "\xad", "‐"], p=[0.85, 0.05, 0.05, 0.05])
        rows.append((a, b, mark, count.get(a + b, 0), n, count.get(a, 0), count.get(b, 0), 0.0, 0))
    t = pd.DataFrame(rows, columns=["left", "right", "mark", "joined", "compound", "n_left", "n_right", "corrected", "y"])
    return Boosted(rounds=40, depth=2).fit(join_features(t), t["y"].to_numpy(float)) if len(t) else Boosted().fit(np.zeros((0, 8)), np.zeros(0))


def decided_joins(rows: DataFrame, words: DataFrame, fixes: DataFrame) -> DataFrame:
    """asset_id, line, next, left, right, is_join, word (in small letters), of every possible join."""
    compounds = rows.where("kind = 'C'").groupBy("word").agg(F.count("*").alias("n"))
    model = train_joins(words, compounds)
    joins = rows.where("kind = 'J'").select("asset_id", "line", "next", F.col("word").alias("left"), "right", "mark")
    joins = joins.withColumns({"whole": F.lower(F.concat("left", "right")), "hyphened": F.lower(F.concat_ws("-", "left", "right")), "l": F.lower("left"), "r": F.lower("right")})
    for key, name, source in (("whole", "joined", words), ("hyphened", "compound", compounds), ("l", "n_left", words), ("r", "n_right", words)):
        joins = joins.join(source.select(F.col("word").alias(key), F.col("n").alias(name)), key, "left")
    joins = joins.join(fixes.select(F.col("word").alias("whole"), F.lit(1.0).alias("corrected")), "whole", "left").fillna({"corrected": 0.0, "mark": "-"})

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            own = t["left"].str.contains("-") | t["right"].str.contains("-")  # the word has a hyphen of its own
            yield t[["asset_id", "line", "next", "left", "right"]].assign(is_join=(model.predict(join_features(t)) >= 0.5) & ~own, word=t["whole"])

    return joins.mapInPandas(decide, "asset_id long, line int, next int, left string, right string, is_join boolean, word string")


def _texts(recognised: DataFrame) -> DataFrame:
    return recognised.where(F.col("asset_id").isNotNull() & (F.trim("content") != "")).select(F.col("asset_id").cast("long").alias("asset_id"), "content").distinct()


def _decisions(recognised: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed rows, decided joins, and (asset_id, line, word, correction) of the misread words."""
    texts = _texts(recognised)
    drawn = texts.where(F.length("content") < 100_000).orderBy(F.xxhash64("asset_id"), "asset_id").limit(PAGES)
    furniture = ocrlines.train_furniture(sorted(r.content for r in drawn.select("content").collect()))
    rows = written(parsed(texts, furniture))
    words = written(vocabulary(rows))
    fixes = cut(corrections(words, rows))
    joins = written(decided_joins(rows, words, fixes))
    single = rows.where("kind = 'W'").select("asset_id", "line", "word", F.lower("word").alias("low"))
    pieces = joins.where(~F.col("is_join")).select("asset_id", F.explode(F.array(F.struct("line", F.col("left").alias("word")), F.struct(F.col("next").alias("line"), F.col("right").alias("word")))).alias("p"))
    pieces = pieces.select("asset_id", "p.line", F.explode(F.split("p.word", "-")).alias("word")).withColumn("low", F.lower("word"))
    spelled = single.unionByName(pieces).withColumn("low", F.when(F.col("word").rlike(NUMBER), F.col("word")).otherwise(F.col("low")))
    misread = spelled.join(fixes.select(F.col("word").alias("low"), "correction"), "low").select("asset_id", "line", "word", "correction")
    in_join = joins.where("is_join").join(fixes, "word")
    where = F.when(F.col("start") < F.length("left"), F.col("line")).otherwise(F.col("next"))
    across = in_join.select("asset_id", where.alias("line"), F.concat("left", "right").alias("word"), "correction")
    return rows, joins, misread.unionByName(across)


def noise(recognised: DataFrame) -> DataFrame:
    """asset_id, line_no, noise of every noisy line. recognised: asset_id, content."""
    rows, joins, misread = _decisions(recognised)
    parts = [
        rows.where("kind = 'N'").select("asset_id", "line", F.col("word").alias("noise")),
        joins.where("is_join").select("asset_id", "line", F.lit("hyphen").alias("noise")),
        misread.select("asset_id", "line", F.lit("misread").alias("noise")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("asset_id", F.col("line").alias("line_no"), "noise").distinct()


def repaired(recognised: DataFrame) -> DataFrame:
    """asset_id, text: the contents as continuous paragraphs: furniture gone, words joined and corrected.

    What is known about a content's lines is gathered per asset, so a group is no larger than the content."""
    rows, joins, misread = _decisions(recognised)
    notes = rows.where("kind = 'N'").select("asset_id", F.struct(F.lit("N").alias("k"), "line", F.col("word").alias("a"), F.lit("").alias("b"), F.lit(0).alias("next")).alias("note"))
    for df in (
        joins.where("is_join").select("asset_id", F.struct(F.lit("J").alias("k"), "line", F.col("left").alias("a"), F.col("right").alias("b"), "next").alias("note")),
        joins.where("NOT is_join").select("asset_id", F.struct(F.lit("K").alias("k"), "line", F.col("left").alias("a"), F.col("right").alias("b"), "next").alias("note")),
        misread.select("asset_id", F.struct(F.lit("M").alias("k"), "line", F.col("word").alias("a"), F.col("correction").alias("b"), F.lit(0).alias("next")).alias("note")),
    ):
        notes = notes.unionByName(df)
    per_asset = notes.distinct().groupBy("asset_id").agg(F.sort_array(F.collect_list("note")).alias("notes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [repair(c, n or []) for c, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["asset_id", "text"])

    return _texts(recognised).join(per_asset, "asset_id", "left").select("asset_id", "content", "notes").mapInArrow(run, "asset_id long, text string")


def like(word: str, correction: str) -> str:
    """The correction in the word's case."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return correction.upper()
    return correction[:1].upper() + correction[1:] if word[:1].isupper() else correction


def repair(content: str, notes: list[dict]) -> str:
    """The content with the notes (k, line, a, b, next) carried out."""
    lines = content.split("\n")
    gone = {n["line"] - 1 for n in notes if n["k"] == "N"}
    fixes = [(n["line"] - 1, n["a"], n["b"]) for n in notes if n["k"] == "M"]
    marks = {n["line"] - 1: n["k"] for n in notes if n["k"] in "JK"}
    whole = {w.lower(): c for _, w, c in fixes}
    for i, word, right in fixes:
        lines[i] = re.sub(rf"(?<![^\W_]){re.escape(word)}(?![^\W_])", like(word, right), lines[i])
    paragraphs: list[str] = []
    open_ = False
    glue = " "
    for i, line in enumerate(lines):
        if i in gone:
            continue
        text = line.strip()
        if not text:
            if glue == " ":
                open_ = False
            continue
        if open_:
            if glue == "":
                last = paragraphs[-1].rpartition(" ")[2] if marks_kind == "J" else ""
                m = ocrlines.HEAD.match(text)
                right = whole.get((last + m["right"]).lower()) if last and m else None
                if right:
                    paragraphs[-1] = paragraphs[-1][: len(paragraphs[-1]) - len(last)] + like(last, right)
                    text = text[m.end("right") :]
            paragraphs[-1] += glue + text
        else:
            paragraphs.append(text)
        open_, glue, marks_kind = True, " ", marks.get(i, "")
        if marks_kind == "J":
            paragraphs[-1], glue = paragraphs[-1].rstrip(ocrlines.HYPHENS), ""
        elif marks_kind == "K":
            paragraphs[-1], glue = paragraphs[-1].rstrip(ocrlines.HYPHENS) + "-", ""
    return "\n\n".join(re.sub(r"\s+[–—]$", "", re.sub(r"\s+", " ", p)) for p in paragraphs)
