"""Collocations against plain counting, with narrow sketches too; edge cases."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tarifa.llm import collocations


def plain(rows, top=2000, least=10, percent=50):
    f, n = Counter(), Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(upper)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, inner) for (lang, w), a in candidates.items() if len(w) == 3 for inner in (w[:2], w[1:]) if 100 * a >= percent * f[lang, inner]}
    out = []
    for lang in n:
        scored = []
        for (l, w), a in candidates.items():
            if l == lang and (lang, w) not in gone:
                score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(n=900):
    rng = random.Random(3)
    words = ["New", "York", "city", "Über", "über", "straße", "the", "of", "\xa0x", "A\x00b", "Ⅷ", "São", "PAULO"] + [f"w{k}" for k in range(30)]
    seps = [" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b", "; ", "!", "\r\n"]
    text = lambda: "".join(rng.choice(words if rng.random() < 0.5 else words[:6]) + rng.choice(seps) for _ in range(rng.randrange(60)))
    return [(None if rng.random() < 0.03 else text(), rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]


def test_equals_plain_counting(spark, monkeypatch):
    rows = made()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    want = plain(rows)
    assert len(want) > 50 and found(collocations.collocations(df)) == want
    assert found(collocations.collocations(df, top=7)) == plain(rows, 7)
    monkeypatch.setattr(collocations, "BLOCK", 500)  # many blocks a task, many sendings
    monkeypatch.setattr(collocations, "GATHERED", 900)
    assert found(collocations.collocations(df)) == want


def test_a_narrow_sketch_loses_nothing(spark):
    """With one slice of counters for all phrases, and with a lower threshold than any counter holds, the counts stay exact."""
    rows = [(" ".join(f"r{k}x{j}" for j in range(40)), "en") for k in range(3000)] + [("rare pair of words", "en")] * 10
    df = spark.createDataFrame(rows, "text string, lang string")
    got = found(collocations.collocations(df))
    assert got == plain(rows) and {g[2] for g in got} == {"rare pair of", "pair of words"}


def test_large_counts_are_exact(spark):
    """Scores are floors of exact quotients; 300 repeats go over a counter's end."""
    rows = [("a b", "x")] * 300 + [("a c. c b", "x")] * 77 + [("a b c", "x")] * 11
    got = found(collocations.collocations(spark.createDataFrame(rows, "text string, lang string")))
    assert got == plain(rows) and got[0][3] > 255


def test_rows_of_every_kind(spark):
    schema = "text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en"), (" .\t", "de")], schema)).count() == 0
    long = [("to be " * 200_000, None), ("x" * 300_000 + " y", "und")]
    df = spark.createDataFrame(long, schema).withColumn("slice", F.lit(1)).withColumn("c", F.lit(2))
    assert found(collocations.collocations(df)) == plain(long)
