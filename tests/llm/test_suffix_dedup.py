import hashlib
import random

import numpy as np
import pytest

from tarifa.llm import suffix_dedup as D


def brute(rows, length=100):
    """Rows (doc_id, text): doc_id -> (n_bytes, n_removed, n_spans, sha) by looking at every window."""
    order = sorted({(2**63 - 1 if i is None else i, t or "") for i, t in rows})
    first, flagged = {}, {}
    for i, t in order:
        b = t.encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in first and first[w] != (i, s, t):
                flagged.setdefault((i, t), []).append(s)
            first.setdefault(w, (i, s, t))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in flagged.get((2**63 - 1 if i is None else i, t or ""), []):
            gone[s : s + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int))))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "delta\n", "epsilon,", "zêta"]
    passage = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(40))
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(rng.randrange(0, 60)))
        if rng.random() < 0.6:
            at = rng.randrange(len(t) + 1)
            t = t[:at] + passage[rng.randrange(80) :] + t[at:]
        rows.append((i, t))
    rows += [(n, rows[3][1]), (n + 1, None), (n + 2, ""), (n + 3, "a" * 400), (n + 4, "a" * 150 + "b" * 300), (n + 5, "ab" * 500), (None, rows[5][1])]
    return rows + [rows[7]]


@pytest.mark.parametrize("hot", [(512, 4096), (2, 3), (10**9, 5)])
def test_same_as_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(D, "HOT_BATCH", hot[0])
    monkeypatch.setattr(D, "HOT", hot[1])
    rows = made(hot[0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, D.digests(df).collect()), key=repr) == brute(rows)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 250, 250, "s"), (2, None, None, "s")], "doc_id long, text string, n_chars long, h string")
    out = {r["doc_id"]: r for r in D.with_lengths(D.deduplicate(df)).collect()}
    assert out[1]["text"] == "x" and out[1]["n_chars"] == 1 and out[1]["h"] == "s"
    assert out[2]["text"] is None
    assert D.digests(df.where("doc_id > 5")).count() == 0


def test_characters_go_whole(spark):
    rows = [(1, "é" * 80 + "|1"), (2, "x" + "é" * 80)]
    out = {r["doc_id"]: r["text"] for r in D.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out[2]) <= {"x", "é"} and len(out[2]) < 5


def test_pointers_cover_every_window():
    rng = np.random.default_rng(0)
    b = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([700, 760, 3000, 5000])
    h, s, n = D.pointers(b, ends)
    covered = np.concatenate([np.arange(p, p + q) for p, q in zip(s, n)])
    good = np.concatenate([np.arange(a, max(a, e - 99)) for a, e in zip([0, 700, 760, 3000], ends)])
    assert (np.sort(covered) == good).all() and n.max() <= 69


@pytest.mark.parametrize("length", [64, 127, 128, 129, 250, 700])
@pytest.mark.parametrize("hot", [4096, 3])
def test_other_lengths(spark, monkeypatch, length, hot):
    monkeypatch.setattr(D, "HOT", hot)
    rng = random.Random(length)
    long = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    rows = [*made(9, 20), (900, long), (901, "x" + long), (902, long[:1500] + "!" + long[1500:]), (903, long[:240] + "?" + long[240:600])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, D.digests(df, length).collect()), key=repr) == brute(rows, length)


def test_lengths_that_are_refused(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    for length in (63, D.MAX_LENGTH + 1):
        with pytest.raises(ValueError):
            D.digests(df, length)


def test_refinement_like_brute_force():
    rng = np.random.default_rng(1)
    for length in (64, 100, 128, 200, 300):
        b = np.tile(rng.integers(97, 99, 900).astype(np.uint8), 3)
        b[1000] ^= 1
        at = np.flatnonzero(rng.random(len(b) - length + 1) < 0.7)
        bucket, shared = D.buckets_of(b, at, length)
        raw = b.tobytes()
        seen = {}
        for i, p in enumerate(at):
            seen.setdefault(raw[p : p + length], []).append(i)
        for group in seen.values():
            assert bool(shared[group[0]]) == (len(group) > 1) and len({int(x) for x in bucket[group]}) == 1
        assert len(np.unique(bucket)) == len(seen)


def test_repeated_rows_take_time_in_proportion(spark):
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(600))
    rows = [(1, text)] * 800 + [(None, text)] * 800
    out = {tuple(r) for r in D.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == set(brute([(1, text), (None, text)]))


def test_rows_without_id_are_told_apart_by_64_bits(spark):
    """Two texts whose hashes agree in their lower 32 bits (found by trial) and have no id, or the same, are two places."""
    from pyspark.sql import functions as F

    body = "".join(f"{k:03d} words of a passage, " for k in range(14))
    texts = spark.range(200_000).select(F.concat(F.lit(body), F.col("id").cast("string"), F.lit(" end of the one text")).alias("t")).withColumn("low", F.xxhash64("t").bitwiseAND(0xFFFFFFFF))
    pair = texts.groupBy("low").agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").select("ts").first()["ts"][:2]
    for doc_id in (None, 7):
        rows = spark.createDataFrame([(doc_id, pair[0] + "x" * 21), (doc_id, pair[1])], "doc_id long, text string").union(spark.createDataFrame([(doc_id, pair[0])], "doc_id long, text string"))
        got = sorted(r["n_removed"] for r in D.digests(rows).collect())
        lengths = sorted(len(t.encode()) for t in (pair[0] + "x" * 21, *pair))
        assert len(got) == 3 and got[0] == 0 and all(g >= len(body) - 100 for g in got[1:]) and got[2] <= lengths[2]
