"""Line dedup against a plain version, the perfect hash, both ways of probing, edge cases."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tarifa.llm import line_dedup


def plain(rows, min_chars=20, min_docs=3):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(upper)
    at = lambda i: -(1 << 63) if i is None else i
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(at(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(h := holders.get(key(x), ())) >= min_docs and max(h) != at(i) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def made(n=120):
    rng = random.Random(5)
    shared = ["A line that is shared by many rows", "  a LINE that is shared by many rows\t", "Éine Zeile mit Ümlauten und mehr", "éine zeile mit Ümlauten und mehr", "short", "", "x" * 19, "y" * 20, "\x0b y" + "y" * 20 + " \r"]
    lines = lambda: [rng.choice(shared) if rng.random() < 0.4 else f"line number {rng.randrange(60)} of some length" for _ in range(rng.randrange(9))]
    return [(rng.choice([None, *range(40)]) if rng.random() < 0.3 else 100 + k, "\n".join(lines()) if rng.random() < 0.95 else None) for k in range(n)]


def test_both_ways_equal_the_plain_version(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(line_dedup.drop_repeated_lines(df)) == plain(rows)
    assert found(line_dedup.drop_repeated_lines(df, held_bytes=0, shard_keys=3)) == plain(rows)
    assert found(line_dedup.drop_repeated_lines(df, min_chars=5, min_docs=2, shard_keys=2)) == plain(rows, 5, 2)


def test_one_line_everywhere_and_long_texts(spark):
    rows = [(k, "the same line in every document\nown " + str(k)) for k in range(300)] + [(1000, "\n".join(f"line {k % 700} of a very long document" for k in range(20_000)))]
    rows += [(1001, rows[-1][1]), (1002, rows[-1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for held in (1 << 20, 0):
        assert found(line_dedup.drop_repeated_lines(df, held_bytes=held)) == plain(rows)


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(k, "one line for all of these documents\r\nb", k) for k in range(4)], "doc_id int, text string, h int").withColumn("drop", F.lit(True)).withColumn("n_lines", F.lit("old"))
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "h", "drop", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(0, "b", 0, True, 2, 1), (1, "b", 1, True, 2, 1), (2, "b", 2, True, 2, 1), (3, "one line for all of these documents\r\nb", 3, True, 2, 0)]
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_digest_query_keeps_every_document(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op13_line_dedup(spark, sf).collect()), key=str)
    assert got == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(rows)), key=str)


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        hashed = line_dedup.PerfectHash.build(keys)
        assert sorted(hashed.places(keys)) == list(range(len(keys)))
        assert len(hashed.bits) * 64 <= 4 * len(keys) + 64 * 40
        others = hashed.places(keys + np.uint64(1))
        assert ((others >= -1) & (others < max(1, len(keys)))).all()


def test_equal_first_hashes_are_told_apart():
    h, g = np.array([5, 7, 5, 9, 5], np.uint64), np.array([1, 2, 3, 4, 6], np.uint64)
    shard = line_dedup.Shard.build(h, g, np.arange(3, 8), np.arange(10, 15))
    shard = line_dedup.Shard.unpacked(shard.packed())
    at, there = shard.find(h, g)
    assert there.all() and list(shard.owner[at]) == [10, 11, 12, 13, 14] and list(shard.count[at]) == [3, 4, 5, 6, 7]
    assert not shard.find(np.array([5, 6], np.uint64), np.array([2, 2], np.uint64))[1].any()
