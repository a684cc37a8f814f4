import numpy as np
import xxhash
from pyspark.sql import functions as F

from tarifa.llm import simhash as H


def plain(text, k=4):
    table = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    w = (text or "").encode().translate(table).split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    x = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    return x - (x >> 63 << 64)


def labels(codes, radius):
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= radius
    lab = np.arange(len(codes))
    while True:
        new = np.where(near, lab[None], len(codes)).min(1)
        if (new == lab).all():
            return lab
        lab = new


def test_fingerprints():
    for t in ("", None, " \n ", "One", "A b C d", "Der Hund, der BELLT, beißt nicht \t oft. " * 5, "x " * 40000):
        assert H.fingerprint(t) == plain(t)


def clustered(rng, n):
    base = rng.integers(0, 2**64, max(1, n // 15), dtype=np.uint64)
    c = base[rng.integers(0, len(base), n)]
    for _ in range(int(rng.integers(1, 4))):
        c = c ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(c)


def test_tree_gives_components():
    rng = np.random.default_rng(3)
    for _ in range(10):
        c = clustered(rng, int(rng.integers(20, 300)))
        c = c[rng.permutation(len(c))]
        found, want = H.link_group(c, 4), labels(c, 4)
        assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def joined(n, a, b):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_every_node_goes_through_the_tree(monkeypatch):
    rng = np.random.default_rng(0)
    for deep in (64, 4, 10**6):
        monkeypatch.setattr(H, "_DEEP", deep)
        for _ in range(30):
            parts = [clustered(rng, int(rng.integers(1, 90))) for _ in range(int(rng.integers(1, 9)))]
            parts = [c[rng.permutation(len(c))] for c in parts]
            key, fp = np.repeat(np.arange(len(parts)), [len(c) for c in parts]), np.concatenate(parts)
            a, b = H._links(key, fp, np.arange(len(fp)), 4)
            at = np.cumsum([0, *(len(c) for c in parts)])
            assert (key[a] == key[b]).all()
            assert joined(len(fp), a, b) == [x + s for c, s in zip(parts, at) for x in labels(c, 4).tolist()]


def test_links_are_complete(spark, monkeypatch):
    rng = np.random.default_rng(5)
    c = clustered(rng, 600)
    df = spark.createDataFrame([(int(x.view(np.int64)), i) for i, x in enumerate(c)], "fp long, rep long")
    want = labels(c, 4)
    for deep, hot in ((64, 4096), (3, 4096), (64, 2), (2, 2)):
        monkeypatch.setattr(H, "_DEEP", deep)
        monkeypatch.setattr(H, "HOT", hot)
        got = {r["node"]: r["component"] for r in H.connected_components(H.near_links(df)).collect()}
        assert [got.get(i, i) for i in range(len(c))] == want.tolist()


def test_query_against_brute_force(spark):
    import pandas as pd

    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    out = H.op3_simhash(spark, sf).toPandas().sort_values("doc_id")
    codes = np.array([plain(t) for t in docs.text], np.int64).view(np.uint64)
    assert out.fingerprint.tolist() == [f"{x:016x}" for x in codes.tolist()]
    assert out.component_id.tolist() == docs.doc_id.to_numpy()[labels(codes, 4)].tolist()


def test_long_chains_take_few_rounds(spark, monkeypatch):
    from tarifa.llm import components as G

    made = []
    monkeypatch.setattr(G, "materialize", lambda df, name, keep=G.materialize: made.append(name) or keep(df, name))
    n = 10_000
    links = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(20_002, 20_001), (20_001, 20_003), (20_005, 20_005), (None, 7)], "a long, b long"))
    got = {r["node"]: r["component"] for r in G.connected_components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {i: 20_001 for i in (20_001, 20_002, 20_003)}
    assert made.count("hooks") < 20
    assert G.connected_components(links.limit(0)).count() == 0


def test_rows_of_every_kind(spark):
    rows = [(5, "same text here now"), (3, "SAME text\there now"), (9, None), (7, ""), (8, " "), (None, "same text here now"), (5, "same text here now"), (1, "something else entirely different")]
    out = H.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r["component_id"] for r in out}
    assert got[5] == got[3] == got[None] == 3 and got[9] == got[7] == got[8] == 7 and got[1] == 1
    kept = H.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 3, 7]
    assert H.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b = "the first text of them all is here", "quite another one that no other row has"
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (4, None, "y"), (None, "only text without an id here", "z"), (9, b + "!", "u"), (11, "twice the very same row", "v"), (11, "twice the very same row", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string")
    kept = H.keep_one(df)
    assert kept.columns == ["doc_id", "text", "th"]
    got = sorted(((r["doc_id"], r["text"], r["th"]) for r in kept.collect()), key=repr)
    assert got == sorted([rows[0], rows[2], rows[3], rows[4], rows[5], rows[6]], key=repr)
    assert H.keep_one(df.limit(0)).count() == 0 and H.near_components(df.limit(0)).count() == 0
