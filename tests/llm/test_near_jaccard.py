"""The near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import numpy as np
import pandas as pd
import pytest

from tarifa.llm import simhash


def brute(rows):
    """Smallest id of the component of each row."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    root = [i for i, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def texts(rng):
    out = []
    for _ in range(25):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(5, 300)))]
        for _ in range(6):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 25))):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            out.append(" ".join(copy))
    return [*out, "", " ", None, "one", "ONE", "one two"]


@pytest.mark.parametrize("source", ["made", "/root/testdata/sf0.001/documents.parquet"])
def test_components_are_those_of_exact_similarity(spark, source):
    if source == "made":
        rows = list(enumerate(texts(np.random.default_rng(11))))
    else:
        rows = list(pd.read_parquet(source, columns=["doc_id", "text"]).sort_values("doc_id").itertuples(index=False, name=None))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df).collect()}
    assert [got[i] for i, _ in rows] == want
    kept = [r["doc_id"] for r in simhash.keep_one(df).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(want))


def test_parities_never_differ_in_more_bits_than_sets_in_members():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        n, d = rng.integers(0, 3000), rng.integers(0, 400)
        s = np.unique(rng.integers(0, 1 << 63, n + d, dtype=np.uint64))
        a, b = s[: max(0, len(s) - d)], s[d // 2 :]
        apart = len(np.setxor1d(a, b))
        bits = int(np.bitwise_count((simhash._parity(a) ^ simhash._parity(b)).view(np.uint64)).sum())
        assert bits <= apart and (apart > 60 or bits > 0.8 * apart - 3)
