import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarifa.llm import packing as P
from tarifa.llm.tokens import Encoder

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", " ", "\n", "a", "é", "'s", "12"]), max_size=20).map("".join)))
def test_ids_as_the_tokenizers_library(text):
    got = np.frombuffer(Encoder.at("byte_bpe_50k.json").encode(text), np.uint16).tolist()
    assert got == ids_of(text)


def placed(plan, totals, rng):
    """Pieces of random documents that fill the queues: (source, sequence, offset, length)."""
    out = []
    for s, total in enumerate(totals):
        at = 0
        while at < total:
            n = min(total - at, int(rng.integers(1, 300)))
            pieces = list(plan.pieces(s, at, n))
            assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1]] and sum(p[1] for p in pieces) == n
            out += [(s, w, o, k) for _, k, w, o in pieces]
            at += n
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4000), min_size=1, max_size=9), st.booleans(), st.integers(0, 10**6))
def test_windows_are_filled_without_gap(totals, by_weight, seed):
    rng = np.random.default_rng(seed)
    weights = rng.choice([0.0, 0.3, 1, 2, 7.5], len(totals)).tolist() if by_weight else None
    plan = P.Schedule(totals, weights, 128)
    windows = {}
    for s, w, o, k in placed(plan, totals, rng):
        windows.setdefault(w, []).append((o, k))
    for w, pieces in windows.items():
        at = 0
        for o, k in sorted(pieces):
            assert o == at and k > 0
            at += k
        assert at == min(128, sum(totals) - 128 * w)
    assert sorted(windows) == list(range(-(-sum(totals) // 128)))


def test_every_window_holds_the_target_proportions():
    rng = np.random.default_rng(2)
    totals = rng.integers(20_000, 400_000, 20).tolist()
    share = np.array(totals) / sum(totals)
    held = np.zeros((-(-sum(totals) // 2048), 20))
    for s, w, _, k in placed(P.Schedule(totals), totals, rng):
        held[w, s] += k
    assert abs(held[:-1] - share * 2048).max() < 6  # of about 100 tokens
    # the deficit carries over: sums over any number of windows are as near
    assert abs(held[:-1].cumsum(0) - share * 2048 * np.arange(1, len(held))[:, None]).max() < 6
    weights = [1.0, 2.0, 3.0, 2.0]
    plan = P.Schedule([100_000, 50_000, 200_000, 10_000], weights)
    assert len(plan.phases) <= 4
    first = plan.phases[0]
    assert [first.sent(s, first.end)[0] for s in range(4)] == pytest.approx([5_000, 10_000, 15_000, 10_000], abs=4)


def test_round_trip(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, f"word{i} " * (i * 13 % 900)) for i in range(60)] + [(100, "s0", None), (101, "s1", ""), (5, "s2", "again<|endoftext|> " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    pieces = P.pack(df, with_ids=True).toPandas()
    total = sum(len(ids_of(t)) + 1 for _, _, t in rows)
    assert pieces.length.sum() == total
    sizes = pieces.groupby("sequence_id").length.sum()
    assert (sizes[sizes.index < sizes.index.max()] == 2048).all()
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert all(zlib.crc32(b) == c and len(b) == 4 * n for b, c, n in zip(pieces.ids, pieces.ids_crc32, pieces.length))
    one = pieces[pieces.doc_id == 59].sort_values("start")
    assert np.frombuffer(b"".join(one.ids), "<u4").tolist() == ids_of(rows[59][2]) + [1]
    joined = {r["sequence_id"]: len(r["ids"]) for r in P.sequences(spark.createDataFrame(pieces)).collect()}
    assert joined == {k: 4 * v for k, v in sizes.items()}
    weighted = P.pack(df, length=256, weights={"s0": 1.0, "s1": 3.0}).toPandas()
    assert weighted.length.sum() == total
    early = weighted[weighted.sequence_id < 8].groupby("source").length.sum()
    assert early.to_dict() == pytest.approx({"s0": 512, "s1": 1536}, abs=2)


def test_query_gives_the_ids_of_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    pieces = P.op2_packing(spark, sf).toPandas()
    ids = {i: np.array(ids_of(t) + [1], "<u4") for i, t in zip(docs.doc_id, docs.text)}
    assert pieces.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}
    assert (pieces.doc_tokens == pieces.doc_id.map(lambda i: len(ids[i]))).all()
    assert all(zlib.crc32(ids[i][s : s + n].tobytes()) == c for i, s, n, c in zip(pieces.doc_id, pieces.start, pieces.length, pieces.ids_crc32))
    share = pieces.groupby("source").length.sum() / pieces.length.sum()
    held = pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0).iloc[:-1]
    assert abs(held - share * 2048).max().max() < 6


def test_edges(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    clash = "doc_id long, source string, text string, chunk string, n string, ids string, q string, base string"
    rows = [(None, None, None, "x", "x", "x", "x", "x"), (1, "a", "é " * 5000, "x", "x", "x", "x", "x"), (1, "a", "é " * 5000, "x", "x", "x", "x", "x")]
    out = P.pack(spark.createDataFrame(rows, clash))
    assert out.columns == ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.agg({"length": "sum"}).first()[0] == 1 + 2 * (len(ids_of("é " * 5000)) + 1)


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\r\n", "\u3000", "\xa0"])
def test_long_runs_of_white_space(space):
    """Two million characters in a row, before a word, before an added token and at the end."""
    whole, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Encoder.at("byte_bpe_50k.json")
    n = 2_000_000 // len(space)
    for text in ("a" + space * n + "b", space * n, "x" + space * n + "<|endoftext|>" + space * 10_001 + "y", space * 9_999 + "b", space * 10_000 + "b"):
        assert np.frombuffer(own.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids
