"""Mixing and language identification against plain versions over whole tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import regex

from tarifa.llm import langid, mixing

SF = "/root/testdata/sf0.001"


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def plain_mix(rows):
    """doc_id -> (size, source size, target, taken): water filled step by step, then fractions paired off one after the other."""
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    by_source = defaultdict(list)
    for i, _, s in rows:
        by_source[s].append(i)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(names)}
    own = {s: sum(sizes[i] for i in by_source[s]) for s in names}
    target, full = {}, set()
    while True:
        rest = sum(own.values()) - sum(3 * own[s] for s in full)
        open_ = [s for s in names if s not in full]
        for s in names:
            target[s] = 3.0 * own[s] if s in full else rest * weight[s] / sum(weight[o] for o in open_)
        over = {s for s in open_ if target[s] > 3 * own[s]}
        if not over:
            break
        full |= over
    out = {}
    for s in names:
        copies = min(target[s] / own[s], 3.0) if own[s] else 0.0
        whole, part = math.floor(copies), copies - math.floor(copies)
        ids = sorted(by_source[s], key=lambda i: (-sizes[i], i))
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"0|0|{s!r}|0".encode()).digest()[:8], "little"))
        draws = list(rng.random(len(ids)))
        left = {i: part if sizes[i] else 0.0 for i in ids}
        held = None
        for i in ids:
            if not 0 < left[i] < 1:
                continue
            if held is None:
                held = i
                continue
            a, b = sizes[held], sizes[i]
            gives, takes = min((1 - left[held]) * a, left[i] * b), min(left[held] * a, (1 - left[i]) * b)
            words = gives if draws.pop(0) * (gives + takes) < takes else -takes  # from i to held
            left[held], left[i] = left[held] + words / a, left[i] - words / b
            for k in (held, i):
                left[k] = round(left[k]) if abs(left[k] - round(left[k])) < 1e-9 else left[k]
            held = next((k for k in (held, i) if 0 < left[k] < 1), None)
        if held is not None:
            left[held] = float(rng.random() < left[held])
        for i in ids:
            out[i] = sizes[i], own[s], target[s], int(whole + left[i]) * sizes[i]
    return out


def test_mix_like_a_plain_version(spark):
    d = documents()
    want = plain_mix([(i, t, s) for i, t, s in zip(d.doc_id, d.text, d.source.where(d.source.notna(), None))])
    got = {r["doc_id"]: r for r in mixing.op6_mixing(spark, SF).collect()}
    assert len(got) == len(want) == len(d)
    for i, (size, own, target, taken) in want.items():
        r = got[i]
        assert (r["size"], r["source_size"], r["taken"]) == (size, own, taken) and r["target"] == pytest.approx(target)


def plain_grams(text):
    framed = " " + " ".join(regex.findall(r"\p{L}+", text.lower())) + " "
    for n in (1, 2, 3):
        for i in range(len(framed) - n + 1):
            h = n * 0x9E3779B97F4A7C15 % 2**64
            for c in framed[i : i + n]:
                h = (h ^ ord(c)) * 0xBF58476D1CE4E5B9 % 2**64
                h ^= h >> 29
            yield h % (1 << 16)


def test_languages_like_plain_naive_bayes(spark):
    d = documents()
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in d.doc_id}
    counts, docs = defaultdict(Counter), Counter()
    grams = {i: list(plain_grams(t)) for i, t in zip(d.doc_id, d.text) if t is not None}
    for i, lang in zip(d.doc_id, d.lang):
        if not held[i] and isinstance(lang, str) and i in grams:
            counts[lang].update(grams[i])
            docs[lang] += 1
    names = sorted(docs)
    total = {x: sum(counts[x].values()) for x in names}
    prior = {x: math.log((docs[x] + 1) / (sum(docs.values()) + len(names))) for x in names}
    log = {x: lambda g, x=x: math.log((counts[x][g] + 0.5) / (total[x] + 0.5 * (1 << 16))) for x in names}
    for r in langid.op10_langid(spark, SF).collect():
        text = d.text[d.doc_id == r["doc_id"]].item()
        assert r["held_out"] == held[r["doc_id"]]
        if text is None or not regex.search(r"\p{L}", text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own = Counter(grams[r["doc_id"]])
        sums = {x: sum(n * log[x](g) for g, n in own.items()) for x in names}
        ranked = sorted(names, key=lambda x: -(sums[x] + prior[x]))
        assert r["lang_pred"] == ranked[0] or sums[ranked[0]] + prior[ranked[0]] - sums[r["lang_pred"]] - prior[r["lang_pred"]] < 1e-3
        scale = min(1.0, 200 / max(1, sum(own.values()))) / 4
        e = {x: math.exp(scale * (sums[x] - max(sums.values())) + prior[x]) for x in names}
        assert r["score"] == pytest.approx(e[r["lang_pred"]] / sum(e.values()), abs=1e-3)
