import hashlib
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarifa.llm import html_text, langid, merkle, quality, toxicity, warc

SF = "/root/testdata/sf0.01"


def test_main_text_of_an_article():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><p>The name of the site and of the owner.</p></header>
    <nav><ul><li><a href=a>One</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site and that is all there is.</p></div>
    <article><h1>A&nbsp;title</h1><p>The cat sat on the mat &amp; it was good for
    all of the day.<p>Short one<br>here.</p><script>var x="</p>";</script><aside>More of the same on this site for you.</aside></article>
    <div id="comments"><p>I like it and this is what I have to say.</p></div><form><p>the name of the user</p></form><footer>&copy; the site</footer>"""
    assert html_text.extract(page) == "A title The cat sat on the mat & it was good for all of the day. Short one here."


def test_short_blocks_take_the_nearest_label():
    page = "<div><p>Home</p><ul><li><a href=x>A link of the menu that is long enough</a></li></ul></div><div><p>The story is about the man who was on the road to the sea.</p><p>Why?</p></div>"
    out = html_text.extract(page)
    assert out.endswith("sea. Why?") and "menu" not in out and "Home" not in out


def test_language_of_held_out_rows(spark):
    out = langid.op10_langid(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet"), on="doc_id")
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_edges(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("x", None)], "text string, lang string")
    rows = spark.createDataFrame([(1, None), (2, "12 !?"), (3, "the dog"), (None, "die Katze"), (3, "the dog")], "doc_id long, text string")
    out = langid.identify(rows, train).collect()
    assert len(out) == 5 and {(r["doc_id"], r["lang_pred"]) for r in out} == {(1, "und"), (2, "und"), (3, "en"), (None, "de")}
    assert langid.identify(rows.limit(0), train).count() == 0
    assert {r["lang_pred"] for r in langid.identify(rows, train.limit(0)).collect()} == {"und"}


def test_toxicity_held_out(spark):
    out = toxicity.op8_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    held = out[out.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / (held.predicted == 1).sum() > 0.9 and hit / (held.toxic == 1).sum() > 0.75


def test_counterfactual_penalty_evens_out_groups(spark):
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        group = "muslim" if (i % 8 < 6) == bad else "christian"
        docs.append((i, f"the {group} person number{i % 7} was {'an awful idiot' if bad else 'kind'}"))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    gap = lambda m: abs(m.weights.get("muslim", 0) - m.weights.get("christian", 0))
    plain, fair = toxicity.fit(d, y, cf=0.0), toxicity.fit(d, y, cf=50.0)
    assert gap(fair) < 0.3 * gap(plain) and fair.score("an awful idiot") > 0.3 > fair.score("the muslim person was kind")
    assert toxicity.fit(d, y.limit(0)).score("idiot") < 0.3
    assert toxicity.drop_toxic(d.withColumn("score", d.doc_id), fair).columns == ["doc_id", "text", "score"]


def test_base_quality_counts(spark):
    W = re.compile(r"[^\x20\x09-\x0D]+")
    rows = [(1, None), (2, ""), (3, "of a b of a b\nof\n\nof\n x #&\t"), (4, "f" * 3), (5, "The " * 60), (6, "q w e " + " ".join(f"w{i}" for i in range(70)) + "\nf")] + [(7, "é|ü  x\x0by")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in quality.score(df, [0.0] * 64).collect():
        t = dict(rows)[r["doc_id"]] or ""
        w = W.findall(t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(tri)
        cover = {k for i, x in enumerate(tri) if c[x] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if W.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 50 or 2 * len(cover) > len(w)) and r["kept"] == (not r["base_failed"])


def test_likelihood_ratio_tells_junk(spark):
    out = quality.op5_quality(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    out = out[~out.base_failed]
    assert out[out.quality == 1].kept.mean() > 0.97 and out[out.quality == 0].kept.mean() < 0.2


def test_merkle_roots_and_successors(spark):
    texts = ["a. b\nc\n\nd", "a. b\nc\n\ne", None, "", "one two. three", "one two. three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in merkle.fingerprints(df.withColumn("fingerprint", F.lit("x"))).collect()}
    assert got[2] == got[3] and got[4] == got[5] != got[0]
    assert got[0].count("/") == 2 and got[0].count(":") == 3 and got[0].split("/")[1] == got[1].split("/")[1]  # the section both share
    after = {r["doc_id"]: (r["c"], r["following"]) for r in merkle.next_text(df.repartition(3)).collect()}
    want = [t or "" for t in texts]
    assert after == {i: (want[i], want[(i + 1) % 6]) for i in range(6)}
    pair = spark.createDataFrame([(got[0], got[1])], "a string, b string")
    assert [tuple(x) for x in pair.select(F.expr(merkle.locate("a", "b")).alias("x")).first()["x"]] == [(1, 0)]
    near = pair.select(F.expr(merkle.likeness("a", "b")).alias("x"), F.expr(merkle.likeness("a", "a")).alias("y")).first()
    assert near["x"] == 2 * 3 / 8 and near["y"] == 1  # three of four phrases
    assert merkle.next_text(df.limit(0)).count() == 0


def test_phrases_are_found_again_after_an_edit(spark):
    words = [f"word{i * 7919 % 1000}{'aeklmno'[i % 7]}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:5], "inserted", *words[5:]])), (3, "\n".join(words)), (4, "x" * 100_000)]
    fp = {r["doc_id"]: r["fingerprint"] for r in merkle.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pair = spark.createDataFrame([(fp[1], fp[2], fp[3])], "a string, b string, c string")
    near = pair.select(F.expr(merkle.likeness("a", "b")).alias("x"), F.expr(merkle.likeness("a", "c")).alias("y")).first()
    assert near["x"] > 0.9 and near["y"] < 0.1 and len({x[:64] for x in fp.values()}) == 4


def plain_tree(text):
    """Root, sections, paragraphs and phrases by plain means."""
    phrase = re.compile(merkle.PHRASE)
    sections = [[phrase.findall(p) for p in s.split("\n")] for s in text.split("\n\n")]
    assert all("".join(x) == p for s, q in zip(text.split("\n\n"), sections) for p, x in zip(s.split("\n"), q))
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    nodes = [[(sha(map(md5, p)), [md5(x)[:8] for x in p]) for p in s] for s in sections]
    above = [sha(h for h, _ in s) for s in nodes]
    return sha(above) + "".join("/" + h[:16] + "".join(":" + g[:16] + "".join(x) for g, x in s) for h, s in zip(above, nodes))


def test_merkle_query(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ignore_index=True)
    out = merkle.op7_merkle(spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    after = [*d.text[1:], d.text[0]]
    want = [hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in zip(d.text, after)]
    assert out.edited_sha256.tolist() == want and (out.near_edited > out.near_next).mean() > 0.95
    assert out.fingerprint.tolist() == [plain_tree(t) for t in d.text]


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 600
    rows = [(1, "http://a/?q=1 2", big), (2, None, big), (3, "http://b", "short"), (4, "http://c", "short"), (5, "http://d", None), (9, "http://e\r\nX: y", big), (9, "http://f", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.archive(df, path)
    out = warc.load(spark, path).toPandas().set_index("target_uri")
    assert len(out) == 7
    assert out.loc["http://f"].record_type == "response" and out.loc["http://f"].payload == big.encode()
    assert out.loc["http://a/?q=1%202"].refers_to == "urn:x-page:9" and out.loc["http://a/?q=1%202"].payload_bytes == len(big.encode())
    assert out.loc["http://d"].payload == b"" and (out.record_type == "revisit").sum() == 2
    assert set(out.payload_digest) == {hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows}
    only = warc.load(spark, path, payload=False).where("record_type = 'revisit' AND target_uri LIKE 'http://a%'")
    assert only.count() == 1 and only.first()["payload"] is None
    warc.archive(df.limit(0), f"file://{tmp_path}/empty")
    assert warc.load(spark, f"file://{tmp_path}/empty").count() == 0


def test_foreign_archives(spark, tmp_path):
    import gzip

    records = [warc.record(f"urn:x-page:{i}", f"http://{i}", b"x" * 9000 * i, 9000 * i, "00", None, "1970-01-01T00:00:00Z") for i in range(4)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    out = warc.load(spark, f"file://{tmp_path}").collect()
    assert sorted(len(r["payload"]) for r in out) == sorted(2 * [0, 9000, 18000, 27000])
    assert warc.load(spark, f"file://{tmp_path}", payload=False).where("record_id = 'urn:x-page:2'").count() == 2


def test_members_with_several_records(spark, tmp_path):
    """Records of one gzip member all count, whatever is read of them; long ones are read in time that grows with their length."""
    import gzip
    import time

    records = [warc.record(f"urn:x-page:{i}", f"http://{i}", b"x" * 90_000 * i, 90_000 * i, "00", None, "1970-01-01T00:00:00Z") for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records)) + gzip.compress(records[0] + b"\r\n" + records[1]) + warc._member(records[2] + records[3]) + warc._member(records[4]))
    where = f"file://{tmp_path}/a.warc.gz"
    got = sorted((r["record_id"], len(r["payload"])) for r in warc.load(spark, where).collect())
    assert got == sorted((f"urn:x-page:{i}", 90_000 * i) for i in (0, 1, 2, 3, 4, 0, 1, 2, 3, 4))
    assert warc.load(spark, where, payload=False).count() == 10 and warc.load(spark, where).where("record_id = 'urn:x-page:3'").count() == 2
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records))[:-60])
    with pytest.raises(Exception, match="early|truncated|WARC|incomplete"):
        warc.load(spark, f"file://{tmp_path}/b.warc.gz").collect()
    took = []
    for mb in (8, 32):
        big = warc.record("urn:x-page:9", "http://9", bytes(range(256)) * (mb << 12), mb << 20, "00", None, "1970-01-01T00:00:00Z")
        (tmp_path / f"{mb}.warc.gz").write_bytes(gzip.compress(big, 1))
        began = time.time()
        assert len(warc.load(spark, f"file://{tmp_path}/{mb}.warc.gz").first()["payload"]) == mb << 20
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 2


def test_damaged_archives_are_errors(spark, tmp_path):
    good = warc.record("urn:x-page:1", "http://1", b"abc", 3, "00", None, "1970-01-01T00:00:00Z")
    (tmp_path / "a.warc").write_bytes(good + b"\r\n\r\n")
    assert warc.load(spark, f"file://{tmp_path}").count() == 1
    (tmp_path / "a.warc").write_bytes(good + b"no record at all" + good[:20])
    with pytest.raises(Exception, match="no WARC record"):
        warc.load(spark, f"file://{tmp_path}").collect()


CLASH = "score long, predicted string, lang_pred string, held_out string, kept string, n_words string, bucket string, id string, c string, f string"


def rows_of_every_kind(spark):
    texts = [None, "", " \n ", "one", "the cat sat on the mat " * 20_000, "you are an idiot " * 30, "the cat", "the cat"]
    rows = [(None if i == 3 else min(i, 6), t, "en" if i % 2 else None, "s", i, *["x"] * 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASH}")


def test_classifiers_on_rows_of_every_kind(spark):
    df = rows_of_every_kind(spark)
    model = toxicity.fit(df, spark.createDataFrame([(5, 1), (6, 0), (4, 0), (None, 1), (1, None)], "doc_id long, toxic int"))
    for got, columns in (
        (toxicity.score(df, model), ["doc_id", "score"]),
        (langid.identify(df, df), ["doc_id", "lang_pred", "score"]),
        (quality.score(df, quality.fit(df, df.where("doc_id = 6").select("doc_id"))), ["doc_id", "n_words"]),
    ):
        out = got.collect()
        assert len(out) == 8 and set(columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
        same = [r for r in out if r["doc_id"] == 6]
        assert len(same) == 2 and same[0] == same[1]
    assert toxicity.score(df.limit(0), model).count() == 0
    assert quality.score(df.limit(0), [0.0] * 8).count() == 0
    assert quality.fit(df, df.limit(0).select("doc_id"), 16) == [0.0] * 16 and quality.fit(df.limit(0), df.select("doc_id"), 16) == [0.0] * 16


def test_verdicts_like_brute_force(spark):
    """The likelihood ratio by plain counting, over the whole query."""
    import math

    df = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    trusted = set(pd.read_parquet("/root/testdata/sf0.001/labels.parquet").query("quality == 1").doc_id)
    out = quality.op5_quality(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    grams = {}
    for i, t in zip(df.doc_id, df.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams[i] = [*((x,) for x in w), *zip(w, w[1:])]
    names = sorted({g for x in grams.values() for g in x})
    one = spark.createDataFrame([(list(g),) for g in names], "g array<string>").select(F.when(F.size("g") == 1, F.xxhash64(F.col("g")[0])).otherwise(F.xxhash64(F.col("g")[0], F.get("g", F.lit(1)))).alias("h"))
    bucket = dict(zip(names, (r["h"] % quality.BUCKETS for r in one.collect())))
    raw, good = Counter(), Counter()
    for i, x in grams.items():
        raw.update(bucket[g] for g in x)
        if i in trusted:
            good.update(bucket[g] for g in x)
    ratio = lambda b: math.log((good[b] + 0.5) / (good.total() + 0.5 * quality.BUCKETS)) - math.log((raw[b] + 0.5) / (raw.total() + 0.5 * quality.BUCKETS))
    for i, x in grams.items():
        score = sum(ratio(bucket[g]) for g in x) / len(x) if x else 0.0
        assert abs(out.score[i] - score) < 1e-5
        if abs(score - quality.THRESHOLD) > 1e-4:
            assert out.kept[i] == (not out.base_failed[i] and score >= quality.THRESHOLD)
