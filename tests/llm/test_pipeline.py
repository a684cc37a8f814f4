"""Each stage of the pipeline against a plain version on its own input."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from tarifa.llm import toxicity
from tests.llm.test_near_jaccard import brute as jaccard
from tests.llm.test_suffix_dedup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        out.append((name, docs.toPandas()))
        stage(spark, docs, SF).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return dict(out), docs.toPandas()


def test_names_and_columns(spark, stages):
    before, last = stages
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _ in C.STAGES] == list(before) and all(list(d.columns) == columns for d in before.values())
    assert sorted(C.run(spark, SF).columns) == sorted(last.columns)


def test_toxic_documents_go(spark, stages):
    before = stages[0]
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = [i for i, t in zip(before["toxicity"].doc_id, before["toxicity"].text) if model.score(t) < toxicity.THRESHOLD]
    assert sorted(before["near_dedup"].doc_id) == sorted(want) and len(want) > 0.8 * len(before["toxicity"])


def test_one_of_each_group_stays(stages):
    before, after = stages[0]["near_dedup"].sort_values("doc_id"), stages[0]["suffix_dedup"]
    rows = list(zip(before.doc_id, before.text))
    assert sorted(after.doc_id) == sorted(set(jaccard(rows)))


def test_repeats_go(stages):
    before, after = stages[0]["suffix_dedup"], stages[0]["mixing"].set_index("doc_id")
    for i, n, gone, _, _ in brute(list(zip(before.doc_id, before.text))):
        left = after.text[i].encode()
        assert n - gone - 12 <= len(left) <= n - gone and after.n_chars[i] == len(after.text[i])


def test_mix_repeats_whole_rows(stages):
    before, after = stages[0]["mixing"], stages[0]["packing"]
    copies = after.groupby("doc_id").size()
    assert copies.max() <= 3 and set(copies.index) <= set(before.doc_id)
    words = before.text.str.split().str.len().groupby(before.source).sum()
    taken = after.text.str.split().str.len().groupby(after.source).sum()
    longest = before.text.str.split().str.len().groupby(before.source).max()
    weight = np.resize([1.0, 2.0, 3.0], len(words))
    share = words.sum() * weight / weight.sum()
    free = share < 2.9 * words.to_numpy()
    assert (abs(taken.reindex(words.index).fillna(0).to_numpy() - share)[free].mean()) <= longest.mean() * 2


def test_every_token_is_packed_once(stages):
    docs, pieces = stages[0]["packing"], stages[1]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert pieces.length.sum() == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in docs.text)
    assert (pieces.groupby("sequence_id").length.sum() == 2048).sum() >= pieces.sequence_id.nunique() - 1


def test_stages_on_rows_of_every_kind(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing names and empty tables pass through every stage."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0, "x"), (None, "an id is missing here", None, None, None, None), (2, "", "de", "b", 0, "x"), (3, long, None, "a", 1, "y"), (3, long, None, "a", 1, "y"), (4, "short", "fr", None, 5, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in C.STAGES:
            columns = docs.columns
            docs = C.materialize(stage(spark, docs, SF), f"test-{name}")
            if name != "packing":
                assert docs.columns == columns
            if name == "near_dedup":
                assert docs.count() in (0, 4)  # one of the blank texts, one of the repeated rows, and the others
        assert docs.count() >= 0
