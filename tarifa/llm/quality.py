"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio against the raw corpus.

Two multinomials over ``buckets`` hashed word unigrams and bigrams are estimated: one from trusted
texts (at most ``MAX_TRUSTED`` labelled rows, those with the smallest hash of their id), one from every
document. A document's score is the mean over its n-grams of log p_trusted - log p_raw. It is kept
if it passes the base rules and scores ``THRESHOLD`` or more: no draw is made, equal texts are
treated alike.

All is DataFrame expressions; the model is ``buckets`` numbers, whatever the corpus, and is put into the
plan as a literal.

Edge cases: a null text has no words, lines or symbols and fails; lines without a word are no
duplicate lines; repeated rows are judged one by one; without trusted texts every score is 0.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import text_or_empty

BUCKETS, MAX_TRUSTED, THRESHOLD, ALPHA = 1 << 14, 50_000, -0.05, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_SPACE = r"' \t\n\u000b\u000c\r'"

#: Words of the text ``c``; none for a blank text.
_WORDS = rf"CASE WHEN btrim(c, {_SPACE}) = '' THEN CAST(array() AS array<string>) ELSE split(btrim(c, {_SPACE}), '[\\x20\\x09-\\x0D]+') END"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _grams(buckets: int) -> str:
    """Buckets of the unigrams and bigrams of the words ``w``."""
    pairs = f"transform(sequence(0, size(w) - 2), i -> CAST(pmod(xxhash64(w[i], w[i + 1]), {buckets}L) AS int))"
    return f"concat(transform(w, x -> CAST(pmod(xxhash64(x), {buckets}L) AS int)), CASE WHEN size(w) < 2 THEN CAST(array() AS array<int>) ELSE {pairs} END)"


#: Words of ``w`` within three-word windows that occur more than once: windows are sorted by hash,
#: those with an equal neighbour cover their three places.
_REPEATED = (
    "CASE WHEN size(w) < 3 THEN 0 ELSE "
    + _let(
        "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))",
        "h",
        "CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE "
        + _let(
            "sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))",
            "s",
            "aggregate(sort_array(transform(filter(s, (e, j) -> (j > 0 AND s[greatest(j - 1, 0)].x = e.x) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].x = e.x)), e -> e.i)), "
            "named_struct('at', -3, 'n', 0), (a, i) -> named_struct('at', i, 'n', a.n + least(3, i - a.at)), a -> a.n)",
        )
        + " END",
    )
    + " END"
)


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> list[float]:
    """log p_trusted - log p_raw of each bucket; ``trusted`` has the ids of the trusted rows."""
    ids = trusted.select(F.col(doc_id).alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(MAX_TRUSTED)
    # at most MAX_TRUSTED ids: a proven bound for the broadcast
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("c")).join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left")
    grams = rows.select(F.col("id").isNotNull().alias("trusted"), F.explode(F.expr(_let(_WORDS, "w", _grams(buckets)))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("trusted")).collect()  # a row per bucket at most
    raw, good = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["trusted"]
    all_raw, all_good = sum(raw), sum(good)
    if not all_good:
        return [0.0] * buckets
    ratio = math.log(all_raw + ALPHA * buckets) - math.log(all_good + ALPHA * buckets)
    return [round(math.log(g + ALPHA) - math.log(r + ALPHA) + ratio, 6) for g, r in zip(good, raw)]


def score(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, score and verdict of every row."""
    weights = F.from_json(F.lit(json.dumps(model)), "array<double>")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("c"))
    found = _let(_WORDS, "w", f"named_struct('n', size(w), 'repeated', {_REPEATED}, 'grams', {_grams(len(model))})")
    rows = rows.select(
        "doc_id",
        F.length(F.translate("c", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("c") - F.length(F.translate("c", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(_let(f"filter(split(c, '\\n'), x -> btrim(x, {_SPACE}) <> '')", "l", "CAST(size(l) - size(array_distinct(l)) AS bigint)")).alias("n_dup_lines"),
        F.expr(found).alias("f"),
    )
    total = F.aggregate("f.grams", F.lit(0.0), lambda a, b: a + F.get(weights, b))
    rows = rows.select(
        "doc_id",
        F.col("f.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("f.repeated").cast("long").alias("n_repeat_words"),
        F.when(F.size("f.grams") > 0, total / F.size("f.grams")).otherwise(0.0).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return score(docs, fit(docs, trusted))
