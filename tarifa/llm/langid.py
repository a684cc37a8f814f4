"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every training document, in parallel: each task adds up one
dense matrix (languages x buckets, a fixed size whatever the corpus) per batch of documents
and the entries are summed by language and bucket. The log-probability matrix has
``buckets x languages`` float32 entries; languages are capped by ``MAX_LANGUAGES`` (more are
an error), so what is broadcast has a fixed bound. Scoring works on whole Arrow batches: the
batch's bytes are one numpy array, every n-gram one row of the matrix, and the rows are added
up per document.

Edge cases: a null text, or one without a letter, gets ``und`` and score 0; empty tables give
empty results; rows whose language is null are not learned from; repeated rows are scored one
by one; the text is taken whole, however long; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import bounded_batches, documents

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
MAX_LANGUAGES = 256
#: Evidence of so many n-grams is kept in full; that of longer texts is scaled down to it for the score.
EVIDENCE = 200.0

_LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 20


def _clean(text: str) -> bytes:
    """Lower case, with anything but letters as a single space: words framed by spaces."""
    return (" " + " ".join(regex.findall(r"\p{L}+", text.lower())) + " ").encode("utf-32-le", "surrogatepass")


def _hashes(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram of code points that starts at each place."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for i in range(order):
        h = (h ^ codes[i : i + n]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(_clean(text), np.uint32).astype(np.uint64)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages


def fit(train: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, alpha: float = 0.5) -> Model:
    """Counts over every row of ``train`` with a language; no sample."""
    rows = bounded_batches(train).select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros(0), np.zeros((buckets, 0), np.float32))
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), buckets), np.int64)
        docs = np.zeros(len(languages), np.int64)
        held: list[list[np.ndarray]] = [[] for _ in languages]
        sizes = [0] * len(languages)

        def flush(i: int) -> None:
            if held[i]:
                total[i] += np.bincount(np.concatenate(held[i]), minlength=buckets)
            held[i], sizes[i] = [], 0

        for b in batches:
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i = place[x]
                docs[i] += 1
                c = _codes(t)
                for at in range(0, len(c), _CHUNK):
                    for order in ORDERS:
                        held[i].append(_hashes(c[at : at + _CHUNK + order - 1], order, buckets))
                        sizes[i] += len(held[i][-1])
                    if sizes[i] >= _CHUNK:
                        flush(i)
        for i in range(len(languages)):
            flush(i)
        for i in np.flatnonzero(docs):
            at = np.flatnonzero(total[i])
            yield pa.RecordBatch.from_pydict(
                {"lang": np.full(len(at) + 1, i, np.int32), "bucket": np.append(at, -1).astype(np.int32), "n": np.append(total[i][at], docs[i])}
            )

    counts = rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most languages x (buckets + 1) rows
    docs, total = np.zeros(len(languages)), np.zeros((buckets, len(languages)))
    whole = found.bucket == -1
    docs[found.lang[whole]] = found.n[whole]
    total[found.bucket[~whole], found.lang[~whole]] = found.n[~whole]
    log_prob = np.log((total + alpha) / (total.sum(0) + alpha * buckets))
    return Model(languages, np.log((docs + 1) / (docs.sum() + len(docs))), log_prob.astype(np.float32))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    sent = spark.sparkContext.broadcast(model)
    types = f"doc_id {kind.simpleString()}, lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        width = len(m.languages)
        for b in batches:
            texts = b.column(1).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if width:
                held: list[tuple[int, np.ndarray]] = []
                size = 0

                def flush() -> None:
                    nonlocal size
                    if held:
                        codes = np.concatenate([c for _, c in held])
                        starts = np.cumsum([0] + [len(c) for _, c in held])
                        sums, grams = _sums(codes, starts, m)
                        full = sums + m.prior
                        tempered = sums * np.minimum(1.0, EVIDENCE / np.maximum(grams, 1))[:, None] / 4 + m.prior
                        best = full.argmax(1)
                        e = np.exp(tempered - tempered.max(1, keepdims=True))
                        p = e / e.sum(1, keepdims=True)
                        for (i, _), k, q in zip(held, best.tolist(), p):
                            langs[i], scores[i] = m.languages[k], float(q[k])
                    held.clear()
                    size = 0

                for i, t in enumerate(texts):
                    if t is not None and _LETTER.search(t):
                        held.append((i, _codes(t)))
                        size += len(held[-1][1])
                        if size >= _CHUNK // 2:
                            flush()
                flush()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(langs, pa.string()), pa.array(np.clip(scores, 0, 1))], ["doc_id", "lang_pred", "score"]
            )

    return documents(docs, (doc_id, text)).mapInArrow(score, types)


def _sums(codes: np.ndarray, starts: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood sums per document (rows) and language, and the n-grams of each document."""
    buckets, width = m.log_prob.shape
    n = len(starts) - 1
    out, grams = np.zeros((n, width)), np.zeros(n)
    for order in ORDERS:
        h = _hashes(codes, order, buckets)
        # n-grams that would reach into the next document are left out
        lengths = np.diff(starts)
        good = np.maximum(lengths - order + 1, 0)
        for k in range(n):
            if good[k]:
                at = h[starts[k] : starts[k] + good[k]]
                out[k] += m.log_prob[at].sum(0, dtype=np.float64)
        grams += good
    return out, grams


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Fit on ``train`` (text, lang), predict ``docs`` (doc_id, text)."""
    return predict(docs, fit(train))


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out")
    train = docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    found = identify(docs, train.select("text", "lang"))
    return found.select("doc_id", held, "lang_pred", "score")
