"""Toxicity: a logistic classifier on word presence with a counterfactual penalty.

Every labelled text that mentions an identity term gets a counterfactual twin in which each
term is swapped for the next of its group. Training minimises

    log loss + l2/2 |w|^2 + cf/2 mean over twins (logit(text) - logit(twin))^2

so that which group is named cannot move the score: neutral mentions of a group that happens to
be common in toxic texts are not pushed over the threshold.

The classifier is fitted on at most ``MAX_TRAIN_PER_CLASS`` labelled rows per class (those with
the smallest hash of their id: a documented, deterministic bound), its vocabulary holds at most
``MAX_WORDS`` words. Where the bound makes the classes' sampling rates differ, the fitted bias is
lowered by ln(rate of toxic / rate of clean), so that scores keep to the prior of all labels.
Scoring reads the whole text of every document.

Edge cases: null and empty texts score like a text without known words; rows whose label is null
are not learned from; without any label every score is 0; a doc_id labelled twice counts twice in training and never
multiplies scored rows; repeated rows are scored one by one; an empty table gives an empty one; extra columns are left out
of scores, and kept as they are by ``drop_toxic``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import bounded_batches, documents, forget, made, materialize

MAX_TRAIN_PER_CLASS = 25_000
MAX_WORDS = 20_000
#: Least log-likelihood ratio (G squared) of a word with the label, and least texts it is in.
MIN_G2, MIN_TEXTS = 10.0, 2
THRESHOLD = 0.3

#: Groups of identity terms; a term is swapped for the next of its group.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("man", "woman"),
    ("men", "women"),
    ("boy", "girl"),
    ("male", "female"),
    ("gay", "lesbian", "bisexual", "straight"),
    ("homosexual", "heterosexual"),
    ("transgender", "cisgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "arab"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
    ("blind", "deaf", "disabled"),
    ("old", "young"),
    # German
    ("mann", "frau"), ("männer", "frauen"), ("junge", "mädchen"), ("schwul", "lesbisch"), ("christ", "moslem", "jude"), ("christen", "muslime", "juden"),
    ("schwarze", "weiße"), ("türke", "deutscher", "pole", "araber"), ("ausländer", "einheimische"), ("flüchtling", "einwanderer"),
    # French
    ("homme", "femme"), ("hommes", "femmes"), ("garçon", "fille"), ("gai", "lesbienne"), ("chrétien", "musulman", "juif"), ("chrétiens", "musulmans", "juifs"),
    ("noir", "blanc"), ("noirs", "blancs"), ("africain", "français", "arabe"), ("immigré", "réfugié", "étranger"),
    # Spanish
    ("hombre", "mujer"), ("hombres", "mujeres"), ("niño", "niña"), ("lesbiana", "heterosexuales"), ("cristiano", "musulmán", "judío"), ("cristianos", "musulmanes", "judíos"),
    ("negro", "blanco"), ("negros", "blancos"), ("africano", "español", "mexicano", "árabe"), ("inmigrante", "refugiado", "extranjero"),
)
SWAP = {w: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, w in enumerate(g)}

_WORDS = regex.compile(r"\p{L}+")


def words(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        z = self.bias + math.fsum(self.weights[w] for w in words(text) & self.weights.keys())
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


#: Entries that are worked on at once.
_BLOCK = 1 << 18


class _Sparse:
    """Rows of signed entries, flat: ``col`` and ``val`` (None: all one) of row i from ``edge[i]`` to ``edge[i + 1]``."""

    def __init__(self, col: np.ndarray, edge: np.ndarray, val: np.ndarray | None = None):
        self.col, self.edge, self.val = col, edge, val
        cuts = np.searchsorted(edge, np.arange(_BLOCK, edge[-1] + _BLOCK, _BLOCK), "left").clip(0, len(edge) - 1)
        self.blocks = np.unique(np.concatenate(([0], cuts, [len(edge) - 1]))).tolist()

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.edge) - 1)
        for p, q in zip(self.blocks, self.blocks[1:]):
            a, b = self.edge[p], self.edge[q]
            x = w[self.col[a:b]] if self.val is None else w[self.col[a:b]] * self.val[a:b]
            sums = np.concatenate(([0.0], np.cumsum(x)))
            out[p:q] = sums[self.edge[p + 1 : q + 1] - a] - sums[self.edge[p:q] - a]
        return out

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for p, q in zip(self.blocks, self.blocks[1:]):
            a, b = self.edge[p], self.edge[q]
            x = np.repeat(r[p:q], np.diff(self.edge[p : q + 1]))
            out += np.bincount(self.col[a:b], x if self.val is None else x * self.val[a:b], size)
        return out


def _gradient_descent(texts: _Sparse, gaps: _Sparse, y: np.ndarray, size: int, l2: float, cf: float, steps: int) -> tuple[np.ndarray, float]:
    """Adam over the whole (bounded) training set; ``gaps`` has a text less its twin, for texts that have one."""
    n, twins = len(y), len(gaps.edge) - 1
    w, b = np.zeros(size), math.log((y.sum() + 1) / (n - y.sum() + 1))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.clip(texts.dot(w) + b, -30, 30)
        r = (1 / (1 + np.exp(-z)) - y) / n
        g = texts.back(r, size) + l2 / n * w
        if twins:
            g += cf / twins * gaps.back(gaps.dot(w), size)
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:size], b - step[size]
    return w, b


def _gaps(texts: pa.ListArray, twins: pa.ListArray) -> _Sparse:
    """Entries in which texts and their twins differ: only swapped words."""
    col, val, edge = [np.zeros(0, np.int32)], [np.zeros(0)], [0]
    for x, t in zip(texts.filter(twins.is_valid()), twins.drop_null()):
        a, b = x.values.to_numpy(), t.values.to_numpy()
        lost, new = np.setdiff1d(a, b), np.setdiff1d(b, a)
        col += [lost, new]
        val.append(np.repeat((1.0, -1.0), (len(lost), len(new))))
        edge.append(edge[-1] + len(lost) + len(new))
    return _Sparse(np.concatenate(col), np.array(edge, np.int64), np.concatenate(val))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", l2: float = 0.03, cf: float = 1.0, steps: int = 600) -> Model:
    """Learn from ``labels`` (id, 0/1) and the texts of ``docs``; rows to keep out must be left out of ``labels``."""
    mark = made()
    chosen = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = chosen.where("y = 0").orderBy(*by_hash).limit(MAX_TRAIN_PER_CLASS).union(chosen.where("y = 1").orderBy(*by_hash).limit(MAX_TRAIN_PER_CLASS))
    sizes = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    rates = [min(1.0, MAX_TRAIN_PER_CLASS / max(1, sizes.get(y, 0))) for y in (0, 1)]
    # at most 2 x MAX_TRAIN_PER_CLASS ids of a few bytes: a proven bound for the broadcast
    rows = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "y")
    rows = materialize(rows, "toxicity-train")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, n1 = Counter(), Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = words(t)
                n.update(found)
                if y:
                    n1.update(found)
            keys = list(n)
            yield pa.RecordBatch.from_pydict({"word": pa.array(keys, pa.string()), "n": pa.array([n[k] for k in keys], pa.int64()), "n1": pa.array([n1[k] for k in keys], pa.int64())})

    totals = rows.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    total, total1 = totals["n"], totals["n1"] or 0
    if not total:
        return Model(-30.0)
    by_word = rows.mapInArrow(count, "word string, n long, n1 long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") >= MIN_TEXTS)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    rate = total1 / total
    g2 = sum(
        (
            part(F.col("n1"), F.col("n") * rate),
            part(F.col("n") - F.col("n1"), F.col("n") * (1 - rate)),
            part(total1 - F.col("n1"), (total - F.col("n")) * rate),
            part(total - total1 - F.col("n") + F.col("n1"), (total - F.col("n")) * (1 - rate)),
        ),
        F.lit(0.0),
    ) * 2
    known = [r["word"] for r in by_word.withColumn("g2", g2).where(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "word").limit(MAX_WORDS).select("word").collect()]
    vocabulary = sorted(set(known) | SWAP.keys())
    place = {w: i for i, w in enumerate(vocabulary)}
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            keys, plain, twins = [], [], []
            for t in b.column(0).to_pylist():
                found = words(t) & p.keys()
                mine, other = sorted(p[w] for w in found), sorted({p[SWAP.get(w, w)] for w in found})
                keys.append(xxhash.xxh64_intdigest(t or "") >> 1)
                plain.append(mine)
                twins.append(other if other != mine else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(plain, kind), pa.array(twins, kind), b.column(1)], ["key", "x", "twin", "y"])

    # at most 2 x MAX_TRAIN_PER_CLASS rows of indices into a bounded vocabulary, flat; in an order that no partitioning changes
    train = rows.mapInArrow(encode, "key long, x array<int>, twin array<int>, y int").toArrow().sort_by([("key", "ascending"), ("y", "ascending")]).combine_chunks()
    whole = lambda c: pa.concat_arrays(train.column(c).chunks) if train.column(c).num_chunks != 1 else train.column(c).chunk(0)
    x, y = whole("x"), whole("y").to_numpy(zero_copy_only=False).astype(float)
    texts, gaps = _Sparse(x.flatten().to_numpy(), np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy()))).astype(np.int64)), _gaps(x, whole("twin"))
    del train
    w, b = _gradient_descent(texts, gaps, y, len(vocabulary), l2, cf, steps)
    forget(docs.sparkSession, mark)
    return Model(float(b) - math.log(rates[1] / rates[0]), {x: float(w[i]) for x, i in place.items() if w[i]})


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            found = [m.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return documents(docs, (doc_id, text)).mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores under ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = bounded_batches(docs).columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
