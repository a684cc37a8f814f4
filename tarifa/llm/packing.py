"""Mixture-controlled packing of documents into sequences of fixed length.

Each source is a queue of tokens (its documents in input order). Sources are served by deficit round-robin: in every window
each source earns its target share of the window's tokens, and what it earned but was not sent (its deficit, a
fraction of a token here, as documents may be cut anywhere) carries over to the next window. A source whose queue is empty
leaves the round and the others share its part by their weights.

``Schedule`` is that round-robin in closed form. Sources are the leaves of a balanced binary tree; of the first T tokens sent,
an inner node passes floor(T x weight of its left half / its weight) to the left and the others to the right. Both numbers never
fall when T grows and add up to T, so what a source was sent after any number of windows is a composition of such steps, off its
share by less than the depth of the tree, in whole-number arithmetic. So are the window in which the x-th token of a
queue is sent, and its place there: no task has to look at the windows before. Between two sources running empty
the weights stay the same; there are at most as many such phases as sources.

Distribution: tokens are made once and kept in a table of the shared folder with their place in their source's queue within
their chunk (a task's rows). One aggregation over (source, chunk) and a running sum per source give each chunk its place in the
queues; then every document cuts itself into pieces. Texts and ids are never sorted. The driver gets one
number per source.

Default targets are the sources' shares of all tokens, the only ones that hold up to the last window when everything is
packed; ``weights`` sets others. Windows are cut every ``length`` tokens, so only the very last sequence is padded.

Edge cases: a null text is empty and gives one piece with the end token alone; a null source is a queue of its own;
repeated rows are packed each by itself; empty tables give no piece; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.llm.common import bounded_batches, materialize, table
from tarifa.llm.tokens import Encoder

LENGTH, END = 2048, 1
#: Resolution of weights that are no whole numbers.
_UNIT = 1 << 40


class _Phase:
    """The round-robin between two sources running empty: ``active`` sources, by weight, from the ``begin``-th token on."""

    def __init__(self, begin: int, active: list[int], weights: list[int]):
        self.begin, self.end = begin, begin
        self.leaf = {s: i for i, s in enumerate(active)}
        self.sums = [0, *accumulate(weights)]
        self._paths: dict[int, list[tuple[bool, int, int]]] = {}

    def _path(self, s: int) -> list[tuple[bool, int, int]]:
        """From the root to the source: whether to the right, weight of the left half, weight of the node."""
        found = self._paths.get(s)
        if found is None:
            found, at, lo, hi = [], self.leaf[s], 0, len(self.sums) - 1
            while hi - lo > 1:
                mid = (lo + hi) // 2
                right = at >= mid
                found.append((right, self.sums[mid] - self.sums[lo], self.sums[hi] - self.sums[lo]))
                lo, hi = (mid, hi) if right else (lo, mid)
            self._paths[s] = found
        return found

    def sent(self, s: int, t: int) -> tuple[int, int]:
        """Of the first ``t`` tokens of the phase: those of the source, and those of the sources before it."""
        before = 0
        for right, a, c in self._path(s):
            left = t * a // c
            if right:
                before += left
                t -= left
            else:
                t = left
        return t, before

    def first(self, s: int, n: int) -> int:
        """Least t for which the source has ``n`` (1 or more) of the first ``t`` tokens."""
        for right, a, c in reversed(self._path(s)):
            n = (n - 1) * c // (c - a) + 1 if right else -(-n * c // a)
        return n


class Schedule:
    """Pieces of the documents of sources that hold ``totals`` tokens, served by ``weights`` (default: the totals)."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, length: int = LENGTH):
        self.length = length
        whole = [float(w) for w in weights] if weights else []
        if any(w < 0 or w != w for w in whole):
            raise ValueError("weights must be 0 or more")
        scaled = [round(w / max(sum(whole), 1e-300) * _UNIT) for w in whole] if weights else list(totals)
        left, begin = list(totals), 0
        self.phases: list[_Phase] = []
        self.taken: list[list[int]] = [[] for _ in totals]  # of each source, the tokens sent before each phase it is in
        self.of: list[list[int]] = [[] for _ in totals]  # and the phase
        while any(left):
            active = [s for s, n in enumerate(left) if n and scaled[s]]
            by = scaled
            if not active:  # only sources without weight are left
                active, by = [s for s, n in enumerate(left) if n], left
            phase = _Phase(begin, active, [by[s] for s in active])
            some = sum(left[s] for s in active)
            # it lasts until a source would owe more than it has
            span = min([some, *(phase.first(s, left[s] + 1) - 1 for s in active)])
            phase.end = begin + span
            for s in active:
                self.taken[s].append(totals[s] - left[s])
                self.of[s].append(len(self.phases))
                left[s] -= phase.sent(s, span)[0]
            self.phases.append(phase)
            begin += span

    def pieces(self, s: int, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """start, length, sequence, offset of the pieces of a document with ``n`` tokens that is ``at`` tokens into queue ``s``."""
        x, stop, length = at, at + n, self.length
        k = bisect_right(self.taken[s], x) - 1
        while x < stop:
            while k + 1 < len(self.taken[s]) and self.taken[s][k + 1] <= x:
                k += 1
            phase, base = self.phases[self.of[s][k]], self.taken[s][k]
            w = (phase.begin + phase.first(s, x - base + 1) - 1) // length
            lo, hi = max(0, w * length - phase.begin), min(phase.end, (w + 1) * length) - phase.begin
            d0, p0 = phase.sent(s, lo)
            d1, p1 = phase.sent(s, hi)
            end = min(stop, base + d1)
            yield x - at, end - x, w, phase.begin + lo - w * length + p1 - p0 + x - base - d0
            x = end


def tokenize(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end: int = END, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, chunk, before, n, ids: ids are 16-bit, ``end`` included; before are the tokens of the source earlier in the chunk."""
    rows = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    tail = np.array([end], np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, chunk, seen = Encoder.at(vocabulary), TaskContext.get().partitionId(), {}
        for b in batches:
            ids, n, before = [], [], []
            for t, s in zip(b.column(2), b.column(1).to_pylist()):
                ids.append(encoder.encode(t.as_py()) + tail)
                n.append(len(ids[-1]) // 2)
                before.append(seen.get(s, 0))
                seen[s] = before[-1] + n[-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.full(b.num_rows, chunk, np.int32)), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "source", "chunk", "before", "n", "ids"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, source string, chunk int, before long, n long, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, weights: dict[str | None, float] | None = None, with_ids: bool = False, **options) -> DataFrame:
    """A row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, 32-bit).

    With ``weights`` sources that are not named weigh nothing and come when the named ones are empty.
    """
    tokens = materialize(tokenize(docs, **options), "pack-tokens")
    so_far = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    queues = materialize(tokens.groupBy("source", "chunk").agg(F.sum("n").alias("own")), "pack-queues")
    totals = {r["source"]: r["n"] for r in queues.groupBy("source").agg(F.sum("own").alias("n")).collect()}  # a row per source
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    plan = Schedule([totals[s] for s in names], [weights.get(s, 0.0) for s in names] if weights else None, length)
    number = {s: i for i, s in enumerate(names)}
    queues = queues.select(F.col("source").alias("q"), F.col("chunk").alias("c"), F.coalesce(F.sum("own").over(so_far), F.lit(0)).alias("base"))
    whole = tokens.join(queues, F.col("source").eqNullSafe(F.col("q")) & (F.col("chunk") == F.col("c"))).select("doc_id", "source", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, crc, ids, cut = [], [], [], []
            for i, (s, at, n) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))):
                wide = memoryview(np.frombuffer(b.column(4)[i].as_buffer(), np.uint16).astype("<u4").tobytes())
                for piece in plan.pieces(number[s], at, n):
                    mine = wide[4 * piece[0] : 4 * (piece[0] + piece[1])]
                    owner.append(i)
                    cut.append(piece)
                    crc.append(zlib.crc32(mine))
                    if with_ids:
                        ids.append(bytes(mine))
            at = pa.array(owner, pa.int64())
            start, size, sequence, offset = (pa.array([c[k] for c in cut], pa.int64()) for k in range(4))
            columns = [b.column(0).take(at), b.column(1).take(at), start, size, pa.array(crc, pa.int64()), b.column(3).take(at), sequence, offset]
            names_ = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names_ = [*columns, pa.array(ids, pa.binary())], [*names_, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names_)

    types = f"doc_id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return whole.mapInArrow(run, types)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (32-bit, little-endian, unpadded) of ``pack(..., with_ids=True)``."""
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return joined.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, each window in the proportions of the corpus."""
    found = pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
