"""Removal of repeated byte strings, by bucket-pointer refinement of a depth-limited suffix order.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the corpus. Only
suffixes up to that depth matter, so buckets are refined to depth ``length`` and no further:

1. Initial buckets: every place of a text belongs to the bucket of its 32-gram; the bucket identifier
   is made from those of its two 16-grams, theirs from 8-grams. Every window of ``length`` bytes is
   filed under its smallest 32-gram bucket (the leftmost of equals), a choice that depends on the
   window's bytes alone: about one place in 36 is a pointer that goes into the sort. Buckets with a
   single pointer are done: their windows are unique.
2. The pointers of the other buckets fetch the bytes of their windows. There buckets are refined by sorting on the
   bucket identifiers of later offsets: places of a 32-gram bucket are sorted by the bucket 32 places on, which gives them
   the buckets of 64-grams; these take the place of the old identifiers and are reused in the same way, up to the largest power
   of two within ``length``, and once more at the offset that ends at ``length``. Places that are single in their
   bucket drop out of each sort.
3. In each final bucket all windows but the earliest (doc_id, start) cover bytes that go.

Buckets with very many pointers (a passage in a third of the documents) send identifiers made from the bytes of their
windows instead of the bytes; these are dealt out by identifier, after equal windows of a batch are
reduced to the earliest, so no task gets the whole bucket.

Identifiers that are sent are 64-bit mixes, and such a window has a pair of them, so that unequal windows meet with
a probability of about 2^-64 per pair.

Edge cases: null and empty texts have 0 bytes and keep nothing to remove; rows with equal doc_id and
text are one place (neither is earlier); rows with equal doc_id and different texts are ordered by a
hash of the text; a null doc_id comes last; texts shorter than ``length`` are kept whole; repeated rows are looked at
once and each gets the result; an empty table gives an empty one; extra columns stay as they are, but for names that begin with
two underscores, which are the module's own. ``length`` is 64 to ``MAX_LENGTH``; others are refused.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import bounded_batches, partitions, table

LENGTH, GRAM = 100, 32
#: Pointers of a bucket (within a batch, and in all) from which it sends identifiers instead of bytes.
HOT_BATCH, HOT = 512, 4096
MAX_LENGTH = 1 << 15
#: Bytes that pointers are made from at once (their arrays fit into a core's cache), pointers that are sent at once, bytes of
#: windows that are sent at once, and bytes that are refined at once, about.
_STEP, _FLUSH, _FETCH, _REFINE = 1 << 16, 1 << 19, 1 << 24, 1 << 20
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PTR = np.dtype([("h", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("s", "<u4"), ("n", "<u2")])
_RUN = np.dtype([("doc", "<i8"), ("th", "<i8"), ("s", "<u4"), ("n", "<u4")])
_CONTEXT = np.dtype([*_RUN.descr, ("h", "<u4")])
_WIN = np.dtype([("k1", "<u8"), ("k2", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("s", "<u4")])
#: A pointer of a list as one long: start, windows, whether its bucket is hot, low bits of its bucket.
_BUCKET_BITS = 22


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _C1
    x ^= x >> np.uint64(31)
    x += b
    x *= _C2
    x ^= x >> np.uint64(29)
    x *= _C3
    x ^= x >> np.uint64(32)
    return x


def gram_ids(b: np.ndarray, depth: int) -> np.ndarray:
    """Identifier of the ``depth``-gram (8, 16, 32 or 64) at each place of the bytes ``b``."""
    if len(b) < depth:
        return np.zeros(0, np.uint64)
    ids = np.ndarray((len(b) - 7,), "<u8", b, 0, (1,)).copy()
    at = 8
    while at < depth:
        ids = _mix(ids[:-at], ids[at:])
        at *= 2
    return ids


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for each i."""
    have = 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def pointers(b: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end in ``b``: bucket, first window and number of windows of each pointer.

    A pointer is the leftmost smallest 32-gram of the windows filed under it, which are consecutive.
    """
    width = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none.astype(np.uint64), none, none
    ids = gram_ids(b, GRAM)
    least = _sliding(ids, width, np.minimum)  # by window start
    good = np.ones(len(least), bool)
    for k in range(0, len(ends)):  # windows that would reach over a text's end
        good[max(0, ends[k] - length + 1) : ends[k]] = False
    if not good.any():
        return none.astype(np.uint64), none, none
    held = np.where(good, least, np.uint64(0))
    padded = np.concatenate((np.zeros(width - 1, np.uint64), held, np.zeros(len(ids) - len(held), np.uint64)))
    candidate = np.flatnonzero(_sliding(padded, width, np.maximum)[: len(ids)] == ids)
    starts = np.flatnonzero(good)
    want = least[starts]
    at = np.searchsorted(candidate, starts)
    while True:
        off = np.flatnonzero(ids[candidate[at]] != want)
        if not len(off):
            break
        at[off] += 1
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    return want[first], starts[first], np.diff(np.append(first, len(starts)))


def _pack(rows: np.ndarray, extra: bytes = b"") -> bytes:
    """Columns of a structured array one after the other, then ``extra``, compressed."""
    raw = b"".join((np.diff(rows[c], prepend=rows[c].dtype.type(0)) if c == "doc" else np.ascontiguousarray(rows[c])).tobytes() for c in rows.dtype.names)
    return zstandard.compress(struct.pack("<q", len(rows)) + raw + extra, 3)


def _unpack(blob: bytes, dtype: np.dtype) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(blob)
    n, at = struct.unpack_from("<q", raw)[0], 8
    out = np.empty(n, dtype)
    for c in dtype.names:
        size = n * dtype[c].itemsize
        column = np.frombuffer(raw, dtype[c], n, at)
        out[c] = np.cumsum(column) if c == "doc" else column
        at += size
    return out, raw[at:]


def _blobs(bucket: list[int], kind: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    held, rows = None, []
    for b in batches:
        for bucket, kind, data in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != held and rows:
                yield held, rows
                rows = []
            held = bucket
            rows.append((kind, data))
    if rows:
        yield held, rows


_MARK, _PLAIN, _HOT = 0, 1, 2


def _send_pointers(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Blobs of pointers by bucket; of a bucket that is hot in this batch just a mark, its pointers pass by the side."""
    _, inverse, count = np.unique(rows["h"], return_inverse=True, return_counts=True)
    hot = count[inverse] > HOT_BATCH
    out: tuple[list, list, list] = ([], [], [])
    marks = np.unique(rows["h"][hot])
    for kind, part, to in (
        (_PLAIN, rows[~hot], rows["h"][~hot] % np.uint64(buckets)),
        (_HOT, rows[hot], np.arange(int(hot.sum()), dtype=np.uint64) // np.uint64(1024) * _C1 % np.uint64(buckets)),
        (_MARK, np.array([(h, 0, 0, 0, 0) for h in marks], _PTR), marks % np.uint64(buckets)),
    ):
        order = np.argsort(to, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(to[order]) != 0, [True]))) if len(order) else [0]
        for p, q in zip(edge[:-1], edge[1:]):
            out[0].append(int(to[order[p]]))
            out[1].append(kind)
            out[2].append(_pack(part[order[p:q]]))
    return _blobs(*out)


def _depth(length: int) -> int:
    """The largest power of two within ``length``."""
    return 1 << (length.bit_length() - 1)


def _number(ids: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of places by identifier, and which share one; those outside ``several`` are single and not sorted."""
    at = np.flatnonzero(several)
    own = ids[at]
    order = np.argsort(own)
    new = np.concatenate(([True], own[order[1:]] != own[order[:-1]])) if len(own) else np.zeros(0, bool)
    number = np.arange(len(own), len(own) + len(ids), dtype=np.uint64)
    number[at[order]] = np.cumsum(new).astype(np.uint64)
    shared = np.zeros(len(ids), bool)
    shared[at[order]] = ~(new & np.append(new[1:], True)) if len(own) else False
    return number, shared


def buckets_of(b: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Final bucket of each window that starts at ``at`` in the bytes ``b``, and whether it shares it, by refinement."""
    ids = gram_ids(b, GRAM)
    number, several = _number(ids, np.ones(len(ids), bool))
    depth = GRAM
    while 2 * depth <= length:  # the numbers of the places ``depth`` on refine each bucket
        ids = number[:-depth] * np.uint64(len(b) * 2) + number[depth:]
        number, several = _number(ids, several[:-depth] & several[depth:])
        depth *= 2
    last = at + (length - depth)
    return _number(number[at] * np.uint64(len(b) * 2) + number[last], several[at] & several[last])


def _earliest(bucket: np.ndarray, shared: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows, in order of (doc, th, start), have one of another place in their bucket before them."""
    out = np.zeros(len(bucket), bool)
    at = np.flatnonzero(shared)
    if not len(at):
        return out
    order = at[np.argsort(bucket[at])]
    own = bucket[order]
    edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    first = np.repeat(np.minimum.reduceat(order, edge), np.diff(np.append(edge, len(order))))
    out[order] = ~((doc[order] == doc[first]) & (th[order] == th[first]) & (start[order] == start[first]))
    return out


def _flagged(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``_earliest`` of windows whose bytes stand in two identifiers: buckets of ``k1`` are refined by ``k2``."""
    number, shared = _number(k1, np.ones(len(k1), bool))
    return _earliest(*_number(_mix(number, k2), shared), doc, th, start)


def _runs(doc: np.ndarray, th: np.ndarray, start: np.ndarray, flag: np.ndarray) -> pa.RecordBatch:
    """Flagged windows (in order) as runs of consecutive starts."""
    at = np.flatnonzero(flag)
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, ["doc", "th", "s", "n"])
    d, t, s = doc[at], th[at], start[at].astype(np.int64)
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1)))
    first = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[first], t[first].astype(np.int64), s[first], np.diff(np.append(first, len(at))))], ["doc", "th", "s", "n"])


def _windows(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place within it of every window of ``rows``."""
    owner = np.repeat(np.arange(len(rows)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _keys(contexts: list[bytes], lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The two identifiers, of grams that begin and that end it, of every window of the contexts."""
    b = np.frombuffer(b"".join(contexts), np.uint8)
    depth = _depth(length)
    ids = gram_ids(b, depth)
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    owner, k = _windows(lengths, lengths)
    at = (np.cumsum(size) - size)[owner] + k
    return ids[at], ids[at + length - depth]


def _identity(doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th")]


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``text`` as compressed UTF-8 bytes in the column ``__z`` (null where it is null)."""
    rest = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3)
        for b in batches:
            z = [None if t is None else squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(z, pa.binary())], [*names, "__z"])

    schema = docs.select(*names, F.col(text).cast("binary").alias("__z")).schema
    return docs.select(*names, text).mapInArrow(run, schema)


def repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, th, s, n: runs of window starts that have an equal window before them."""
    if not 64 <= length <= MAX_LENGTH:
        raise ValueError(f"length must be 64 to {MAX_LENGTH}")
    spark = docs.sparkSession
    n_parts = partitions(spark)
    buckets = min(2 * n_parts, 1 << _BUCKET_BITS)  # a task sends a blob or two to each
    n_bits, h_mask = (length - GRAM + 1).bit_length(), (1 << _BUCKET_BITS) - 1
    rows = bounded_batches(docs).select(*_identity(doc_id, text), F.col(text).alias("text"))

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held: list[tuple[bytes, int, int]] = []
        size = 0

        def step() -> None:
            nonlocal size
            if held:
                ends = np.cumsum([len(x[0]) for x in held])
                begin = ends - [len(x[0]) for x in held]
                h, s, n = pointers(np.frombuffer(b"".join([x[0] for x in held]), np.uint8), ends, length)
                own = np.searchsorted(ends, s, side="right")
                out = np.empty(len(h), _PTR)
                out["h"], out["s"], out["n"] = h, s - begin[own], n
                out["doc"], out["th"] = np.array([x[1] for x in held], np.int64)[own], np.array([x[2] for x in held], np.int64)[own]
                found.append(out)
            held.clear()
            size = 0

        for b in batches:
            for doc, th, t in zip(*(c.to_pylist() for c in b.columns)):
                x = t.encode("utf-8", "surrogatepass") if t else b""
                if len(x) >= length:
                    held.append((x, doc, th))
                    size += len(x)
                    if size >= _STEP:
                        step()
                        if sum(map(len, found)) >= _FLUSH:
                            yield _send_pointers(np.concatenate(found), buckets)
                            found.clear()
        step()
        if found:
            yield _send_pointers(np.concatenate(found), buckets)

    sent = rows.mapInArrow(point, "bucket long, kind int, data binary").repartition(n_parts, "bucket").sortWithinPartitions("bucket")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_bucket(batches):
            parts = {k: [_unpack(d, _PTR)[0] for kind, d in blobs if kind == k] for k in (_MARK, _PLAIN, _HOT)}
            out = [(x, np.ones(len(x), bool)) for x in parts[_HOT]]
            if parts[_PLAIN]:
                plain = np.concatenate(parts[_PLAIN])
                marks = np.concatenate([x["h"] for x in parts[_MARK]]) if parts[_MARK] else np.zeros(0, np.uint64)
                _, inverse, count = np.unique(plain["h"], return_inverse=True, return_counts=True)
                marked = np.isin(plain["h"], marks)
                stays = marked | (count[inverse] > 1)
                out.append((plain[stays], (marked | (count[inverse] > HOT))[stays]))
            for x, hot in out:
                if len(x):
                    pointer = ((x["s"].astype(np.int64) << n_bits | x["n"]) << 1 | hot) << _BUCKET_BITS | (x["h"] & np.uint64(h_mask)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x["doc"]), pa.array(x["th"].astype(np.int64)), pa.array(pointer)], ["doc", "th", "p"])

    shared = sent.mapInArrow(meet, "doc long, th long, p long")
    lists = shared.groupBy("doc", "th").agg(F.collect_set("p").alias("p"))  # repeated rows have the same pointers
    texts = _packed(docs.select(*_identity(doc_id, text), F.col(text).alias("text")).where(F.octet_length("text") >= length), "text")
    joined = texts.join(lists, ["doc", "th"]).select("doc", "th", "__z", "p")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: list[tuple[np.ndarray, list[bytes]]] = []
        hot: list[tuple[np.ndarray, list[bytes]]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            out: tuple[list, list, list] = ([], [], [])

            def send(kind: int, to: np.ndarray, part: np.ndarray, contexts: list[bytes] | None) -> None:
                order = np.argsort(to, kind="stable")
                edge = np.flatnonzero(np.concatenate(([True], np.diff(to[order]) != 0, [True]))) if len(order) else [0]
                for p, q in zip(edge[:-1], edge[1:]):
                    pick = order[p:q]
                    out[0].append(int(to[pick[0]]))
                    out[1].append(kind)
                    out[2].append(_pack(part[pick], b"".join([contexts[i] for i in pick]) if contexts is not None else b""))

            def done(runs: np.ndarray) -> None:
                if len(runs):
                    out[0].append(int(runs["doc"][0] % buckets))
                    out[1].append(_MARK)
                    out[2].append(_pack(runs))

            if plain:
                part, contexts = np.concatenate([x[0] for x in plain]), [c for x in plain for c in x[1]]
                order = np.lexsort((part["s"], part["th"], part["doc"]))
                first: dict[bytes, int] = {}
                fresh, again = [], []
                for i in order.tolist():  # of equal bytes in a batch the earliest goes on, the others are decided
                    k = first.setdefault(contexts[i], i)
                    if k == i:
                        fresh.append(i)
                    elif part[i] != part[k]:
                        again.append(i)
                done(part[again][list(_RUN.names)].astype(_RUN))
                send(_PLAIN, part["h"][fresh] % np.uint32(buckets), part[fresh], [contexts[i] for i in fresh])
            if hot:
                part, contexts = np.concatenate([x[0] for x in hot]), [c for x in hot for c in x[1]]
                order = np.lexsort((part["s"], part["th"], part["doc"]))
                part, contexts = part[order], [contexts[i] for i in order]
                lengths = part["n"].astype(np.int64)
                k1, k2 = _keys(contexts, lengths, length)
                owner, k = _windows(part, lengths)
                w = np.empty(len(k1), _WIN)
                w["k1"], w["k2"], w["doc"], w["th"], w["s"] = k1, k2, part["doc"][owner], part["th"][owner], part["s"][owner] + k
                again = _flagged(w["k1"], w["k2"], w["doc"], w["th"], w["s"])
                send(_HOT, w["k1"][~again] % np.uint64(buckets), w[~again], None)
                runs = _runs(w["doc"], w["th"], w["s"], again)
                whole = np.empty(runs.num_rows, _RUN)
                for i, name in enumerate(_RUN.names):
                    whole[name] = runs.column(i).to_numpy()
                done(whole)
            plain.clear()
            hot.clear()
            size = 0
            if out[0]:
                yield _blobs(*out)

        last = None
        for b in batches:
            docs_, ths, zs, lists_ = b.columns
            flat, sizes = lists_.flatten().to_numpy(), lists_.value_lengths().to_pylist()
            h, is_hot = flat & h_mask, flat >> _BUCKET_BITS & 1 == 1
            n, s = flat >> (_BUCKET_BITS + 1) & ((1 << n_bits) - 1), flat >> (_BUCKET_BITS + 1 + n_bits)
            at = 0
            for doc, th, z, m in zip(docs_.to_pylist(), ths.to_pylist(), zs.to_pylist(), sizes):
                if (doc, th) != last:  # repeated rows are one place
                    last, x = (doc, th), zstandard.decompress(z)
                    for held, which in ((plain, ~is_hot[at : at + m]), (hot, is_hot[at : at + m])):
                        mine = at + np.flatnonzero(which)
                        if len(mine):
                            part = np.empty(len(mine), _CONTEXT)
                            part["doc"], part["th"], part["s"], part["n"], part["h"] = doc, th, s[mine], n[mine], h[mine]
                            held.append((part, [x[p : p + q + length - 1] for p, q in zip(s[mine].tolist(), n[mine].tolist())]))
                            size += int(n[mine].sum()) + len(mine) * (length - 1 if held is plain else 5 * length)
                at += m
                if size >= _FETCH:
                    yield from flush()
        yield from flush()

    fetched = joined.mapInArrow(fetch, "bucket long, kind int, data binary").repartition(n_parts, "bucket").sortWithinPartitions("bucket")

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_bucket(batches):
            rows_, contexts = [], []
            for kind, d in blobs:
                if kind == _PLAIN:
                    part, raw = _unpack(d, _CONTEXT)
                    rows_.append(part)
                    edge = np.concatenate(([0], np.cumsum(part["n"].astype(np.int64) + length - 1))).tolist()
                    contexts += [raw[p:q] for p, q in zip(edge, edge[1:])]
                elif kind == _MARK:
                    part, _ = _unpack(d, _RUN)
                    yield pa.RecordBatch.from_arrays([pa.array(part[c].astype(np.int64)) for c in ("doc", "th", "s", "n")], ["doc", "th", "s", "n"])
            if rows_:
                part = np.concatenate(rows_)
                order = np.lexsort((part["s"], part["th"], part["doc"], part["h"]))
                part = part[order]
                sizes = np.cumsum(part["n"].astype(np.int64) + length - 1)
                new = np.flatnonzero(np.concatenate(([True], part["h"][1:] != part["h"][:-1])))
                before = np.concatenate(([0], sizes))[new] // _REFINE
                cuts = [*new[np.concatenate(([True], before[1:] != before[:-1]))].tolist(), len(part)]
                for p, q in zip(cuts, cuts[1:]):  # whole initial buckets, about _REFINE bytes
                    own = part[p:q]
                    at = np.lexsort((own["s"], own["th"], own["doc"]))
                    own, lengths = own[at], own["n"][at].astype(np.int64)
                    b = np.frombuffer(b"".join([contexts[i] for i in order[p:q][at]]), np.uint8)
                    owner, k = _windows(own, lengths)
                    begin = np.cumsum(lengths + length - 1) - (lengths + length - 1)
                    doc, th, s = own["doc"][owner], own["th"][owner], own["s"][owner] + k
                    yield _runs(doc, th, s, _earliest(*buckets_of(b, begin[owner] + k, length), doc, th, s))
            many = [_unpack(d, _WIN)[0] for kind, d in blobs if kind == _HOT]
            if many:
                w = np.concatenate(many)
                w = w[np.lexsort((w["s"], w["th"], w["doc"]))]
                yield _runs(w["doc"], w["th"], w["s"], _flagged(w["k1"], w["k2"], w["doc"], w["th"], w["s"]))

    return fetched.mapInArrow(refine, "doc long, th long, s long, n long")


def cut(text: bytes, runs: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go and in how many maximal runs."""
    kept, at, removed, spans = [], 0, 0, 0
    end = -1
    for s, n in sorted(runs):
        stop = s + n + length - 1
        if s > end:
            kept.append(text[max(at, 0) : s])
            spans += 1
        begin = max(s, end)
        if stop > begin:
            removed += stop - begin
            end = stop
        at = end
    kept.append(text[at:] if end >= 0 else text)
    return b"".join(kept), removed, spans


def _with_repeats(docs: DataFrame, length: int, doc_id: str, text: str) -> DataFrame:
    """``docs`` packed, with the runs of each row in ``__runs``."""
    found = repeats(docs, length, doc_id, text).groupBy(F.col("doc").alias("__doc"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("s", "n")).alias("__runs"))
    doc, th = _identity(doc_id, text)
    packed = _packed(docs.withColumn("__d", doc).withColumn("__t", th), text)
    return packed.join(found, (F.col("__d") == F.col("__doc")) & (F.col("__t") == F.col("__th")), "left").drop("__d", "__t", "__doc", "__th")


def _pairs(column) -> list[list[tuple[int, int]]]:
    return [[(x["s"], x["n"]) for x in v] if v else [] for v in column.to_pylist()]


def digests(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = _with_repeats(docs.select(doc_id, text), length, doc_id, text).select(doc_id, "__z", "__runs")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for z, runs in zip(b.column(1).to_pylist(), _pairs(b.column(2))):
                x = zstandard.decompress(z) if z else b""
                kept, removed, spans = cut(x, runs, length)
                out.append((len(x), removed, spans, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` without its repeats; a character of which a byte went goes whole. Null stays null."""
    rows = _with_repeats(docs, length, doc_id, text)
    names = docs.columns
    others = [c for c in names if c != text]
    rows = rows.select(*others, "__z", "__runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for z, runs in zip(b.column(len(others)).to_pylist(), _pairs(b.column(len(others) + 1))):
                out.append(None if z is None else cut(zstandard.decompress(z), runs, length)[0].decode("utf-8", "ignore"))
            by_name = dict(zip(others, b.columns)) | {text: pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([by_name[c] for c in names], names)

    return rows.mapInArrow(run, docs.schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def with_lengths(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with ``n_chars``, where it has such a column, as the length of the text in code points."""
    return docs.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else docs
