"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprint: words are runs of non-white-space bytes of the text with A-Z in lower case; every
window of ``shingle`` words, repeats included, is hashed with XXH64 (seed 42); a bit of the 64 is set
if it is set in more than half of the hashes.

Index: a fingerprint is filed under every choice of ``keep`` of ``blocks`` bit blocks, with the bits
of those blocks (a shared masked pattern) as the upper node. Of two fingerprints with at most
``blocks - keep`` differing bits at least ``keep`` blocks agree, so they meet under some node: the
search is exact. Within every node fingerprints are sorted by Gray rank and cut into a binary tree; a tree
node holds the bits that all its members share. Pairs of tree nodes are visited from the top: the
differences of shared bits are added up and whole groups are left when the sum exceeds the radius;
groups that can't differ by more are joined at once without looking at pairs. Small nodes are visited level by level, many at
once; larger ones depth first, where groups already in one component are skipped and only a spanning forest comes out.

A pattern that more than ``HOT`` fingerprints share is not searched in one task: its members are filed again, one
level down, under each of ``radius + 1`` blocks of the bits that the pattern leaves open (of which one agrees), and so on.

Equal fingerprints are one class, pre-aggregated before anything else, so copies never meet in pairs.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; fewer words
than a shingle make one shingle; rows that share a doc_id count as one document per row; rows with a
null doc_id are fingerprinted and link like any other, and their component is the smallest non-null id they reach (null if
there is none); extra columns are left out; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.llm.common import documents, forget, made, materialize, partitions, table, text_or_empty
from tarifa.llm.components import connected_components

SHINGLE, RADIUS, BLOCKS = 4, 4, 7
#: Members of a pattern from which it is filed again.
HOT = 4096
#: Members of a leaf of the depth-first tree; members from which a node is visited depth first; pairs of members visited at once.
_LEAF, _DEEP, _ROOM = 16, 64, 1 << 20
_PART = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        h = digest(b" ".join(w), 42)
        return h - (h >> 63 << 64)
    n = len(w) - shingle + 1
    joined = b" ".join(w)
    after = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts, ends = np.concatenate(([0], after[: n - 1])).tolist(), (after[shingle - 1 :] - 1).tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, n, _PART):
        h = np.array([digest(joined[p:q], 42) for p, q in zip(starts[at : at + _PART], ends[at : at + _PART])], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return documents(docs, (doc_id, text)).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order of the reflected binary code."""
    r = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(s))
    return r


class _Tree:
    """Fingerprints in Gray order; each node has the bits its members share."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.nodes: list[tuple[int, int, int, int, int]] = []  # from, to, value, mask of shared bits, first child or -1
        self._build(0, len(codes))

    def _build(self, lo: int, hi: int) -> int:
        part = self.codes[lo:hi]
        value = int(part[0])
        varying = int(np.bitwise_or.reduce(part ^ part[0]))
        me = len(self.nodes)
        self.nodes.append((lo, hi, value, ~varying & (2**64 - 1), -1))
        if hi - lo > _LEAF:
            mid = (lo + hi) // 2
            left = self._build(lo, mid)
            right = self._build(mid, hi)
            self.nodes[me] = (lo, hi, value, ~varying & (2**64 - 1), left)
            self.right = getattr(self, "right", {})
            self.right[me] = right
        return me


def link_group(codes: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints, the place of the root of each one's component."""
    order = np.argsort(gray_rank(codes), kind="stable")
    tree = _Tree(codes[order])
    root = list(range(len(codes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def union(x: int, y: int) -> None:
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)

    right = getattr(tree, "right", {})
    whole: dict[int, bool] = {}  # nodes whose members are known to be one component

    def close(k: int) -> bool:
        lo, hi, *_ = tree.nodes[k]
        if not whole.get(k):
            first = find(lo)
            whole[k] = all(find(i) == first for i in range(lo, hi))
        return whole[k]

    stack = [(0, 0)]
    while stack:
        x, y = stack.pop()
        xlo, xhi, xv, xm, xc = tree.nodes[x]
        ylo, yhi, yv, ym, yc = tree.nodes[y]
        apart = ((xv ^ yv) & xm & ym).bit_count()
        if apart > radius:
            continue
        if x != y and close(x) and close(y) and find(xlo) == find(ylo):
            continue
        if apart + (64 - (xm & ym).bit_count()) <= radius:
            for i in (*range(xlo, xhi), *range(ylo, yhi)):
                union(xlo, i)
            continue
        if xc < 0 and yc < 0:
            a, b = tree.codes[xlo:xhi], tree.codes[ylo:yhi]
            for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)):
                union(xlo + int(i), ylo + int(j))
        elif x == y:
            stack += [(xc, right[x]), (right[x], right[x]), (xc, xc)]
        elif yc < 0 or xc >= 0 and xhi - xlo >= yhi - ylo:
            stack += [(right[x], y), (xc, y)]
        else:
            stack += [(x, right[y]), (x, yc)]
    out = np.empty(len(codes), np.int64)
    out[order] = order[[find(i) for i in range(len(codes))]]
    return out


def _level_links(run: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked members of runs of equal ``run``, with codes in Gray order within each: all trees level by level."""
    start = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    size = np.diff(np.append(start, len(run)))
    levels = [(codes, np.zeros(len(codes), np.uint64), start, size)]  # value, bits that vary, first node and nodes of each run
    while levels[-1][3].max() > 1:
        value, varying, at, n = levels[-1]
        up = (n + 1) // 2
        first = np.repeat(at - 2 * (np.cumsum(up) - up), up) + 2 * np.arange(up.sum())  # left child of each node above
        last = np.repeat(at + n, up)
        other = np.where(first + 1 < last, first + 1, first)
        levels.append((value[first], varying[first] | varying[other] | (value[first] ^ value[other]), np.cumsum(up) - up, up))
    owner = np.arange(len(start))
    x, y = levels[-1][2], levels[-1][2]
    a, b = [], []
    for depth in range(len(levels) - 1, -1, -1):
        value, varying, at, n = levels[depth]
        open_ = varying[x] | varying[y]
        apart = np.bitwise_count((value[x] ^ value[y]) & ~open_).astype(np.int64)
        near = apart <= radius
        x, y, owner, apart, open_ = x[near], y[near], owner[near], apart[near], open_[near]
        # members that can't differ by more: a star around the first
        whole = apart + np.bitwise_count(open_) <= radius
        wx, wy, wo = x[whole] - at[owner[whole]], y[whole] - at[owner[whole]], owner[whole]
        for side in (wx, wy):
            low, high = start[wo] + (side << depth), start[wo] + np.minimum((side + 1) << depth, size[wo])
            many = high - low
            a.append(np.repeat(start[wo] + (wx << depth), many))
            b.append(np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum()))
        x, y, owner = x[~whole], y[~whole], owner[~whole]
        if not depth or not len(x):
            break
        lower_at, lower_n = levels[depth - 1][2], levels[depth - 1][3]
        cx, cy = lower_at[owner] + 2 * (x - at[owner]), lower_at[owner] + 2 * (y - at[owner])
        end, same = lower_at[owner] + lower_n[owner], x == y
        pairs = [(cx, cy, np.ones(len(x), bool)), (cx, cy + 1, cy + 1 < end), (cx + 1, cy, ~same & (cx + 1 < end)), (cx + 1, cy + 1, (cx + 1 < end) & (cy + 1 < end))]
        x, y, owner = (np.concatenate(c) for c in zip(*((p[ok], q[ok], owner[ok]) for p, q, ok in pairs)))
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def _links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between representatives within runs of equal key (rows sorted by key)."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    a, b = [np.zeros(0, rep.dtype)], [np.zeros(0, rep.dtype)]
    shallow = np.flatnonzero((size > 1) & (size <= _DEEP))
    run = np.repeat(np.arange(len(size)), size)
    many = np.cumsum(size[shallow] ** 2)
    for part in np.split(shallow, np.searchsorted(many, np.arange(_ROOM, many[-1], _ROOM))) if len(shallow) else ():
        if len(part):
            rows = np.flatnonzero(np.isin(run, part)) if len(part) < len(size) else np.arange(len(key))
            rows = rows[np.lexsort((gray_rank(fp[rows]), run[rows]))]
            x, y = _level_links(run[rows], fp[rows], radius)
            a.append(rep[rows[x]])
            b.append(rep[rows[y]])
    for g in np.flatnonzero(size > _DEEP):
        s, e = edge[g], edge[g + 1]
        root = link_group(fp[s:e], radius)
        at = np.flatnonzero(root != np.arange(e - s))
        a.append(rep[s + at])
        b.append(rep[s + root[at]])
    return np.concatenate(a), np.concatenate(b)


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` of ``blocks`` even blocks of 64 bits."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (q - p)) - 1) << p for p, q in zip(cut, cut[1:])]
    return [sum(c) for c in combinations(each, blocks - radius)]


def _open_blocks(mask: int, parts: int) -> list[int]:
    """The bits that ``mask`` leaves open, in ``parts`` even blocks."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    cut = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(free[p:q]) for p, q in zip(cut, cut[1:])]


_FILED = ["key", "mask", "fp", "rep"]


def _search(filed: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within the patterns of ``filed``; members of hot patterns come back as they are, with null links."""
    n, most = partitions(filed.sparkSession), max(HOT, 2 << radius)  # fewer members than this leave a bit open for each block
    filed = filed.repartition(n, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        hot = None  # the pattern whose members pass

        def back(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            none = pa.nulls(len(rows[0]), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *map(pa.array, rows)], ["a", "b", *_FILED])

        for batch in _ended(batches):
            rows = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns) if batch is not None else None
            if rows is not None and hot is not None:
                more = int(np.searchsorted(rows[0], hot, "right"))
                if more:
                    yield back(tuple(c[:more] for c in rows))
                    rows = tuple(c[more:] for c in rows)
                if not len(rows[0]):
                    continue
                hot = None
            if rows is None:
                if not held:
                    return
                rows = held.pop()
            else:
                if held:
                    rows = tuple(np.concatenate(x) for x in zip(held.pop(), rows))
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last pattern may go on in the next batch
                tail = tuple(c[cut:] for c in rows)
                if len(tail[0]) > most:
                    hot = tail[0][0]
                    yield back(tail)
                else:
                    held.append(tail)
                rows = tuple(c[:cut] for c in rows)
            if not len(rows[0]):
                continue
            edge = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1], [True])))
            size = np.diff(edge)
            if size.max() > most:
                large = np.repeat(size > most, size)
                yield back(tuple(c[large] for c in rows))
                rows = tuple(c[~large] for c in rows)
            a, b = _links(rows[0], rows[2].view(np.uint64), rows[3], radius)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none, none, none], ["a", "b", *_FILED])

    return filed.mapInArrow(run, "a long, b long, key long, mask long, fp long, rep long")


def _file_again(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` of hot patterns under each block of the bits that their pattern leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, mask, fp, rep = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for m in np.unique(mask):
                mine = mask == m
                for block in _open_blocks(int(m) & (2**64 - 1), radius + 1):
                    signed = np.uint64(block).view(np.int64)
                    fine = pa.array(np.full(int(mine.sum()), signed))
                    yield pa.RecordBatch.from_arrays([pa.array(key[mine]), fine, pa.array(np.full(len(fine), m | signed)), pa.array(fp[mine]), pa.array(rep[mine])], ["key", "block", "mask", "fp", "rep"])

    again = rows.select(*_FILED).mapInArrow(run, "key long, block long, mask long, fp long, rep long")
    return again.select(F.xxhash64("key", "block", F.col("fp").bitwiseAND(F.col("block"))).alias("key"), "mask", "fp", "rep")


def near_links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between representatives that span the components of ``classes`` (distinct fp, rep)."""
    signed = [F.lit(m - (m >> 63 << 64)).cast("long") for m in masks(radius, blocks)]
    node = F.explode(F.array(*[F.struct(m.alias("mask"), F.col("fp").bitwiseAND(m).alias("pattern")) for m in signed]))
    filed = classes.where("rep IS NOT NULL").select("fp", "rep", node.alias("node"))
    filed = filed.select(F.xxhash64("node.mask", "node.pattern").alias("key"), "node.mask", "fp", "rep")
    links: DataFrame | None = None
    while True:  # a level of the index at a time; members of a pattern are distinct, so open bits end before hot patterns do
        found = materialize(_search(filed, radius), "simhash-links")
        own = found.where("a IS NOT NULL").select("a", "b")
        links = own if links is None else links.union(own)
        hot = found.where("a IS NULL")
        if hot.isEmpty():
            return links
        filed = _file_again(hot, radius)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp, component_id of every row; doc_id must be an integer."""
    found = materialize(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "simhash")
    classes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    names = connected_components(near_links(classes.select("fp", F.col("fp").alias("rep")), radius, blocks))
    named = materialize(classes.join(names, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("c")), "simhash-names")
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    return found.join(named.select("fp", "c").join(least, "c").drop("c"), "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the windows that ``fingerprint`` takes; none for a blank text."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = max(1, len(w) - shingle + 1) if w else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(n)), np.uint64, n))


#: Documents that the order of the prefixes is learned from, and shingles it holds. They set the cost, never the result.
_ORDER_DOCS, _ORDER_SHINGLES = 5_000, 200_000


def _common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that several documents of a sample have."""
    n = docs.count()
    docs = docs.select("doc_id", "text")
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // _ORDER_DOCS))) == 0)
    found = sample.mapInArrow(_sets(shingle), "doc_id long, s array<long>").select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    rows = found.where("n > 2").orderBy(F.desc("n"), "h").limit(_ORDER_SHINGLES).toPandas()
    return np.sort(rows.h.to_numpy(np.int64).view(np.uint64))


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, shingle).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "s"])

    return run


#: Bits of a set's parity: each member flips one, so two sets differ in as many members as bits at least.
_PARITY = 1024


def _parity(s: np.ndarray) -> np.ndarray:
    """Of each bit whether an odd number of members falls on it, as longs."""
    with np.errstate(over="ignore"):
        at = ((s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=_PARITY) & 1, bitorder="little").view(np.int64)


def _may_be_near(a: str, b: str, total: str) -> str:
    """SQL for whether sets of ``total`` members together can be 0.8 similar: they then differ in a ninth of them at most."""
    return f"9 * aggregate(zip_with({a}, {b}, (x, y) -> CAST(bit_count(x ^ y) AS int)), 0, (s, v) -> s + v) <= {total}"


#: What tells rows apart: the id and a hash of the text. Rows that agree in both are copies.
_ROW = ["doc_id", "th"]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, th: a row per row of ``docs``."""
    return documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("th", F.xxhash64(text_or_empty()))


def _prefixes(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th, fp, hash and size of the shingle set, its prefix and a quarter of it as short hashes, of every row.

    Sets are ordered by (common in the sample, hash). Two sets of similarity 0.8 or more share a member of their first
    n - ceil(0.8 n) + 1 in any common order, so no pair is missed.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for b in batches:
            fp, sig, size, prefix, part, bits = [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                s, f = shingle_set(t, shingle), fingerprint(t, shingle)
                h = xxhash.xxh64_intdigest(s.tobytes(), 7)
                n, late = len(s), np.searchsorted(common, s, "right") > np.searchsorted(common, s)
                first = np.concatenate((s[~late], s[late]))[: n - (4 * n + 4) // 5 + 1] if n else s
                fp.append(f), sig.append(h - (h >> 63 << 64)), size.append(n), prefix.append(first.view(np.int64))
                bits.append(_parity(s))
                part.append(np.unique((s[s % 4 == 0] >> np.uint64(2)).astype(np.uint32)).view(np.int32))
            columns = [pa.array(fp, pa.int64()), pa.array(sig, pa.int64()), pa.array(size, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(part, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *columns], [*_ROW, "fp", "sig", "size", "prefix", "part", "bits"])

    return docs.mapInArrow(run, "doc_id long, th long, fp long, sig long, size long, prefix array<long>, part array<int>, bits array<long>")


#: Texts that are picked out by their broadcast keys (of 16 bytes) before they are moved; more are moved with all others.
_PICKED = 500_000


def _row_key() -> list[Column]:
    return [F.xxhash64(*_ROW).alias("rk"), F.col("th").alias("rt")]


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets have a Jaccard similarity of 0.8 or more.

    Sets that are so similar differ in a ninth of their sizes' sum at most; pairs whose parities differ in more bits go. Of these differences about a fourth fall into a quarter of
    the hash space: pairs with more there than that by six deviations go before any text is moved (a similar pair does so with a
    probability of about 1e-9). For the others the texts of both classes' representative rows come together, and the whole sets
    are compared.
    """
    pairs = materialize(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-candidates")
    parts = classes.select("class", "part", "bits", "size", F.struct(F.xxhash64("row.doc_id", "row.th").alias("rk"), F.col("row.th").alias("rt")).alias("k"))
    apart = F.size("pa") + F.size("pb") - 2 * F.size(F.array_intersect("pa", "pb"))
    left = pairs.join(parts.toDF("a", "pa", "ba", "na", "ka"), "a").join(parts.toDF("b", "pb", "bb", "nb", "kb"), "b")
    most = (F.col("na") + F.col("nb")) / 9.0
    left = left.where(_may_be_near("ba", "bb", "(na + nb)")).where(apart <= most / 4 + 6 * F.sqrt(3 * most) / 4 + 1)
    left = materialize(left.select("a", "b", "ka", "kb"), "near-likely")
    ids = left.select(F.explode(F.array("ka", "kb")).alias("k")).select("k.rk", "k.rt").distinct()
    texts = docs.select(*_row_key(), "text")
    if ids.count() <= _PICKED:
        texts = texts.join(F.broadcast(ids), ["rk", "rt"], "left_semi")
    one = Window.partitionBy("rk", "rt").orderBy(F.lit(0))  # repeated rows are one
    texts = texts.withColumn("r", F.row_number().over(one)).where("r = 1").drop("r")
    left = left.select("a", "b", F.col("ka.rk").alias("rk"), F.col("ka.rt").alias("rt"), "kb")
    first = left.join(texts, ["rk", "rt"]).select("a", "b", F.col("text").alias("ta"), F.col("kb.rk").alias("rk"), F.col("kb.rt").alias("rt"))
    both = first.join(texts, ["rk", "rt"]).select("a", "b", "ta", F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, np.zeros(0, np.uint64)
        for b in batches:
            good = []
            for ta, tb in zip(b.column(2), b.column(3)):
                if (text := tb.as_py()) != held:  # pairs of the same second text follow each other
                    held, known = text, shingle_set(text, shingle)
                own = shingle_set(ta.as_py(), shingle)
                good.append(9 * len(np.intersect1d(own, known, assume_unique=True)) >= 4 * (len(own) + len(known)))
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    return materialize(both.mapInArrow(run, "a long, b long"), "near-links")


def _fits(n: str, i: str, m: str, j: str) -> str:
    """SQL for whether sets of ``n`` and ``m`` members can be similar if they share none before the places ``i`` and ``j``.

    They need 4/9 (n + m) common members, and have n - i and m - j at most from there on. It holds at the first
    member that two similar sets share, so no pair is missed; copies of one text that are each too far from it have so many
    members of their own in front that they don't meet.
    """
    return f"9 * ({n} - {i}) >= 4 * ({n} + {m}) AND 9 * ({m} - {j}) >= 4 * ({n} + {m})"


def _near_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th, group of every row of ``_rows``: ``group`` numbers the components."""
    found = materialize(_prefixes(docs, shingle), "near-prefixes")
    same = ["fp", "sig", "size"]
    # a class of equal sets; its number is taken from a table that is written, so it does not change
    classes = found.groupBy(*same).agg(F.min(F.struct(F.col("doc_id").isNull(), *_ROW)).alias("row"), F.first("prefix").alias("prefix"), F.first("part").alias("part"), F.first("bits").alias("bits"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "near-classes")
    filed = classes.select(F.posexplode("prefix").alias("at", "key"), "class", "size")
    by_key = Window.partitionBy("key")
    several = filed.withColumn("c0", F.min("class").over(by_key)).withColumn("c1", F.max("class").over(by_key)).where("c0 <> c1")
    shared = materialize(several.select("key", "at", "class", "size"), "near-shared")
    # of copies of one text the text itself has the fewest members that no other has: it is the head of its keys, which the
    # others are compared with even where they are too far from each other
    own = shared.groupBy("class").agg((F.first("size") - F.ceil(0.8 * F.first("size")) + 1 - F.count("*")).alias("alone"))
    ranked = shared.join(own, "class")
    other = F.struct("class", "size", "at")
    beside = [F.lead(other).over(by_key.orderBy("size", "class")).alias("after"), F.first(other).over(by_key.orderBy("alone", "class")).alias("head")]
    ranked = ranked.select("class", "size", "at", *beside).select("class", "size", "at", F.explode(F.array("after", "head")).alias("o")).where("o IS NOT NULL AND class <> o.class")
    by_fp = classes.groupBy("fp").agg(F.min("class").alias("rep"))
    first = near_links(by_fp).union(classes.join(by_fp.toDF("fp", "one"), "fp").select("class", "one"))
    near = ranked.where(_fits("size", "at", "o.size", "o.at"))
    first = first.union(near.select("class", "o.class"))
    links = _verified(first, classes, docs, shingle)
    names = materialize(connected_components(links), "near-names")
    members = shared.join(names, F.col("class") == F.col("node"), "left").select("key", "class", "size", "at", F.coalesce("component", "class").alias("c"))
    open_keys = members.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    members = materialize(members.join(open_keys, "key").join(classes.select("class", "bits"), "class").select("key", "class", "size", "at", "c", "bits"), "near-open")
    x, y = members.toDF("key", "a", "n", "i", "ca", "ba"), members.toDF("key", "b", "m", "j", "cb", "bb")
    rest = x.join(y, "key").where("ca < cb AND " + _fits("n", "i", "m", "j") + " AND " + _may_be_near("ba", "bb", "(n + m)")).select("a", "b")
    names = connected_components(links.union(_verified(rest, classes, docs, shingle)))
    labels = classes.join(names, F.col("class") == F.col("node"), "left").select(*same, F.coalesce("component", "class").alias("group"))
    return found.join(labels, same).select(*_ROW, "group")


def near_components(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, component_id of every row: components of the pairs with Jaccard similarity 0.8 or more of their shingle sets.

    Equal sets are one class. Candidates come from the Gray-order index and from neighbours and heads in a shared prefix first, linear
    in number; once the verified ones are contracted, all pairs with a shared prefix member that are still in different
    components and of fitting sizes are verified too. Every link is checked on the whole sets, and no pair is left out.
    component_id is the smallest doc_id of a component, null where it has none.
    """
    rows = materialize(_near_rows(_rows(docs), shingle), "near-rows")
    least = rows.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "group").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: of each component of ``near_components`` one row stays.

    It is the row with the smallest doc_id (null last); of rows that share it the one with the smallest hash of its text, and of
    rows that agree in both any one. Null and blank texts are near-duplicates of each other.
    """
    mark = made()
    rows = materialize(_near_rows(_rows(docs), shingle), "near-rows")
    own = F.struct(F.col("doc_id").isNull(), *_ROW)
    best = rows.groupBy("group").agg(F.min(own).alias("best"))
    gone = rows.join(best, "group").where(own != F.col("best")).select(F.col("doc_id").alias("__id"), F.col("th").alias("__h")).distinct()
    gone = materialize(gone, "near-gone")
    twice = materialize(rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__h")), "left_anti").groupBy(*_ROW).count().where("count > 1"), "near-copies")
    forget(docs.sparkSession, mark, ("near-gone", "near-copies"))  # what follows reads these two alone
    marked = docs.withColumn("__doc", F.col("doc_id").cast("long")).withColumn("__th", F.xxhash64(text_or_empty()))
    kept = marked.join(gone, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")), "left_anti")
    if not twice.isEmpty():
        copies = twice.select(F.col("doc_id").alias("__id"), F.col("th").alias("__h"))
        same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h"))
        kept = kept.join(copies, same, "left_anti").unionByName(kept.join(copies, same, "left_semi").dropDuplicates(["__doc", "__th"]))
    return kept.select(*[kept[f"`{c}`"] for c in docs.columns])


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
