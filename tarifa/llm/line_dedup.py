"""Lines that many documents share: found by hash, looked up in a sharded minimal perfect hash.

A line's key is the line without white space at its ends, in lower case (A-Z). Every document sends each of its keys of at
least ``min_chars`` code points once, as two 64-bit hashes (together its identity). They are counted by partial sums; those of
``min_docs`` documents or more are dealt into shards of about ``SHARD_KEYS`` by hash. Each shard becomes a minimal perfect hash
(levels of bits: a key stands where it is alone, the others go on to the next level) over the first hash, which gives its place in
three plain arrays: the fingerprint (the second hash), the number of documents and the largest document id. Shards are files in the shared folder.

Documents are not joined with lines: a task hashes the lines of its documents and probes the arrays, in batches. While all shards together
have at most ``held_bytes``, a worker holds them (a proven bound). Beyond it, the questions of documents are dealt by shard first,
so that each task needs few of them, one at a time; only hits go back to the documents. Both ways give the same rows.

A line that is looked up without being in the index gets some place there; its fingerprint tells it apart (2^-64 to be
wrong, as for two lines with the same identity).

Edge cases: a null or empty text is one empty line. Rows with the same doc_id are one document in counting; a shared line stays in
all rows of the largest id. Null ids are one document, smaller than all others. Repeated lines within the document that keeps a
key all stay. Any integral id; other columns pass through ``drop_repeated_lines`` and don't clash with its own, but for ``n_lines`` and
``n_dropped``, which are replaced.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import bounded_batches, file_system, materialize, scratch, table, text_or_empty

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a shard on average, bytes of all shards that a worker may hold, shards that it holds of a larger index.
SHARD_KEYS, HELD_BYTES, HELD_SHARDS = 1 << 18, 128 << 20, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Another well mixed number of each key, for each level."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: the place of each in 0 to n - 1.

    ``bits`` holds all levels, level ``i`` from bit ``starts[i]`` on; ``before`` counts the set bits before each word.
    """

    def __init__(self, bits: np.ndarray, starts: np.ndarray):
        self.bits, self.starts = bits, starts
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        words, starts, at = [], [0], 0
        while len(keys):
            size = max(64, -(-len(keys) * 3 // 2) + 63 & ~63)
            place = (_mixed(keys, len(words)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            at += size
            starts.append(at)
            keys = keys[~alone[place]]
        return cls(np.concatenate(words) if words else np.zeros(0, "<u8"), np.array(starts, np.int64))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; of one that was not built in, that of some other or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (start, end) in enumerate(zip(self.starts[:-1], self.starts[1:])):
            if not len(left):
                break
            at = start + (_mixed(keys[left], level) % np.uint64(end - start)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below).astype(np.int64)
            left = left[~hit]
        return out


class Shard:
    """Fingerprints, document counts and largest ids of a shard's keys at the places that its perfect hash gives."""

    def __init__(self, hashed: PerfectHash, fingerprint: np.ndarray, count: np.ndarray, owner: np.ndarray, rest: np.ndarray):
        self.hashed, self.fingerprint, self.count, self.owner = hashed, fingerprint, count, owner
        #: First hashes of the last places: keys whose first hash another key has too (at 64 bits hardly ever any).
        self.rest = rest

    @classmethod
    def build(cls, h: np.ndarray, g: np.ndarray, count: np.ndarray, owner: np.ndarray) -> Shard:
        one = np.zeros(len(h), bool)
        one[np.unique(h, return_index=True)[1]] = True
        hashed = PerfectHash.build(h[one])
        order = np.concatenate([np.flatnonzero(one)[np.argsort(hashed.places(h[one]))], np.flatnonzero(~one)])
        return cls(hashed, g[order], count[order], owner[order], h[~one])

    def find(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys are in the index, and whether."""
        at = self.hashed.places(h)
        found = at >= 0
        found[found] = self.fingerprint[at[found]] == g[found]
        first = len(self.fingerprint) - len(self.rest)
        for k, other in enumerate(self.rest):
            same = (h == other) & (g == self.fingerprint[first + k])
            at[same], found[same] = first + k, True
        return at, found

    _ARRAYS = {"bits": "<u8", "starts": "<i8", "fingerprint": "<u8", "count": "<u4", "owner": "<i8", "rest": "<u8"}

    def packed(self) -> dict[str, bytes]:
        parts = {"bits": self.hashed.bits, "starts": self.hashed.starts, "fingerprint": self.fingerprint, "count": self.count, "owner": self.owner, "rest": self.rest}
        return {name: parts[name].astype(kind).tobytes() for name, kind in self._ARRAYS.items()}

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> Shard:
        bits, starts, *rest = (np.frombuffer(row[name], kind) for name, kind in cls._ARRAYS.items())
        return cls(PerfectHash(bits, starts), *rest)


class Index:
    """The shards under ``path``, read when they are first asked for; at most ``held`` of them stay."""

    def __init__(self, path: str, shards: int, held: int):
        self.path, self.shards, self.held, self.open = path, shards, held, OrderedDict()

    def shard(self, k: int) -> Shard | None:
        if k not in self.open:
            while len(self.open) >= self.held:
                self.open.popitem(last=False)
            fs, path = file_system(f"{self.path}/shard={k}")
            there = fs.get_file_info(path).type == pafs.FileType.Directory
            rows = pq.read_table(path, filesystem=fs, partitioning=None).to_pylist() if there else []
            self.open[k] = Shard.unpacked(rows[0]) if rows else None
        self.open.move_to_end(k)
        return self.open[k]

    def drops(self, h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of each line (hashes, its document): whether another document keeps it."""
        out = np.zeros(len(h), bool)
        asked = np.flatnonzero((h != 0) | (g != 0))
        which = h[asked] % self.shards
        order = np.argsort(which, kind="stable")
        for rows in np.split(asked[order], np.flatnonzero(np.diff(which[order])) + 1) if len(asked) else ():
            shard = self.shard(int(h[rows[0]] % self.shards))
            if shard is not None:
                at, found = shard.find(h[rows].view(np.uint64), g[rows].view(np.uint64))
                out[rows[found]] = shard.owner[at[found]] != doc[rows[found]]
        return out


#: The index that this worker used last.
_last: dict[str, Index] = {}


def _opened(path: str, shards: int, held: int) -> Index:
    if path not in _last:
        _last.clear()
        _last[path] = Index(path, shards, held)
    return _last[path]


def _hashed(df: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """``row`` (all columns of ``df``), ``doc``, ``c``, and the hashes ``h`` and ``g`` of each line's key; zeros for short ones."""
    rows = bounded_batches(df).select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc"), text_or_empty(text).alias("c"))

    key = F.transform(F.split("c", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    low = F.transform("key", lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER)))
    hashed = lambda *salt: F.transform("low", lambda x: F.when(F.length(x) >= min_chars, F.xxhash64(*salt, x)).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("key", key).withColumn("low", low)  # each step once for both hashes
    return rows.withColumns({"h": hashed(), "g": hashed(F.lit("line"))}).drop("key", "low")


def build_index(hashed: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[str, int, int]:
    """Path, number of shards and bytes of the index of the keys that ``min_docs`` documents have."""
    pairs = F.array_distinct(F.filter(F.arrays_zip("h", "g"), lambda p: (p["h"] != 0) | (p["g"] != 0)))
    lines = hashed.select("doc", F.explode(pairs).alias("p")).select("doc", "p.h", "p.g")
    # by (key, document) first, then by key with partial sums: a very frequent line is spread by its documents
    counted = lines.groupBy("h", "g").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("owner")).where(F.col("n") >= min_docs)
    counted = materialize(counted, "shared-lines")
    total = counted.count()
    shards = max(1, math.ceil(total / shard_keys))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.build(frame["h"].to_numpy().view(np.uint64), frame["g"].to_numpy().view(np.uint64), np.minimum(frame["n"].to_numpy(), 2**32 - 1), frame["owner"].to_numpy())
        return pd.DataFrame([shard.packed() | {"shard": frame["shard"].iloc[0]}])

    path = scratch(hashed.sparkSession, "line-index")
    schema = ", ".join(f"{name} binary" for name in Shard._ARRAYS) + ", shard int"
    counted.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, schema).write.partitionBy("shard").parquet(path)
    return path, shards, 21 * total + 1024 * shards


def _probe_held(hashed: DataFrame, path: str, shards: int) -> DataFrame:
    """``hashed`` with ``drop``, the places of the lines that go; each worker holds the whole index."""

    @F.pandas_udf("array<int>")
    def drop(doc: pd.Series, h: pd.Series, g: pd.Series) -> pd.Series:
        sizes = h.map(len).to_numpy()
        every = _opened(path, shards, shards).drops(np.concatenate(h.to_numpy()), np.concatenate(g.to_numpy()), np.repeat(doc.to_numpy(), sizes)) if len(h) else np.zeros(0, bool)
        return pd.Series([np.flatnonzero(x).astype(np.int32) for x in np.split(every, np.cumsum(sizes)[:-1])])

    return hashed.withColumn("drop", drop("doc", "h", "g"))


def _probe_dealt(hashed: DataFrame, path: str, shards: int) -> DataFrame:
    """As ``_probe_held``, for an index of any size: lines go to tasks by shard (large shards are split among several), hits come back."""
    known = hashed.withColumns({"t": F.xxhash64("c"), "u": F.xxhash64(F.lit("text"), "c")})  # rows with equal ids and texts lose the same lines
    asked = known.select("doc", "t", "u", F.posexplode(F.arrays_zip("h", "g"))).select("doc", "t", "u", "pos", "col.h", "col.g").where("h <> 0 OR g <> 0")

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _opened(path, shards, HELD_SHARDS)
        for batch in batches:
            hit = index.drops(*(batch.column(c).to_numpy() for c in ("h", "g", "doc")))
            yield batch.select(["doc", "t", "u", "pos"]).filter(pa.array(hit))

    dealt = asked.withColumn("shard", F.pmod("h", F.lit(shards))).hint("rebalance", "shard").sortWithinPartitions("shard")
    hits = dealt.select("doc", "t", "u", "pos", "h", "g").mapInArrow(probe, "doc long, t long, u long, pos int").groupBy("doc", "t", "u").agg(F.collect_set("pos").alias("drop"))
    return known.join(hits, ["doc", "t", "u"], "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))


def drop_repeated_lines(
    df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text", held_bytes: int = HELD_BYTES, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """``df`` with ``text`` without the lines that ``min_docs`` documents share, but for the largest document's; ``n_lines`` before, ``n_dropped``."""
    hashed = _hashed(df, doc_id, text, min_chars)
    path, shards, size = build_index(hashed, min_docs, shard_keys)
    probed = (_probe_held if size <= held_bytes else _probe_dealt)(hashed, path, shards)
    lines = F.split("c", "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "drop"), lambda i: F.get(lines, i)), "\n")
    probed = probed.select("row", F.when(F.size("drop") == 0, F.col("c")).otherwise(kept).alias("kept"), F.size(lines).cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"))
    same = [F.col(f"row.`{c}`").alias(c) if c != text else F.col("kept").alias(c) for c in df.columns if c not in ("n_lines", "n_dropped")]
    return probed.select(*same, "n_lines", "n_dropped")


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    rows = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
