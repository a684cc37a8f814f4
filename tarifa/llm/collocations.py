"""Collocations: phrases of two or three words that occur more often than their parts suggest.

Two passes over the texts. The first adds every word, pair and triple of words (per language) to a count-min sketch: ``ROWS`` rows
of counters that saturate at the threshold. Tasks send theirs as compressed slices of counters, which are summed slice by slice
in a stream; what is left is one bit for each counter, whether it reaches the threshold. A counter is never less than the count of
any phrase in it, so nothing frequent is lost. The second pass counts exactly, as words, only phrases whose counters reach the threshold and
whose inner words and pairs do; tasks add up theirs and send them sorted and compressed, by bucket. Then phrases are cut, scored and subsumed by joins over the frequent ones.

Counters grow with the input: about one for ``BYTES_A_COUNTER`` bytes of text, up to ``MAX_COUNTERS`` a row (bits of 128 MB in a worker, a
fixed bound). Beyond that more rare phrases pass into the second pass, which gets dearer, not wrong.

Work in a task is numpy over blocks of about ``BLOCK`` bytes of text (a longer text is a block of its own).

Edge cases: a null text is empty, a null language is ``und`` (as is a language of that name). Words are kept whole whatever their
length; ties are ranked by count, then phrase in byte order. Repeated rows count as often as they occur; ids are not used. An empty
table has no phrases. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.llm.common import bounded_batches, file_system, scratch, table, text_or_empty

MIN_COUNT, TOP, SUBSUMED_PERCENT = 10, 2000, 50
ROWS, BYTES_A_COUNTER, MIN_COUNTERS, MAX_COUNTERS, SLICE = 2, 16, 1 << 18, 1 << 29, 1 << 18
#: Bytes of text worked on at once; phrases gathered before a task's counters are sent.
BLOCK, GATHERED = 4 << 20, 8 << 20
#: Phrases that a task holds before it adds equal ones up and, if there are as many still, sends them; bytes of text to a bucket of phrases.
HELD, BYTES_A_BUCKET, MAX_BUCKETS = 2 << 20, 16 << 20, 1 << 14
#: Ranges by which the best phrases of a language are chosen before they meet.
SALTS = 64

_WORD, _SPACE, _BREAK = 0, 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = _SPACE
_KINDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _then(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    with np.errstate(over="ignore"):
        return _mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


@dataclass
class Block:
    """The words of some texts, in order: number in ``vocabulary`` and language of each, whether one and two more follow in its piece."""

    vocabulary: pa.StringArray
    languages: list[str]
    word: np.ndarray
    language: np.ndarray
    pairs: np.ndarray  # of each word but the last
    triples: np.ndarray  # of each word but the last two

    @classmethod
    def of(cls, texts: pa.StringArray, languages: pa.StringArray) -> Block:
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        kinds = _KINDS[raw]
        inside = kinds == _WORD
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        first = ends[:-1][ends[:-1] < ends[1:]]
        starts[first] = inside[first]  # a text begins a word of its own
        starts = np.flatnonzero(starts)
        breaks = np.cumsum(kinds == _BREAK, dtype=np.int32)[starts]
        text = np.searchsorted(ends, starts, side="right") - 1
        offsets = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, np.count_nonzero(inside)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])).dictionary_encode()
        known = languages.dictionary_encode()
        piece = breaks + text
        pairs = piece[1:] == piece[:-1]
        return cls(words.dictionary, known.dictionary.to_pylist(), words.indices.to_numpy(), known.indices.to_numpy()[text], pairs, pairs[1:] & pairs[:-1])

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the word, pair and triple at each place."""
        word = pd.util.hash_array(self.vocabulary.to_numpy(zero_copy_only=False), categorize=False)[self.word]
        one = _then(pd.util.hash_array(np.array(self.languages, object), categorize=False)[self.language], word) if len(word) else word.astype(np.uint64)
        two = _then(one[:-1], word[1:])
        return one, two, _then(two[:-1], word[2:])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    held, size = [], 0
    for batch in batches:
        for at in range(batch.num_rows):  # a few long texts in a batch don't meet in one block
            held.append(batch.slice(at, 1))
            size += held[-1].column("c").nbytes
            if size >= BLOCK:
                yield _block(held)
                held, size = [], 0
    if held:
        yield _block(held)


def _block(held: list[pa.RecordBatch]) -> Block:
    rows = pa.Table.from_batches(held).combine_chunks()
    return Block.of(*(rows.column(c).chunk(0).cast(pa.string()) for c in ("c", "lang")))


def _cells(h: np.ndarray, row: int, counters: int) -> np.ndarray:
    return ((h >> np.uint64(32 * row)) & np.uint64(counters - 1)).astype(np.uint32)


def sketch(rows: DataFrame, counters: int, min_count: int) -> str:
    """Where the bits of the merged sketch are: whether each counter reaches ``min_count``."""
    cap = min(min_count, 255)

    def send(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for row in range(ROWS if gathered else 0):
            cells = np.concatenate([_cells(h, row, counters) for h in gathered])
            cells.sort()
            cuts = np.searchsorted(cells, np.arange(0, counters + 1, SLICE, dtype=np.int64))
            for k in np.flatnonzero(np.diff(cuts)):
                counts = np.bincount(cells[cuts[k] : cuts[k + 1]] - np.uint32(k * SLICE), minlength=SLICE)
                blob = packer.compress(np.minimum(counts, cap).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "slice": pa.array([k], pa.int32()), "counts": pa.array([blob], pa.binary())})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for block in _blocks(batches):
            one, two, three = block.hashes()
            gathered += [one, two[block.pairs], three[block.triples]]
            size += sum(map(len, gathered[-3:]))
            if size >= GATHERED:
                yield from send(gathered)
                gathered, size = [], 0
        yield from send(gathered)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, key, total = zstandard.ZstdDecompressor(), None, np.zeros(SLICE, np.uint16)

        def done() -> Iterator[pa.RecordBatch]:
            if key is not None:
                yield pa.RecordBatch.from_pydict({"row": pa.array([key[0]], pa.int32()), "slice": pa.array([key[1]], pa.int32()), "bits": pa.array([np.packbits(total >= cap, bitorder="little").tobytes()], pa.binary())})

        for batch in batches:
            for row, k, blob in zip(*(batch.column(c).to_pylist() for c in ("row", "slice", "counts"))):
                if key != (row, k):
                    yield from done()
                    key, total = (row, k), np.zeros(SLICE, np.uint16)
                total += np.frombuffer(unpacker.decompress(blob), np.uint8)
                np.minimum(total, cap, out=total)
        yield from done()

    sent = rows.mapInArrow(count, "row int, slice int, counts binary")
    path = scratch(rows.sparkSession, "sketch")
    sent.repartition("row", "slice").sortWithinPartitions("row", "slice").mapInArrow(merge, "row int, slice int, bits binary").write.parquet(path)
    return path


#: The bits of the sketch that this worker used last.
_last: dict[str, np.ndarray] = {}


def _bits(path: str, counters: int) -> np.ndarray:
    if path not in _last:
        _last.clear()
        bits = np.zeros((ROWS, counters // 8), np.uint8)
        fs, where = file_system(path)
        for file in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(where)) if f.path.endswith(".parquet")):
            for batch in pq.ParquetFile(file, filesystem=fs).iter_batches(64):
                for row, k, b in zip(*(batch.column(c).to_pylist() for c in ("row", "slice", "bits"))):
                    bits[row, k * SLICE // 8 : (k + 1) * SLICE // 8] = np.frombuffer(b, np.uint8)
        _last[path] = bits
    return _last[path]


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for row in range(ROWS):
        cells = _cells(h, row, bits.shape[1] * 8)
        out &= (bits[row, cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
    return out


def _exact(block: Block, bits: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, lang, size, phrase, f) of the block's phrases that pass the sketch; size 0 has the number of words of each language.

    Phrases with the same first word lie in a few buckets: sorted they are sent in little space.
    """
    words, languages = len(block.vocabulary), len(block.languages)
    one, two, three = block.hashes()
    alive1 = _passes(bits, one)
    alive2 = block.pairs & alive1[:-1] & alive1[1:]
    alive2[alive2] = _passes(bits, two[alive2])
    alive3 = block.triples & alive2[:-1] & alive2[1:]
    alive3[alive3] = _passes(bits, three[alive3])

    hashed = pd.util.hash_array(block.vocabulary.to_numpy(zero_copy_only=False), categorize=False) if words else np.zeros(0, np.uint64)
    bucket = lambda first, second: ((hashed[first] + (hashed[second] & np.uint64(3))) % np.uint64(buckets)).astype(np.int32)

    def rows(size: int, language: np.ndarray, phrase: pa.Array, f: np.ndarray, where: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"bucket": pa.array(where), "lang": pa.array(block.languages, pa.string()).take(pa.array(language)), "size": pa.array(np.full(len(f), size, np.int32)), "phrase": phrase, "f": pa.array(f.astype(np.int64))})

    totals = np.bincount(block.language, minlength=languages)
    yield rows(0, np.arange(languages), pa.array([""] * languages, pa.string()), totals, np.zeros(languages, np.int32))
    # numbers of pairs are positions among those found, so that triples fit into 64 bits too
    keys1, f1 = np.unique(block.word[alive1].astype(np.int64) * languages + block.language[alive1], return_counts=True)
    keys2, at, f2 = np.unique((block.word[:-1][alive2].astype(np.int64) * languages + block.language[:-1][alive2]) * words + block.word[1:][alive2], return_inverse=True, return_counts=True)
    number = np.zeros(len(alive2), np.int64)
    number[alive2] = at
    keys3, f3 = np.unique(number[:-1][alive3] * words + block.word[2:][alive3], return_counts=True)
    text = lambda x: block.vocabulary.take(pa.array(x))
    pair = lambda keys: (keys // words // languages, keys // words % languages, keys % words)
    first, language, second = pair(keys2)
    phrases = pc.binary_join_element_wise(text(first), text(second), " ")
    yield rows(1, keys1 % languages, text(keys1 // languages), f1, (hashed[keys1 // languages] % np.uint64(buckets)).astype(np.int32))
    yield rows(2, language, phrases, f2, bucket(first, second))
    if len(keys3):
        inner, third = keys3 // words, keys3 % words
        yield rows(3, language[inner], pc.binary_join_element_wise(phrases.take(pa.array(inner)), text(third), " "), f3, bucket(first[inner], second[inner]))


_KEY = ["bucket", "lang", "size", "phrase"]


def _summed(held: list[pa.RecordBatch | pa.Table]) -> pa.Table:
    """Equal phrases added up."""
    return pa.concat_tables([pa.Table.from_batches([b]) if isinstance(b, pa.RecordBatch) else b for b in held]).group_by(_KEY).aggregate([("f", "sum")]).rename_columns([*_KEY, "f"])


def _send(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """A row for each bucket, language and size: its phrases in order, and their counts, compressed."""
    packer = zstandard.ZstdCompressor(level=3)
    table = table.sort_by([(c, "ascending") for c in _KEY]).combine_chunks()
    if not table.num_rows:
        return
    lang = table.column("lang").combine_chunks().dictionary_encode()
    key = np.stack([table.column("bucket").to_numpy(), table.column("size").to_numpy(), lang.indices.to_numpy()])
    starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
    for start, stop in zip(starts, np.append(starts[1:], key.shape[1])):
        part = table.slice(start, stop - start)
        phrases = "\n".join(part.column("phrase").to_pylist()).encode()  # no word has a line's end
        row = {"bucket": pa.array([key[0, start]], pa.int32()), "lang": pa.array([part.column("lang")[0].as_py()]), "size": pa.array([key[1, start]], pa.int32())}
        yield pa.RecordBatch.from_pydict(row | {"phrases": pa.array([packer.compress(phrases)]), "counts": pa.array([packer.compress(part.column("f").to_numpy().astype("<i8").tobytes())])})


def _received(batch: pa.RecordBatch, unpacker) -> Iterator[pa.RecordBatch]:
    for row in batch.to_pylist():
        phrases = unpacker.decompress(row["phrases"]).decode().split("\n")
        n = len(phrases)
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(np.full(n, row["bucket"], np.int32)), "lang": pa.array([row["lang"]] * n, pa.string()), "size": pa.array(np.full(n, row["size"], np.int32)),
            "phrase": pa.array(phrases, pa.string()), "f": pa.array(np.frombuffer(unpacker.decompress(row["counts"]), "<i8")),
        })


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang", max_counters: int = MAX_COUNTERS) -> DataFrame:
    """(lang, size, phrase, f): phrases of one to three words that occur ``min_count`` times or more, and the words of each language as size 0."""
    rows = bounded_batches(docs).select(text_or_empty(text).alias("c"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("c"))).first()[0] or 0
    counters = min(max_counters, max(MIN_COUNTERS, 1 << max(0, size // BYTES_A_COUNTER - 1).bit_length()))
    path = sketch(rows, counters, min_count)

    buckets = min(MAX_BUCKETS, max(16, size // BYTES_A_BUCKET))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, n = _bits(path, counters), [], 0
        for block in _blocks(batches):
            held += _exact(block, bits, buckets)
            n = sum(map(len, held))
            if n >= HELD:
                held = [_summed(held)]
                if len(held[0]) >= HELD // 2:
                    yield from _send(held.pop())
        if held:
            yield from _send(_summed(held))

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, bucket, held = zstandard.ZstdDecompressor(), None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                found = _summed(held)
                often = pc.or_(pc.equal(found.column("size"), 0), pc.greater_equal(found.column("f"), min_count))
                yield from found.filter(often).select(["lang", "size", "phrase", "f"]).to_batches()

        for batch in batches:
            for part in _received(batch, unpacker):
                if part.column("bucket")[0].as_py() != bucket:
                    yield from done()
                    bucket, held = part.column("bucket")[0].as_py(), []
                held.append(part)
                if len(part) and sum(map(len, held)) >= 2 * max(HELD // 2, len(held[0])):
                    held = [_summed(held)]
        yield from done()

    sent = rows.mapInArrow(count, "bucket int, lang string, size int, phrases binary, counts binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add_up, "lang string, size int, phrase string, f long")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang", subsumed_percent: int = SUBSUMED_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    path = scratch(docs.sparkSession, "phrases")
    found = frequent(docs, min_count, text, lang)
    found.write.partitionBy("size").option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.schema(found.schema).parquet(path)
    parts = found.where("size IN (1, 2)").select("lang", "phrase", "f")
    phrases = found.where("size IN (2, 3)").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, 3), " ").alias("rest"))
    cuts = cuts.join(parts.toDF("lang", "first", "l"), ["lang", "first"]).join(parts.toDF("lang", "rest", "r"), ["lang", "rest"])
    wide = "CAST({} AS decimal(38, 0))"
    score = F.expr(f"({wide.format(1000000)} * {wide.format('a')} * {wide.format('a')}) div ({wide.format('l')} * {wide.format('r')})")
    best = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    inner = phrases.where("size = 3").select("lang", F.col("f"), F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {subsumed_percent} * a")
    kept = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each range of a language first: no task gets a whole language
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
