"""Document fingerprints: Merkle trees over sections, paragraphs and phrases.

Sections are separated by an empty line, paragraphs by a line end, and a paragraph falls into phrases: up to a sentence mark,
or to a word's end that its letters mark, so that phrases after an edit are found again. A phrase's node is the MD5
of its text; a paragraph's is the SHA-256 of its phrases' nodes, a section's that of its paragraphs' nodes, the root that of the
sections' nodes. A fingerprint is the tree as a string: the root, and for each section ``/`` and 16 digits of its node, for each of
its paragraphs ``:`` and 16 digits of its node and 8 of each of its phrases'. Roots are equal if and only if texts are.

Everything else is read from fingerprints. ``likeness`` goes down from the roots: equal sections are passed over with all
they hold, in the others equal paragraphs are, and in what is left phrases are compared; it is the share of phrases that both
trees have, 1 for equal roots. ``locate`` goes the same way and gives the paragraphs that differ.

All is DataFrame expressions. ``next_text`` gives each document its successor by id with one shuffle of
the texts, dealt out by ranges of ids whose bounds are ids of the table: the first text of a range is
sent to the range before as well.

Edge cases: a null text is empty, an empty text has one empty paragraph; a null doc_id comes after
all others; rows that share a doc_id follow each other in order of their text; the only row of a table
is its own successor; extra columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.llm.common import partitions, table, text_or_empty

_MARKS = ".!?;:,\u2026\u3002\uff01\uff1f\uff0c\u3001\u061f"
#: Phrases: at least 30 characters up to a word that ends in one of these letters, or up to a mark, or 120 characters. They cover a paragraph.
PHRASE = f"[^{_MARKS}]{{30,119}}?[aeoyt\u0430\u0435\u043e\u0438] +|[^{_MARKS}]{{1,120}}[{_MARKS}]* *|[{_MARKS}]+ *"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fingerprint(text: str) -> str:
    """SQL for the fingerprint of the text expression ``text``."""
    phrases = f"transform(regexp_extract_all(p, '{PHRASE}', 0), x -> md5(CAST(x AS binary)))"
    paragraph = _let(phrases, "l", "named_struct('h', sha2(array_join(l, ''), 256), 's', array_join(transform(l, x -> left(x, 8)), ''))")
    section = _let(
        f"transform(split(s, '\\n'), p -> {paragraph})",
        "q",
        "named_struct('h', sha2(array_join(q.h, ''), 256), 's', array_join(transform(q, x -> concat(':', left(x.h, 16), x.s)), ''))",
    )
    return _let(
        f"transform(split({text}, '\\n\\n'), s -> {section})", "t", "concat(sha2(array_join(t.h, ''), 256), array_join(transform(t, x -> concat('/', left(x.h, 16), x.s)), ''))"
    )


def _sections(tree: str) -> str:
    return f"slice(split({tree}, '/'), 2, 1000000000)"


def _paragraphs(sections: str) -> str:
    return f"flatten(transform({sections}, s -> slice(split(s, ':'), 2, 1000000000)))"


def _phrases(paragraphs: str) -> str:
    return f"flatten(transform({paragraphs}, p -> regexp_extract_all(substring(p, 17), '.{{8}}', 0)))"


def likeness(a: str, b: str) -> str:
    """SQL for the likeness, 0 to 1, of two fingerprint expressions."""
    held = "CAST(aggregate(%s, 0L, (n, p) -> n + (length(p) - 16) div 8) AS bigint)"  # phrases of paragraphs
    last = _let(
        f"named_struct('same', d.same + {held % 'array_intersect(d.pa, d.pb)'}, 'la', array_distinct({_phrases('array_except(d.pa, d.pb)')}), 'lb', array_distinct({_phrases('array_except(d.pb, d.pa)')}))",
        "e",
        "2.0D * (e.same + size(array_intersect(e.la, e.lb))) / greatest(2 * e.same + size(e.la) + size(e.lb), 1L)",
    )
    middle = _let(
        f"named_struct('same', {held % _paragraphs('array_intersect(c.sa, c.sb)')}, 'pa', {_paragraphs('array_except(c.sa, c.sb)')}, 'pb', {_paragraphs('array_except(c.sb, c.sa)')})", "d", last
    )
    return f"CASE WHEN {a} = {b} THEN 1.0D ELSE {_let(f'named_struct({chr(39)}sa{chr(39)}, {_sections(a)}, {chr(39)}sb{chr(39)}, {_sections(b)})', 'c', middle)} END"


def locate(a: str, b: str) -> str:
    """SQL for the array of (section, paragraph), from 0, of the nodes of the first fingerprint that differ from the second's at the same place."""
    paragraphs = "slice(split(%s, ':'), 2, 1000000000)"
    changed = _let(
        f"named_struct('a', {paragraphs % 's'}, 'b', {paragraphs % 'coalesce(get(c.b, i), {0})'.format(repr(''))})",
        "d",
        "filter(transform(d.a, (p, k) -> CASE WHEN left(p, 16) <=> left(get(d.b, k), 16) THEN NULL ELSE named_struct('section', i, 'paragraph', k) END), x -> x IS NOT NULL)",
    )
    none = "CAST(array() AS array<struct<section: int, paragraph: int>>)"
    return _let(
        f"named_struct('a', {_sections(a)}, 'b', {_sections(b)})",
        "c",
        f"flatten(transform(c.a, (s, i) -> CASE WHEN left(s, 16) <=> left(get(c.b, i), 16) THEN {none} ELSE {changed} END))",
    )


def next_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, c, fp, following, following_fp: text and fingerprint of each row and of the next by doc_id (after the last: the first)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("c"))
    n = 4 * partitions(docs.sparkSession)
    found = rows.select(F.percentile_approx("doc_id", [i / n for i in range(n)], 100 * n)).first()[0]
    bounds = sorted(set(found or [0]))
    last = len(bounds) - 1
    array = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
    steps = "array(" + ", ".join(str(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)) + ")"
    # binary search: how many bounds are not above the id
    count = f"aggregate({steps}, 0, (lo, s) -> CASE WHEN lo + s <= {len(bounds)} AND get({array}, lo + s - 1) <= doc_id THEN lo + s ELSE lo END)"
    rows = rows.withColumn("range", F.expr(f"coalesce(CASE WHEN doc_id IS NULL THEN {last} ELSE greatest({count} - 1, 0) END, {last})"))
    first = F.expr(f"get({array}, range) <=> doc_id")
    place = lambda at, helper, wrap: F.struct(at.alias("range"), F.lit(helper).alias("helper"), F.lit(wrap).alias("wrap"))
    lowest = F.col("doc_id").eqNullSafe(F.lit(bounds[0])) if found else F.col("doc_id").isNull()
    places = F.array_compact(
        F.array(
            place(F.col("range"), False, False),
            F.when(first & (F.col("range") > 0), place(F.col("range") - 1, True, False)),
            F.when(lowest, place(F.lit(last), True, True)),
        )
    )
    dealt = rows.select("doc_id", "c", F.expr(fingerprint("c")).alias("fp"), F.explode(places).alias("at")).select("doc_id", "c", "fp", "at.*")
    order = Window.partitionBy("range").orderBy("wrap", F.col("doc_id").asc_nulls_last(), "c")
    after = F.lead(F.struct("c", "fp")).over(order)
    return dealt.withColumn("after", after).where("NOT helper").select("doc_id", "c", "fp", F.col("after.c").alias("following"), F.col("after.fp").alias("following_fp"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every row."""
    return docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("c")).select("doc_id", F.length("c").cast("long").alias("n_chars"), F.expr(fingerprint("c")).alias("fingerprint"))


def op7_merkle(spark, sf_dir: str) -> DataFrame:
    """n_changed are the paragraphs of the text that are others in the edited one."""
    rows = next_text(table(spark, sf_dir, "documents"))
    half = "CAST(length(c) DIV 2 AS int)"
    edited = f"concat(substring(c, 1, length(c) - {half}), substring(following, 1, {half}))"
    found = _let(
        _let(edited, "e", f"named_struct('sha', sha2(e, 256), 'fp', {fingerprint('e')})"),
        "x",
        f"named_struct('edited_sha256', x.sha, 'edited_fingerprint', x.fp, 'near_edited', {likeness('fp', 'x.fp')}, 'near_next', {likeness('fp', 'following_fp')}, 'n_changed', CAST(size({locate('fp', 'x.fp')}) AS bigint))",
    )
    rows = rows.select("doc_id", F.length("c").cast("long").alias("n_chars"), F.col("fp").alias("fingerprint"), F.expr(found).alias("f"))
    return rows.select("doc_id", "n_chars", "f.edited_sha256", "fingerprint", "f.edited_fingerprint", "f.near_edited", "f.near_next", "f.n_changed")
