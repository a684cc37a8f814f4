"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from tarifa.llm.merkle import PHRASE

#: Every 100-byte window by its hash: the first of equal ones stays; runs of the others are cut out of the hexadecimal text.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
t AS (SELECT doc_id, x, CAST(length(x) / 2 AS BIGINT) AS n_bytes FROM d),
w AS (SELECT doc_id, unnest(range(0, n_bytes - 99)) AS s, unnest(list_transform(range(0, n_bytes - 99), lambda i: md5_number(substr(x, 2 * i + 1, 200)))) AS h FROM t WHERE n_bytes >= 100),
g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM w),
f AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM g WHERE k > 1),
i AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM f),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT t.doc_id, x, n_bytes, a, b, coalesce(lag(b) OVER (PARTITION BY t.doc_id ORDER BY a), 0) AS from_, max(b) OVER (PARTITION BY t.doc_id) AS last FROM t LEFT JOIN r ON t.doc_id = r.doc_id)
SELECT doc_id, max(n_bytes) AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans,
  sha256(unhex(coalesce(string_agg(CASE WHEN a IS NOT NULL THEN substr(x, 2 * from_ + 1, 2 * (a - from_)) END, '' ORDER BY a), '') || substr(max(x), 2 * coalesce(max(last), 0) + 1))) AS kept_sha256
FROM k GROUP BY doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM m
"""


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"

def _tree(text: str) -> str:
    phrases = f"list_transform(regexp_extract_all(p, '{PHRASE}', 0), lambda y: md5(y))"
    paragraph = _let(phrases, 'l', "{'h': sha256(list_aggregate(list_concat([''], l), 'string_agg', '')), 's': list_aggregate(list_concat([''], list_transform(l, lambda y: left(y, 8))), 'string_agg', '')}")
    section = _let(f"list_transform(string_split(s, chr(10)), lambda p: {paragraph})",'q',"{'h': sha256(list_aggregate(list_transform(q, lambda y: y.h), 'string_agg', '')), 's': list_aggregate(list_transform(q, lambda y: ':' || left(y.h, 16) || y.s), 'string_agg', '')}")
    return _let(f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: {section})",'t',"sha256(list_aggregate(list_transform(t, lambda y: y.h), 'string_agg', '')) || list_aggregate(list_transform(t, lambda y: '/' || left(y.h, 16) || y.s), 'string_agg', '')")


def _both(a: str, b: str) -> str:
    return f"list_distinct(list_filter({a}, lambda x: list_contains({b}, x)))"


def _less(a: str, b: str) -> str:
    return f"list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x)))"


def _paragraphs(s: str) -> str:
    return f"flatten(list_transform({s}, lambda x: string_split(x, ':')[2:]))"


def _phrases(s: str) -> str:
    return f"list_distinct(flatten(list_transform({s}, lambda x: regexp_extract_all(substr(x, 17), '.{{8}}', 0))))"


def _held(s: str) -> str:
    return f"coalesce(list_sum(list_transform({s}, lambda x: (length(x) - 16) // 8)), 0)"


MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS c FROM documents),
n AS (SELECT doc_id, c, coalesce(lead(c) OVER (ORDER BY doc_id, c), first_value(c) OVER (ORDER BY doc_id, c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS following FROM d),
e AS (SELECT doc_id, c, following, left(c, length(c) - length(c) // 2) || left(following, length(c) // 2) AS e FROM n),
f AS (SELECT doc_id, length(c) AS n_chars, sha256(e) AS edited_sha256, {_tree('c')} AS fp, {_tree('e')} AS ef, {_tree('following')} AS nf FROM e),
p AS (SELECT doc_id, unnest(['e', 'n']) AS which, fp, unnest([ef, nf]) AS other FROM f),
s AS (SELECT *, string_split(fp, '/')[2:] AS sa, string_split(other, '/')[2:] AS sb FROM p),
q AS (SELECT doc_id, which, fp, other, sa, sb, {_paragraphs(_both('sa','sb'))} AS ps, {_paragraphs(_less('sa','sb'))} AS pa, {_paragraphs(_less('sb','sa'))} AS pb FROM s),
l AS (SELECT doc_id, which, fp, other, sa, sb, {_held('ps')} + {_held(_both('pa','pb'))} AS same, {_phrases(_less('pa','pb'))} AS la, {_phrases(_less('pb','pa'))} AS lb FROM q),
k AS (SELECT doc_id, which, CASE WHEN fp = other THEN 1.0 ELSE 2 * (same + len({_both('la','lb')}))::DOUBLE / greatest(2 * same + len(la) + len(lb), 1) END AS near,
  coalesce(list_sum(list_transform(sa, lambda s, i: CASE WHEN s IS NOT DISTINCT FROM sb[i] THEN 0 ELSE
    list_sum(list_transform(string_split(s, ':')[2:], lambda p, j: CASE WHEN p IS NOT DISTINCT FROM (string_split(coalesce(sb[i], ''), ':')[2:])[j] THEN 0 ELSE 1 END)) END)), 0)::BIGINT AS n_changed FROM l)
SELECT f.doc_id, n_chars, edited_sha256, fp AS fingerprint, ef AS edited_fingerprint, x.near AS near_edited, y.near AS near_next, x.n_changed
FROM f JOIN k x ON f.doc_id = x.doc_id AND x.which = 'e' JOIN k y ON f.doc_id = y.doc_id AND y.which = 'n'
"""


_KEY = "translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM d),
k AS (SELECT doc_id, i, x, {_KEY} AS k FROM e),
s AS (SELECT k, max(doc_id) AS owner FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, i, x, s.owner IS NOT NULL AND s.owner <> k.doc_id AS gone FROM k LEFT JOIN s ON k.k = s.k)
SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""


COLLOCATIONS = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS c FROM documents),
s AS (SELECT lang, unnest(string_split_regex(c, '[.,;:!?\\n\\x0b\\f\\r]')) AS piece FROM t),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM s),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
q AS (SELECT lang, row_number() OVER () AS pid, w FROM p),
e AS (SELECT lang, pid, unnest(w) AS x, unnest(range(len(w))) AS i FROM q),
v AS (SELECT lang, x, lead(x) OVER (PARTITION BY pid ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY pid ORDER BY i) AS z FROM e),
f AS MATERIALIZED (SELECT lang, 1 AS size, x AS phrase, count(*) AS f FROM v GROUP BY lang, x UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM v WHERE y IS NOT NULL GROUP BY lang, x, y
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM v WHERE z IS NOT NULL GROUP BY lang, x, y, z),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND f >= 10),
k AS (SELECT *, array_to_string(w[1:k], ' ') AS left_, array_to_string(w[k + 1:], ' ') AS right_ FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
l AS (SELECT k.lang, k.size, k.phrase, k.a, k.k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = left_ JOIN f y ON y.lang = k.lang AND y.phrase = right_),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS best FROM l),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE size = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE size = 3) GROUP BY lang, phrase),
r AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE b.best = 1 AND (i.longer IS NULL OR 100 * i.longer < 50 * b.a))
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n ON r.lang = n.lang WHERE rank <= 2000
"""
