"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

from plinth.llm.quality import COMMON_WORDS, EVERY_WORD, LONG_WORDS, MAX_CLASS_DISTANCE, MAX_REFERENCE_SYMBOLS, MAX_SHORT_DISTANCE, MAX_WORD_DISTANCE, MIN_WORDS

#: Links of all pairs by a join on shingles, groups by walking the links.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM documents d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _term(p: str, q: str) -> str:
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"
    return f"{half(p, q)} + {half(q, p)}"


def _distance(shares: str, reference: str, n: int) -> str:
    return f"sqrt(greatest(list_sum(list_transform(range(1, {n + 1}), lambda i: {_term(f'{shares}[i]', f'{reference}[i]')})) / 2, 0.0))"


_COUNT = lambda pattern: f"length(x) - length(regexp_replace(x, '{pattern}', '', 'g'))"
_PLACES = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in COMMON_WORDS.items()) + " END"

#: Counts by regular expressions, references by language, and the distance to the nearest one.
OP2_SQL = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
f AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c > 1) GROUP BY 1),
l AS (SELECT *, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines, [{_COUNT('[a-z]')}, {_COUNT('[\\x20\\x09-\\x0D]')}, {_COUNT('[A-Z]')}, {_COUNT('[0-9]')}, {_COUNT("[.,;:!?''\"()-]")}, {_COUNT('[^\\x00-\\x7F]')}] AS k FROM t),
c AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_COUNT('[#*$%&|<>]')} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, length(x) AS chars, list_append(k, length(x) - list_sum(k)) AS k, list_transform({_list(EVERY_WORD)}, lambda v: len(list_filter(w, lambda y: y = v))) AS m FROM l LEFT JOIN f USING (doc_id)),
u AS (SELECT lang, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM c WHERE lang IN {tuple(COMMON_WORDS)} AND n_words >= {MIN_WORDS} AND k[7] <= {MAX_REFERENCE_SYMBOLS} * chars),
rk AS (SELECT lang, list(s ORDER BY i) AS k FROM (SELECT lang, i, sum(k) / sum(sum(k)) OVER (PARTITION BY lang) AS s FROM u GROUP BY 1, 2) GROUP BY 1),
rm AS (SELECT lang, list_transform({_PLACES}, lambda v: s[list_position({_list(EVERY_WORD)}, v)]) AS m FROM (SELECT lang, list(s ORDER BY i) AS s FROM (SELECT lang, i, sum(m) / max(n) AS s FROM
  (SELECT lang, unnest(m) AS m, generate_subscripts(m, 1) AS i, sum(n_words) OVER (PARTITION BY lang) AS n FROM c WHERE lang IN {tuple(COMMON_WORDS)} AND n_words >= {MIN_WORDS} AND k[7] <= {MAX_REFERENCE_SYMBOLS} * chars) GROUP BY 1, 2) GROUP BY 1)),
r AS (SELECT lang, rk.k AS rk, list_append(rm.m, greatest(0.0, 1 - list_sum(rm.m))) AS rm FROM rk JOIN rm USING (lang)),
p AS (SELECT c.doc_id, list_transform(c.k, lambda z: z / greatest(chars, 1)) AS pk, list_transform({_PLACES.replace('lang', 'r.lang')}, lambda v: c.m[list_position({_list(EVERY_WORD)}, v)] / greatest(n_words, 1)) AS pm, r.rk, r.rm FROM c, r),
d AS (SELECT doc_id, min({_distance('pk', 'rk', 7)}) AS class_distance, min({_distance('list_append(pm, 1 - list_sum(pm))', 'rm', 21)}) AS word_distance FROM p GROUP BY 1),
v AS (SELECT c.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, coalesce((n_words >= {LONG_WORDS} AND (class_distance > {MAX_CLASS_DISTANCE} OR word_distance > {MAX_WORD_DISTANCE})) OR (n_words >= {MIN_WORDS} AND class_distance > {MAX_SHORT_DISTANCE}), false) AS unlike FROM c LEFT JOIN d USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT unlike AS kept FROM v
"""
