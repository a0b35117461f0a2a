"""Plain SQL for the results of operators whose method SQL can restate exactly.

The statements compare every text with every other by way of all shingles, or sort all windows; they are meant for
small tables.
"""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')".format
_FOLDED = _WORDS(_LOW("coalesce(text, '')"))


def _grams(n: str | int) -> str:
    return f"list_distinct(list_transform(generate_series(1, len(w) - {n} + 1), lambda k: array_to_string(w[k:k + {n} - 1], ' ')))"


def decontaminate(containment: float = 0.8, shingle: int = 5) -> str:
    return f"""
WITH iw AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, {_FOLDED} AS w FROM benchmark WHERE text IS NOT NULL),
ig AS (SELECT i, item_id, least(len(w), {shingle}) AS n, {_grams(f'least(len(w), {shingle})')} AS g FROM iw WHERE len(w) > 0),
it AS (SELECT i, item_id, n, len(g) AS item_shingles, unnest(g) AS g FROM ig),
dw AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {_FOLDED} AS w FROM documents),
dg AS (SELECT d, doc_id, n, unnest({_grams('n')}) AS g FROM dw, (SELECT DISTINCT n FROM it) WHERE len(w) >= n)
SELECT doc_id, item_id, item_shingles, count(*) AS shared_shingles
FROM dg JOIN it USING (n, g) GROUP BY d, doc_id, i, item_id, item_shingles HAVING count(*) >= {containment} * item_shingles - 1e-9
"""


def near_duplicates(shingle: int = 5, percent: int = 80) -> str:
    return f"""
WITH RECURSIVE dw AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
dg AS MATERIALIZED (SELECT doc_id, list_sort({_grams(f'least(len(w), {shingle})')}) AS g FROM dw WHERE len(w) > 0),
nodes AS MATERIALIZED (SELECT row_number() OVER () AS node, g, len(g) AS n FROM (SELECT DISTINCT g FROM dg)),
s AS MATERIALIZED (SELECT node, n, unnest(g) AS g FROM nodes),
links AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM s a JOIN s b ON a.g = b.g AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN ways e ON e.a = r.b),
own AS (SELECT n.node, n.n, d.doc_id FROM dg d JOIN nodes n ON n.g = d.g),
least_id AS (SELECT r.a AS node, min(o.doc_id) AS component_id FROM reach r JOIN own o ON o.node = r.b GROUP BY r.a)
SELECT doc_id, n AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM own JOIN least_id USING (node)
UNION ALL SELECT doc_id, CAST(0 AS BIGINT), doc_id, doc_id IS NOT NULL FROM dw WHERE len(w) = 0
"""


def language(top: int = 300) -> str:
    grams = (
        "flatten([list_filter(c, lambda x: x <> ' '), list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), "
        "list_transform(list_filter(range(1, len(c) - 1), lambda i: c[i + 1] <> ' '), lambda i: c[i] || c[i + 1] || c[i + 2])])"
    )
    # Equal counts rank by length (three letters, one, two), then by the letters.
    order = "n DESC, CASE length(g) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END, g"
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, n)) AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang,
  coalesce(xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) % 4 = 2, false) AS held_out,
  string_split(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) || ' ', '') AS c FROM documents, crc),
g AS MATERIALIZED (SELECT r, g, count(*) AS n FROM (SELECT r, unnest({grams}) AS g FROM d WHERE len(c) > 2) GROUP BY r, g),
profile AS MATERIALIZED (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY {order}) - 1 AS k
  FROM (SELECT lang, g, CAST(sum(n) AS BIGINT) AS n FROM g JOIN d USING (r) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, g) QUALIFY k < {top}),
own AS MATERIALIZED (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY {order}) - 1 AS k FROM g QUALIFY k < {top}),
far AS (SELECT r, lang, CAST(sum(CASE WHEN p.k IS NULL THEN {top} ELSE abs(p.k - o.k) END) AS BIGINT) AS distance, count(*) AS m
  FROM (SELECT r, g, k, lang FROM own, (SELECT DISTINCT lang FROM profile)) o LEFT JOIN profile p USING (lang, g) GROUP BY r, lang),
best AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - CAST(distance AS DOUBLE) / CAST({top} * m AS DOUBLE), CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN best b USING (r)
"""


def quality(least_words: int = 50, repeat_percent: int = 50, min_words: int = 8, max_covered: float = 0.3, max_repeat: float = 0.15, most_repeat: int = 100, levels: int = 16) -> str:
    """Texts of fewer than 2 ** levels words (65,536; the longest text of sf0.1 has 20,000). Windows of 2 ** k words get numbers by doubling, and the longest repeat
    of each text is put together from them bit by bit; the repeats' spans are all windows of min_words seen twice."""

    def seen_twice(n: int, name: str) -> str:
        """Words in windows of n that occur at least twice."""
        window = f"CASE WHEN i + {n} - 1 <= n_words THEN array_to_string(w[i:i + {n} - 1], ' ') END"
        return f"""{name}g AS (SELECT r, i, {window} AS g FROM p JOIN d USING (r)),
{name}m AS (SELECT r, i, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS twice FROM {name}g),
{name} AS MATERIALIZED (SELECT r, i, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM {name}m)"""

    parts = ["k0 AS MATERIALIZED (SELECT r, i, dense_rank() OVER (ORDER BY word) AS c FROM p)"]
    for k in range(1, levels):
        parts.append(f"k{k} AS MATERIALIZED (SELECT a.r, a.i, dense_rank() OVER (ORDER BY a.c, b.c) AS c FROM k{k - 1} a JOIN k{k - 1} b ON b.r = a.r AND b.i = a.i + {2 ** (k - 1)})")
    parts.append("l%d AS MATERIALIZED (SELECT r, i, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS len FROM p)" % levels)
    for k in reversed(range(levels)):
        parts.append(f"t{k} AS MATERIALIZED (SELECT a.r, a.i, a.len + {2**k} AS len, dense_rank() OVER (ORDER BY a.c, b.c) AS c FROM l{k + 1} a JOIN k{k} b ON b.r = a.r AND b.i = a.i + a.len)")
        parts.append(f"y{k} AS MATERIALIZED (SELECT DISTINCT r FROM (SELECT r FROM t{k} GROUP BY r, c HAVING count(*) > 1))")
        parts.append(f"l{k} AS MATERIALIZED (SELECT r, i, c, len FROM t{k} SEMI JOIN y{k} USING (r) UNION ALL SELECT r, i, c, len FROM l{k + 1} ANTI JOIN y{k} USING (r))")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS("coalesce(text, '')")} AS w, len({_WORDS("coalesce(text, '')")}) AS n_words FROM documents),
p AS MATERIALIZED (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d),
{seen_twice(3, 'three')},
{seen_twice(min_words, 'many')},
{', '.join(parts)},
three_n AS (SELECT r, count(*) AS n FROM three WHERE inside GROUP BY r),
many_n AS (SELECT r, CAST(coalesce(sum(strlen(word)) FILTER (inside), 0) AS DOUBLE) / CAST(sum(strlen(word)) AS DOUBLE) AS covered FROM many JOIN p USING (r, i) GROUP BY r),
longest AS (SELECT r, max(len) AS len FROM l0 GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM d),
m AS (SELECT doc_id, n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(x) - len(list_distinct(x)) AS n_dup_lines, coalesce(t.n, 0) AS n_repeat_words, coalesce(covered, CAST(0 AS DOUBLE)) AS covered_fraction, CASE WHEN g.len >= {min_words} THEN g.len ELSE 0 END AS longest_repeat
  FROM d JOIN lines USING (r) LEFT JOIN three_n t USING (r) LEFT JOIN many_n USING (r) LEFT JOIN longest g USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_fraction, longest_repeat,
  n_words < {least_words} OR 100 * n_repeat_words > {repeat_percent} * n_words AS base_failed,
  NOT (n_words < {least_words} OR 100 * n_repeat_words > {repeat_percent} * n_words) AND covered_fraction <= CAST({max_covered} AS DOUBLE) AND longest_repeat <= CAST({max_repeat} AS DOUBLE) * n_words AND longest_repeat <= {most_repeat} AS kept
FROM m
"""
