"""DuckDB SQL for queries whose methods are not SQL but whose results are: plain versions, quadratic in
places, for small tables."""

from __future__ import annotations

from . import quality

_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (SELECT DISTINCT k, array_to_string(ws[i:i + 4], ' ') || CASE WHEN len(ws) < 5 THEN ' <' ELSE '' END AS g FROM (SELECT k, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k),
l AS (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT c.a AS k, min(d.doc_id) AS least FROM c JOIN d ON d.k = c.b GROUP BY c.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m.least, doc_id))::BIGINT AS component_id FROM d LEFT JOIN n USING (k) LEFT JOIN m USING (k)"""

WORD_WINDOWS = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS.format("text")} AS ws FROM documents),
w AS (SELECT k, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
r AS (SELECT DISTINCT k, unnest(range(i, i + 13)) AS p FROM w JOIN m USING (g) WHERE doc_id > least),
e AS (SELECT k, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
a AS (SELECT k, string_agg(w, ' ' ORDER BY p) AS kept, count(*) AS n FROM e ANTI JOIN r USING (k, p) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (k)"""

def quality_rules() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality.RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {_WORDS.format("text")} AS ws FROM documents),
w AS (SELECT k, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM w) WHERE c > 1) GROUP BY k),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
  len(list_filter(ws, lambda w: NOT regexp_matches(w, '^([0-9]{{3}}|[0-9]{{1,2}}$)') AND regexp_matches(w, '^([A-Za-z0-9]|[^\x00-\x7F]|(?s:.)[A-Za-z])'))) AS n_wordlike FROM d LEFT JOIN r USING (k)),
f AS (SELECT *, ({bits})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {quality.BASE.mask()} <> 0 AS base_failed, failed & {quality.V1.mask()} = 0 AS kept, failed FROM f"""
