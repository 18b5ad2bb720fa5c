"""DuckDB SQL for the queries that SQL expresses."""

from __future__ import annotations

import re

from . import chat_format, license_scan
from .host_rules import HOST_LIMIT, PRIOR_WEIGHT

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text, {WORDS} AS ws FROM documents
), words AS (
  SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM docs
), grams AS (
  SELECT rid, i, w || chr(10) || lead(w, 1) OVER o || chr(10) || lead(w, 2) OVER o || chr(10) || lead(w, 3) OVER o || chr(10) || lead(w, 4) OVER o AS g
  FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY rid
), lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), feats AS (
  SELECT d.rid, doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN lines l USING (rid) LEFT JOIN covered c USING (rid)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM feats
), hosts AS (
  SELECT host, count(*) AS n, sum(base_failed::INT) AS failed FROM judged GROUP BY host
), prior AS (
  SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM hosts
), weighted AS (
  SELECT m, least({PRIOR_WEIGHT[1]}, greatest({PRIOR_WEIGHT[0]}, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE {PRIOR_WEIGHT[1]} END)) AS weight FROM prior
), verdicts AS (
  SELECT host, (failed + m * weight) / (n + weight) AS host_rate FROM hosts, weighted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_rate <= {HOST_LIMIT} AS kept, j.host AS host, round(host_rate, 6) AS host_rate
FROM judged j JOIN verdicts v ON j.host IS NOT DISTINCT FROM v.host
"""


def _license_sql() -> str:
    names = license_scan.by_size(license_scan.TEMPLATES)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(n)}, [{', '.join(map(quoted, sorted(license_scan.bigrams(license_scan.TEMPLATES[n]))))}])" for i, n in enumerate(names))
    anchors = ", ".join(f"({quoted(g)}, {i}, {p}, {len(license_scan.normalised_words(license_scan.TEMPLATES[n]))})" for i, n in enumerate(names) for g, p in license_scan.anchor_bigrams(license_scan.TEMPLATES[n], license_scan.THRESHOLD))
    return rf"""
WITH templates(place, license, grams) AS (VALUES {rows}
), anchors(gram, place, off, n) AS (VALUES {anchors}
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT rid, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM docs
), laid AS (
  SELECT DISTINCT rid, place, n, greatest(i - off, 0) AS start
  FROM (SELECT rid, i, ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(len(ws) - 1)) AS i FROM words)) JOIN anchors USING (gram)
), windows AS (
  SELECT rid, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT rid, place, list_slice(ws, start + 1, start + n) AS w FROM laid JOIN words USING (rid))
), near AS (
  SELECT rid, place, license, 2 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM windows JOIN templates USING (place)
), units AS (
  SELECT DISTINCT rid, trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')) AS unit FROM (
    SELECT rid, unnest(string_split(text, chr(10))) AS unit FROM docs
    UNION ALL SELECT rid, unnest(string_split_regex(text, '\n[ \t\r]*\n')) FROM docs UNION ALL SELECT rid, text FROM docs)
), grams AS (
  SELECT rid, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM (SELECT rid, unit, string_split(unit, ' ') AS ws FROM units)
), scored AS (
  SELECT rid, unit, place, license, 2 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM grams, templates
  WHERE len(g) BETWEEN 1 AND 2 * len(grams) AND 2 * len(g) >= len(grams)
), found AS (
  SELECT rid, unit, arg_min(place, (-dice, place)) AS place, arg_min(license, (-dice, place)) AS license, max(dice) AS dice FROM scored WHERE dice >= {license_scan.THRESHOLD} GROUP BY rid, unit
  UNION ALL SELECT rid, NULL, place, license, dice FROM near WHERE dice >= {license_scan.THRESHOLD}
), best AS (
  SELECT rid, count(DISTINCT unit) AS n_matches, count(DISTINCT place) AS n_licenses, arg_min(license, (-dice, place)) AS license, max(dice) AS dice FROM found GROUP BY rid
)
SELECT doc_id, license, round(coalesce(dice, 0.0), 6) AS dice, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(n_licenses, 0)::BIGINT AS n_licenses FROM docs LEFT JOIN best USING (rid)
"""



def _chat_sql() -> str:
    probe = "</s>[INST] ok [/INST]"
    controls = "|".join(re.escape(c) for c in chat_format.CONTROLS)
    broken = lambda x: f"length({x}) + length({x}) - length(replace({x}, chr(27), '')) + len(regexp_extract_all({x}, '{controls}'))"
    marks = len(chat_format.OPEN + chat_format.TEXT + chat_format.CLOSE)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{probe}'), (-7, 1, 'assistant', '{probe}'))
), told AS (
  SELECT *, role = 'assistant' AS said, CASE WHEN role = 'assistant' THEN {broken('text')} + {len(chat_format.END)} ELSE {broken('role')} + {broken('text')} + {marks} END AS n FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (said), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (said), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""


_NEGATIVES = """
WITH own AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM own a JOIN own b ON a.vec_id % 50 = 0 AND a.uid <> b.uid
), positives AS (
  SELECT anchor, anchor_id, uid, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, uid) <= 5
), negatives AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY s.score DESC, s.vec_id, s.uid)::INT AS rank
  FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""

# crc32 of <doc_id>:<run>, byte by byte; the table of 256 values comes from its rule, and letters from U+00C0 on are two bytes.
# levenshtein() counts bytes there, so distances are taken of words in a code of one byte a letter.
_SPELLING = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), runs AS MATERIALIZED (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
  ) GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''), lambda ch:
    CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [(192 + (ord(ch) >> 6))::BIGINT, (128 + (ord(ch) & 63))::BIGINT] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM runs, crc
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
  ) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5
), coded AS MATERIALIZED (
  SELECT word, n, translate(word, (SELECT string_agg(chr((192 + i)::INT), '' ORDER BY i) FROM range(64) t(i)), (SELECT string_agg(chr((1 + i)::INT), '' ORDER BY i) FROM range(64) t(i))) AS code FROM words
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM coded a JOIN coded b ON substr(a.code, 1, 3) = substr(b.code, 1, 3) WHERE abs(length(a.code) - length(b.code)) <= 1 AND levenshtein(a.code, b.code) = 1
  UNION
  SELECT a.word, a.n, b.word, b.n FROM coded a JOIN coded b ON right(a.code, 3) = right(b.code, 3) WHERE abs(length(a.code) - length(b.code)) <= 1 AND levenshtein(a.code, b.code) = 1
), best AS (
  SELECT word, n, count(*)::BIGINT AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY 1, 2
), forms AS MATERIALIZED (
  SELECT word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), paths(word, stop) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON p.stop = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, p.stop AS root, f.n, f.n_near, f.form_n FROM forms f JOIN paths p ON f.word = p.word JOIN forms e ON p.stop = e.word WHERE e.form IS NULL
"""

ORACLES = {"op12_spelling_variants": _SPELLING, "op11_chat_format": _chat_sql(), "op13_hard_negatives": _NEGATIVES, "op8_host_quality_rules": _RULES, "op4_license_scan": _license_sql()}
