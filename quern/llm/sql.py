"""SQL for DuckDB of operators whose modules hold none."""

from __future__ import annotations

from quern.llm.quality import ITERATIONS, MIN_WORDS, PRIOR_SHARE, START_ACCURACY, THRESHOLD

OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT doc_id, base, substr(x, (2 * base + 1)::BIGINT, 1198) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99, 500)) AS base FROM d) u),
w AS (
  SELECT doc_id, base + pos AS pos, md5(substr(y, (2 * pos + 1)::BIGINT, 200)) AS h
  FROM (SELECT doc_id, base, y, unnest(range(0, length(y) // 2 - 99)) AS pos FROM part) u),
dup AS (SELECT doc_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) > 1),
turn AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 0 ELSE 1 END AS new FROM dup),
isle AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isle FROM turn),
run AS (SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b FROM isle GROUP BY doc_id, isle),
cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM run GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN starts IS NULL THEN x ELSE
      array_to_string(list_transform(range(1, len(starts) + 2), lambda i:
        substr(x, (2 * (CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END) + 1)::BIGINT,
               (2 * ((CASE WHEN i > len(starts) THEN length(x) // 2 ELSE starts[i] END) - (CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END)))::BIGINT)), '') END AS y
  FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(y)) AS kept_sha256 FROM kept
"""

_N = "greatest(n_words, 1)"
_PLAIN = f"n_symbols < 0.1 * {_N} AND n_repeat_words < 0.25 * {_N} AND n_caps < 0.15 * {_N}"
_VOTES = f"""[CASE WHEN n_words < {MIN_WORDS} THEN -1 ELSE 0 END,
 CASE WHEN n_symbols > 0.2 * {_N} THEN -1 ELSE 0 END,
 CASE WHEN n_repeat_words > 0.35 * {_N} THEN -1 ELSE 0 END,
 CASE WHEN n_dup_lines >= 3 AND n_dup_lines > 0.3 * n_lines THEN -1 ELSE 0 END,
 CASE WHEN n_caps > 0.4 * {_N} THEN -1 ELSE 0 END,
 CASE WHEN {_PLAIN} AND word_chars >= 3 * {_N} AND word_chars <= 10 * {_N} THEN 1 WHEN word_chars > 14 * {_N} THEN -1 ELSE 0 END]"""
_ODDS = "list_sum(list_transform(range(1, 7), lambda k: p.v[k]::DOUBLE * ln(acc[k] / (1 - acc[k]))))"
_GOOD = f"1 / (1 + exp(-({_ODDS})))"
_RIGHT = "sum(p.n * CASE p.v[{k}] WHEN 1 THEN g WHEN -1 THEN 1 - g ELSE 0 END)"
_VOTED = "sum(CASE p.v[{k}] WHEN 0 THEN 0 ELSE p.n END)"
_PRIOR = f"({PRIOR_SHARE}::DOUBLE * sum(p.n))"
_STEP = ", ".join(
    f"greatest(0.05::DOUBLE, least(0.995::DOUBLE, ({_PRIOR} * {START_ACCURACY}::DOUBLE + {_RIGHT.format(k=k)}) / ({_PRIOR} + {_VOTED.format(k=k)})))" for k in range(1, 7)
)

OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT row_no, i, md5(concat_ws(' ', w[i], w[i + 1], w[i + 2])) AS h FROM (SELECT row_no, w, unnest(range(1, len(w) - 1)) AS i FROM w) u),
twice AS (SELECT row_no, i FROM g QUALIFY count(*) OVER (PARTITION BY row_no, h) > 1),
covered AS (SELECT row_no, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) o(k) GROUP BY row_no),
c AS (
  SELECT w.row_no, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(regexp_extract_all(text, '[A-Z][A-Z]+'))::BIGINT AS n_caps,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON w.row_no = covered.row_no),
f AS (SELECT *, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM c),
voted AS (SELECT *, {_VOTES} AS v FROM f),
p AS (SELECT v, count(*)::DOUBLE AS n FROM voted GROUP BY v),
em(step, acc) AS (
  SELECT 0, [{", ".join([f"{START_ACCURACY}::DOUBLE"] * 6)}]
  UNION ALL
  SELECT any_value(step) + 1, [{_STEP}]
  FROM (SELECT step, p, acc, {_GOOD} AS g FROM em, p WHERE step < {ITERATIONS}) q HAVING count(*) > 0),
scored AS (SELECT p.v AS v, {_GOOD} AS quality FROM p, em WHERE step = {ITERATIONS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND quality >= {THRESHOLD} AS kept,
  round(quality, 6) AS quality
FROM voted JOIN scored ON voted.v = scored.v
"""
