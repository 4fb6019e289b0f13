"""DuckDB SQL for the operators that SQL can express."""

from .quality import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

QUALITY_MEASURES = f"""
, parts AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM docs)
, grams AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 1)) AS i, w FROM parts WHERE len(w) >= 3)
, placed AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM grams)
, covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM placed, range(0, 3) AS r(k) WHERE c > 1 GROUP BY doc_id)
, counted AS (
  SELECT p.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop_words
  FROM parts p LEFT JOIN covered c ON p.doc_id = c.doc_id)
, judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
, verdicts AS (
  SELECT *, NOT base_failed AND n_words >= 50 AND n_repeat_words <= 0.5 * n_words
    AND word_chars BETWEEN 2 * n_words AND 12 * n_words AND n_symbols / n_words <= 0.1
    AND n_dup_lines <= 0.5 * n_lines AND n_upper / word_chars <= 0.3 AND n_stop_words / n_words >= 0.005 AS kept
  FROM judged)
"""

SQL = {
    "op9_quality_rules": f"""WITH docs AS (SELECT doc_id, text FROM documents) {QUALITY_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdicts""",
}
