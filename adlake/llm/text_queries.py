"""Queries that SQL can express: quality rules and line dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.llm import line_spread, quality
from adlake.llm.common import table
from adlake.llm.registry import registered

_STOPS = ", ".join(
    f"'{word}'"
    for word in sorted({*quality.STOP_WORDS, *(w.capitalize() for w in quality.STOP_WORDS)})
)

QUALITY_SQL = rf"""
WITH d AS (SELECT *, row_number() OVER () AS k, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(body, chr(10)),
          lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT k, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
txt AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM win),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS c FROM txt) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT p) AS n FROM
        (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY k),
m AS (SELECT doc_id, cast(len(words) AS BIGINT) AS n_words,
        cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        cast(len(regexp_extract_all(body, '{quality.SYMBOLS}')) AS BIGINT) AS n_symbols,
        cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        cast(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        len(lines) AS n_lines,
        len(list_filter(words, lambda x: x IN ({_STOPS}))) AS n_stop,
        len(regexp_extract_all(body, '!')) AS n_bang,
        len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_dots
      FROM w LEFT JOIN cov USING (k)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND word_chars >= 2.5 * n_words AND word_chars <= 12 * n_words
  AND n_symbols <= 0.1 * n_words AND n_bang <= 0.5 * n_words AND n_stop >= 0.05 * n_words
  AND n_dup_lines <= 0.5 * n_lines AND n_bullet <= 0.9 * n_lines
  AND n_dots <= 0.3 * n_lines AS kept
FROM v
"""


@registered(QUALITY_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the threshold table for every document."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


LINES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, text,
             string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT k, coalesce(source, chr(0)) AS source, unnest(lines) AS line,
        generate_subscripts(lines, 1) AS i FROM d),
worded AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
spread AS (SELECT line FROM worded GROUP BY line
           HAVING count(DISTINCT source) >= {line_spread.MIN_SITES}),
marked AS (SELECT w.k, w.i, w.line, s.line IS NOT NULL AS gone
           FROM worded w LEFT JOIN spread s ON w.line = s.line),
sums AS (SELECT k, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone,
           NOT bool_and(gone) AS cut
         FROM marked GROUP BY k),
left_over AS (SELECT l.k, string_agg(l.line, chr(10) ORDER BY l.i) AS text
              FROM l LEFT JOIN marked m ON l.k = m.k AND l.i = m.i
              WHERE NOT coalesce(m.gone, false) GROUP BY l.k)
SELECT d.doc_id,
  CASE WHEN s.cut AND s.n_gone > 0 THEN coalesce(o.text, '') ELSE d.text END AS text,
  cast(coalesce(s.n_lines, 0) AS BIGINT) AS n_lines,
  cast(CASE WHEN s.cut THEN s.n_gone ELSE 0 END AS BIGINT) AS n_removed
FROM d LEFT JOIN sums s ON d.k = s.k LEFT JOIN left_over o ON d.k = o.k
"""


@registered(LINES_SQL)
def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sites share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cleaned = line_spread.drop_spread_lines(docs)
    return cleaned.select(
        F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed"
    )
