"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventflow.llm import decontaminate, html, katz, line_dedup, mixing, phrases, pii, quality, simhash, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op6_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.repeated_phrases(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # failed_rule follows the measured order of the cascade, so reruns may differ in it; the verdict doesn't
    return quality.quality_features(_table(spark, sf_dir, "documents")).drop("failed_rule")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_main_text, op2_katz_scores, op3_benchmark_leaks, op4_token_counts, op5_mix_sources, op6_repeated_phrases, op7_quality_rules, op8_line_dedup, op9_personal_data, op10_simhash)}


_WORD = r"[^\x20\x09-\x0D]+"
ORACLES = {
    "op6_repeated_phrases": rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
windows AS (SELECT row, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM docs WHERE len(words) >= 35)),
again AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
spread AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
marked AS (SELECT s.row, s.i, word, max(a.i) OVER (PARTITION BY s.row ORDER BY s.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM spread s LEFT JOIN again a ON a.row = s.row AND a.i = s.i)
SELECT d.doc_id, count(m.word) AS n_words, count(*) FILTER (WHERE m.gone) AS n_removed, sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (WHERE NOT m.gone), '')) AS kept_sha256
FROM docs d LEFT JOIN marked m ON m.row = d.row GROUP BY d.row, d.doc_id""",
    "op7_quality_rules": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, t, words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents)),
windows AS (SELECT row, i, words[i:i + 4] AS w FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM docs WHERE len(words) >= 5)),
again AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, w) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY row),
base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\t]*[-*•‣▪●]'))) AS bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\t\r]*$'))) AS ellipses,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower, length(regexp_replace(t, '[^!?]', '', 'g')) AS marks, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits
  FROM docs LEFT JOIN covered USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > CAST(0.3 AS DOUBLE) * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR n_dup_lines >= 3 AND n_dup_lines > CAST(0.3 AS DOUBLE) * n_lines OR upper > lower OR marks > CAST(0.3 AS DOUBLE) * n_words OR digits > CAST(0.5 AS DOUBLE) * word_chars
            OR n_lines >= 5 AND bullets > CAST(0.9 AS DOUBLE) * n_lines OR n_lines >= 5 AND ellipses > CAST(0.5 AS DOUBLE) * n_lines) AS kept
FROM base""",
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
common AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE c.keeper IS NOT NULL AND c.keeper <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.keeper IS NULL OR c.keeper = l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN common c USING (k) GROUP BY l.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
