"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprint, jaccard_join, language_id, license_scan, line_dedup, mixing, quality, suffix_dedup, warc



def _columns(query: Callable[[SparkSession, str], DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark, sf_dir).select(*names)


QUERIES = {
    "op1_license": license_scan.op1_license,
    "op2_language": language_id.op2_language,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_warc": warc.op4_warc,
    "op5_quality": quality.op5_quality,
    "op6_suffix": suffix_dedup.op6_suffix,
    "op7_bpe": bpe.op7_bpe,
    "op8_jaccard": jaccard_join.op8_jaccard,
    "op9_mixing": mixing.op9_mixing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    # The columns of operators without SQL that SQL can express
    "fingerprint_edits": _columns(fingerprint.op3_fingerprint, "doc_id", "n_chars", "edited_sha256"),
    "quality_base": _columns(quality.op5_quality, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "bpe_decoded": _columns(bpe.op7_bpe, "doc_id", "decoded_sha256"),
}
FINGERPRINT_EDITS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, t, length(t) // 3 AS n,
        coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS following FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - n) || substr(following, 1, n)) AS edited_sha256 FROM e
"""
QUALITY_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM w),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n >= 2) GROUP BY doc_id),
b AS (SELECT d.doc_id, len(words) AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
        coalesce(r.n, 0) AS n_repeat_words
      FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
FROM b
"""
BPE_DECODED_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"
ORACLE_SQL: dict[str, str] = {
    "op1_license": license_scan.OP1_SQL,
    "op4_warc": warc.OP4_SQL,
    "op6_suffix": suffix_dedup.OP6_SQL,
    "op8_jaccard": jaccard_join.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "fingerprint_edits": FINGERPRINT_EDITS_SQL,
    "quality_base": QUALITY_BASE_SQL,
    "bpe_decoded": BPE_DECODED_SQL,
}
