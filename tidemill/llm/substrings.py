"""Substring dedup by seed and extend (operator 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents
from tidemill.llm.repeats import Plan, cut_repeats

#: Words of a repeat, and of the grams that anchors are.
LENGTH, GRAM = 35, 11


def cut_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove every word covered by a window of `length` words that starts anywhere else too; see cut_repeats."""
    return cut_repeats(docs, Plan("word", length, gram))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cut_substrings() over all documents: words, words removed, digest of what is kept; rows as in cut_repeats."""
    found = cut_substrings(documents(spark, sf_dir))
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows are compared as whole strings.
OP8_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
spots AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS pos FROM w),
keyed AS (SELECT doc_id, pos, array_to_string(list_slice(ws, pos, pos + 34), ' ') AS k FROM spots),
twice AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS i FROM keyed JOIN twice USING (k)),
lost AS (SELECT doc_id, list(i) AS l, count(*) AS c FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(ws) AS n, coalesce(c, 0) AS c,
    CASE WHEN l IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda p: NOT list_contains(l, p[2])), lambda p: p[1]) END AS k
  FROM w LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(c AS BIGINT) AS n_removed,
  sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
