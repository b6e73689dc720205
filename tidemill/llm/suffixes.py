"""Exact repeated byte strings over all documents (operator 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents
from tidemill.llm.repeats import Plan, cut_repeats

#: Bytes of a repeat, and of the grams that anchors are; rounds of extension before what is open is sorted.
LENGTH, GRAM, ROUNDS = 400, 160, 8


def cut_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that starts anywhere else too; see cut_repeats."""
    return cut_repeats(docs, Plan("byte", length, gram, rounds=ROUNDS))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cut_bytes() over all documents: bytes, bytes and spans removed, digest of what is kept; rows as in cut_repeats."""
    found = cut_bytes(documents(spark, sf_dir))
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
