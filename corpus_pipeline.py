"""A training corpus from documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm import bpe, decontaminate, lines, neardup, quality
from tidemill.llm.common import written

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects go. Null and empty texts have under fifty words and go; repeated rows share their fate; all columns stay."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later three-line windows go; n_chars follows a text that changed.

    No row goes, not even one whose text is left empty. Null texts stay null; rows that repeat doc_id and text come out alike;
    columns named n_lines or n_removed would be overwritten, all others stay.
    """
    found = lines.drop_repeated_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.withColumns({"n_chars": n_chars}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id and then a hash of its text, of each group of near copies stays.

    Texts without words, null ones too, are one group; rows that repeat doc_id and text are one document and stay or go
    together; null doc_ids come last; all columns stay.
    """
    return neardup.drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay; all columns stay."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its bytes. Null and empty texts have none; repeated rows stay."""
    found = bpe.encode(docs.select("doc_id", "text", "lang", "source"))
    whole = F.sha2(bpe.decoded("ids"), 256) == F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return found.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", whole.alias("round_trip"))


STAGES = [("quality", quality_rules), ("lines", line_dedup), ("simhash", near_dedup), ("decontaminate", decontamination), ("bpe", tokens)]

#: Language models of text, fingerprints and latent vectors are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"stage-{name}")
    return docs
