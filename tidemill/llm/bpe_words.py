"""Byte-level BPE of a table of distinct words with Spark's higher-order functions.

The rank map is a literal: an array of buckets, each a map from a pair's hex bytes to its rank, found by the pair's hash,
since a lookup in a map of 50,000 entries would walk through it. For each word, `aggregate` folds one merge after another.
"""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.llm.bpe import VOCABULARY, ranks
from tidemill.llm.common import written

BUCKETS = 1 << 15
NONE = 1 << 30


def _table(path: str, spark) -> Column:
    """A literal array of BUCKETS strings 'hex=rank;...', cut into maps once, when the plan is made."""
    rank = ranks(path)
    rows = spark.createDataFrame([(k.hex(), v) for k, v in rank.items()], "h string, r int")
    slots = rows.groupBy(F.pmod(F.hash("h"), F.lit(BUCKETS)).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("h", "r"))).alias("m")).collect()
    buckets = [""] * BUCKETS
    for slot in slots:
        buckets[slot.b] = ";".join(f"{k}={v}" for k, v in slot.m.items())
    return F.transform(F.split(F.lit(",".join(buckets)), ","), lambda s: F.str_to_map(s, F.lit(";"), F.lit("=")))


def encode_words(words: DataFrame, path: str | None = None) -> DataFrame:
    """`words` (a column `word`) with ids, an array of ints. Null: null; empty: no ids."""
    table = _table(path or public_tokenizers.path(VOCABULARY), words.sparkSession)
    rank_of = lambda h: F.coalesce(F.element_at(F.get(table, F.pmod(F.hash(h), F.lit(BUCKETS))), h).cast("int"), F.lit(NONE))
    code = F.lower(F.hex(F.encode("word", "UTF-8")))
    n = F.length(code) / 2
    parts = F.when(F.length(code) > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.substring(code, 2 * i - 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))

    def step(held: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), lambda p, i: F.struct(rank_of(F.concat(p, F.get(held, i + 1))).alias("r"), i.alias("i")))
        best = F.array_min(pairs)
        merged = F.concat(
            F.slice(held, F.lit(1), best["i"]),
            F.array(F.concat(F.get(held, best["i"]), F.get(held, best["i"] + 1))),
            F.slice(held, best["i"] + 3, F.size(held)),
        )
        return F.when(best.isNotNull() & (best["r"] < NONE), merged).otherwise(held)

    whole = rank_of(code)
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("__parts"), F.lit(1))), F.col("__parts"), step)
    ids = F.when(whole < NONE, F.array(whole)).otherwise(F.transform(folded, rank_of))
    return words.withColumns({"__parts": parts}).withColumns({"ids": F.when(F.col("word").isNotNull(), ids)}).drop("__parts")


def split(docs: DataFrame, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, mark (which tells apart rows of one id that differ) and words, the matches of the pattern in order."""

    def run(batches):
        find = regex.compile(pattern).findall
        for batch in batches:
            found = [find(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["doc_id", "mark", "words"])

    kept = docs.select("doc_id", F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("mark"), "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, mark bigint, words array<string>")


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, mark and ids of every text with a word, all merges folded natively: each distinct word once, then joined back.

    Words go through the join by 64-bit hashes with their places. Every occurrence is a row, twice shuffled; see the README
    for what that takes. Rows that repeat doc_id and text come out once.
    """
    found = split(docs, pattern).dropDuplicates(["doc_id", "mark"])
    distinct = found.select(F.explode("words").alias("word")).distinct()
    known = written(encode_words(distinct, path).select(F.xxhash64("word").alias("h"), "ids"), "words")
    spots = found.select("doc_id", "mark", F.posexplode(F.transform("words", lambda w: F.xxhash64(w))).alias("at", "h"))
    parts = spots.join(known, "h").groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return parts.select("doc_id", "mark", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
