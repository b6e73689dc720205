"""SimHash near-duplicates by pivot distance tables (operator 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm.common import byte_texts, documents, splitmix, written
from tidemill.llm.graph import components

PIVOTS = 16
#: A bucket of fingerprints up to this size is compared pair by pair; a larger one goes by the keys of flipped bits.
BUCKET = 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 bits; bit i is 1 if it is set in over half the XXH64 (seed 42) of the text's shingles. No words: zero."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        ends = ends[words - 1 :]
        starts = starts[: len(ends)]
    else:
        starts, ends = starts[:1], ends[-1:]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        pairs = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())
        values = np.array([hashed(joined[s:e], 42) for s, e in pairs], np.uint64)
        votes += np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t, words) for t in byte_texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _coordinates(df: DataFrame, column: str, name: str) -> DataFrame:
    pivots = splitmix(PIVOTS, 7).view(np.int64).tolist()
    return df.withColumn(name, F.array(*[F.bit_count(F.col(column).bitwiseXOR(F.lit(p))) for p in pivots]))


def candidates(fps: DataFrame) -> DataFrame:
    """a, b and their pivot distances x, y: pairs of distinct fingerprints among which all that differ in up to two bits are linked.

    A pair that differs in two bits agrees in two of four 16-bit blocks, so each fingerprint stands in six buckets, whose
    members all meet. The members of a bucket larger than BUCKET instead meet at the 65 values they reach by flipping at most
    one bit: two of them share such a value just when they differ in at most two bits, and each is paired with the least of it.
    """
    table = written(_coordinates(fps.select("fp").distinct(), "fp", "at"), "pivots")
    block = [F.expr(f"shiftrightunsigned(fp, {16 * i}) & 65535") for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = F.array(*[F.shiftleft(F.lit(n).cast("bigint"), 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for n, (i, j) in enumerate(pairs)])
    keyed = table.select("fp", "at", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").count().filter("count > 1")
    small = keyed.join(sizes.filter(F.col("count") <= BUCKET).select("key"), "key")
    one, two = small.select("key", F.col("fp").alias("a"), F.col("at").alias("x")), small.select("key", F.col("fp").alias("b"), F.col("at").alias("y"))
    near = one.join(two, "key").filter("a < b")

    large = keyed.join(sizes.filter(F.col("count") > BUCKET).select("key"), "key").select("fp", "at").dropDuplicates(["fp"])
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    met = large.select("fp", "at", F.explode(flips).alias("key"))
    least = met.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a")
    star = _coordinates(met.join(least, "key").filter("a < fp"), "a", "x").select("a", F.col("fp").alias("b"), "x", F.col("at").alias("y"))
    return near.select("a", "b", "x", "y").unionByName(star)


def pruned(pairs: DataFrame, most: int = 2) -> DataFrame:
    """Pairs without those whose pivot distances differ by more than `most` in any coordinate: such differ in more bits."""
    return pairs.filter(~F.exists(F.zip_with("x", "y", lambda p, q: F.abs(p - q)), lambda d: d > most))


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """Pairs a < b of distinct fingerprints that connect all those differing in up to `most` (0 to 2) bits: candidates that
    the pivot table leaves, verified."""
    kept = pruned(candidates(fps), most)
    return kept.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).select("a", "b").distinct()


def groups(docs: DataFrame, words: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id reachable over links of fingerprints.

    Null texts and texts without words have fingerprint zero, which links as any other. Repeated rows share a
    fingerprint and come out once each. A null doc_id never names a component unless all its members are null.
    """
    found = written(fingerprints(docs, words), "fingerprints")
    firsts = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(found, most))
    joined = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(names, "root").select(F.col("fp").alias("key"), "component_id")
    return found.join(named, found.fp == named.key, "left").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """groups() over all documents: fingerprint and the smallest doc_id reachable over links of two bits or fewer."""
    found = groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
