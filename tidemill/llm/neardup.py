"""Near-duplicate documents by word-shingle similarity: SimHash links through the pivot table, then MinHash (the pipeline's stage)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemill.llm import simhash
from tidemill.llm.common import byte_texts, joined_words, mixed, release, same, splitmix, text_hash, written
from tidemill.llm.graph import components

#: Words of a shingle and least Jaccard similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Bands and rows of the keys that bring a pair together: at similarity 0.8 all but 7 in 100,000 pairs share one.
BANDS, ROWS = 24, 5
#: A bucket of so many groups is compared pair by pair, a larger one with LEADERS of its members at a time.
BUCKET, LEADERS = 8, 2
#: Members on each side of a block of pairs that is verified at once.
CELL = 256


def shingle_hashes(text: bytes, words: int = WORDS) -> tuple[bytes, np.ndarray]:
    """The words joined by blanks, and the hashes of the distinct shingles (of all words if there are fewer)."""
    joined, starts, ends = joined_words(text)
    if not len(starts):
        return joined, np.zeros(0, np.uint64)
    ends = ends[words - 1 :] if len(ends) > words else ends[-1:]
    pairs = zip(starts[: len(ends)].tolist(), ends.tolist())
    digest = xxhash.xxh64_intdigest
    return joined, np.unique(np.array([digest(joined[s:e], 42) for s, e in pairs], np.uint64))


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, mark, tid (a hash of the words), fp (SimHash) and keys (one for each band) of every row."""

    def run(batches):
        salts = splitmix(BANDS * ROWS, 99)
        bands = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            tids, fps, keys = [], [], []
            for text in byte_texts(batch.column(2)):
                joined, hashes = shingle_hashes(text)
                tids.append(xxhash.xxh3_128_digest(joined))
                if not len(hashes):
                    fps.append(0)
                    keys.append(np.zeros(0, np.int64))
                    continue
                low = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
                votes = np.zeros(64, np.int64)
                for at in range(0, len(hashes), 4096):
                    part = hashes[at : at + 4096]
                    with np.errstate(over="ignore"):
                        np.minimum(low, ((part[:, None] ^ salts) * np.uint64(0x9E3779B97F4A7C15)).min(axis=0), out=low)
                    votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                fps.append(int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0]))
                rows = low.reshape(BANDS, ROWS)
                key = bands
                with np.errstate(over="ignore"):
                    for i in range(ROWS):
                        key = mixed(key * np.uint64(31) + rows[:, i])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tids, pa.binary()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "mark", "tid", "fp", "keys"],
            )

    kept = docs.select("doc_id", text_hash().alias("mark"), "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, mark int, tid binary, fp bigint, keys array<bigint>")


def _shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """tid, hashes of the wanted (doc_id, mark) rows: one row for each tid."""

    def run(batches):
        for batch in batches:
            found = [shingle_hashes(t)[1].view(np.int64) for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["tid", "hashes"])

    marked = docs.select("doc_id", text_hash().alias("mark"), "text")
    picked = marked.join(wanted, same(marked, wanted, "doc_id", "mark")).select("tid", "text")
    return picked.mapInArrow(run, "tid binary, hashes array<bigint>")


def _simhash_pairs(texts: DataFrame) -> DataFrame:
    """a < b: texts that operator 3 links, which is by candidates, pivot table and Hamming distance of up to two bits.

    Of texts with one fingerprint each meets the least, and the least ones meet across fingerprints. Texts without words are left out.
    """
    worded = texts.filter(F.size("keys") > 0).select("tid", "fp")
    least = written(worded.groupBy("fp").agg(F.min("tid").alias("least"), F.count("*").alias("n")), "least")
    same_fp = worded.join(least.filter("n > 1"), "fp").filter("tid <> least").select(F.col("least").alias("a"), F.col("tid").alias("b"))
    found = written(simhash.links(least), "links")
    release(texts.sparkSession)
    one, two = (least.select(F.col("fp").alias(side), F.col("least").alias(name)) for side, name in (("a", "x"), ("b", "y")))
    across = found.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same_fp.unionByName(across)


def _verified(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The pairs a, b whose shingles have the similarity."""
    left, right = hashes.select(F.col("tid").alias("a"), F.col("hashes").alias("p")), hashes.select(F.col("tid").alias("b"), F.col("hashes").alias("q"))
    met = F.size(F.array_intersect("p", "q"))
    return pairs.join(left, "a").join(right, "b").filter(met >= SIMILARITY * (F.size("p") + F.size("q") - met)).select("a", "b")


def _rest(members: DataFrame, roots: DataFrame, hashes: DataFrame) -> DataFrame:
    """a, b: the links between texts of different groups that share a bucket of more than BUCKET texts, all verified.

    In each bucket all members outside its largest group are held against all members, by blocks of CELL times CELL.
    """
    now = members.join(roots, members.tid == roots.node, "left").select("key", "tid", F.coalesce("root", "tid").alias("root"))
    groups = now.groupBy("key", "root").count().groupBy("key")
    total = F.sum("count")
    open_ = groups.agg(total.alias("n"), (total - F.max("count")).alias("rest"), F.max_by("root", F.struct("count", "root")).alias("main")).filter((F.col("n") > BUCKET) & (F.col("rest") > 0))
    cells = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    at = now.select("key", "tid", "root").join(open_, "key").withColumns({"wide": cells("n"), "high": cells("rest"), "h": F.xxhash64("tid")})
    own = lambda c: F.pmod(F.col("h"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = at.filter("root <> main").select("key", own("high").alias("i"), every("wide").alias("j"), "tid", "root", F.lit(True).alias("left"))
    right = at.select("key", every("high").alias("i"), own("wide").alias("j"), "tid", "root", F.lit(False).alias("left"))

    def verified(cell: pa.Table) -> pa.Table:
        tid, side = cell["tid"].combine_chunks(), cell["left"].to_numpy()
        root = cell["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        column = cell["hashes"].combine_chunks()
        size = column.value_lengths().to_numpy().astype(np.int64)
        places, ids = np.unique(column.flatten().to_numpy(), return_inverse=True)
        start = np.cumsum(size) - size
        rights = np.flatnonzero(~side)
        flat = np.concatenate([ids[start[k] : start[k] + size[k]] for k in rights]) if len(rights) else np.zeros(0, np.int64)
        begin = np.cumsum(size[rights]) - size[rights]
        held, a, b = np.zeros(len(places), bool), [], []
        for k in np.flatnonzero(side) if len(rights) else ():
            own = ids[start[k] : start[k] + size[k]]
            held[own] = True
            met = np.add.reduceat(held[flat], begin, dtype=np.int64)
            held[own] = False
            near = rights[(met >= SIMILARITY * (size[k] + size[rights] - met)) & (root[rights] != root[k])]
            a += [k] * len(near)
            b += near.tolist()
        return pa.table({"a": tid.take(pa.array(a, pa.int64())), "b": tid.take(pa.array(b, pa.int64()))})

    found = left.unionByName(right).join(hashes, "tid").groupBy("key", "i", "j").applyInArrow(verified, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, mark, first_id, first_mark of every row: the first row, by doc_id then hash of text, of its group.

    Rows are grouped over links of texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more;
    texts of the same words are one. Pairs come from operator 3's links of the texts' SimHash fingerprints and from buckets of
    equal MinHash keys, and all are verified by their shingles. No pair is tried twice. A bucket of more than BUCKET texts compares its members with
    LEADERS of them picked by a hash, and as groups merge, the groups left in it again, until a round adds no link, so a
    group of n near copies costs some n pairs. Then all pairs of such a bucket that are still in different groups are
    verified, so no link of two texts that share a bucket is missed; many texts just under SIMILARITY cost all their pairs. Texts without words are one group; null doc_ids come last.
    """
    spark = docs.sparkSession
    rows = written(_sketches(docs), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark")
    texts = written(rows.groupBy("tid").agg(F.min(first).alias("at"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "texts")
    tried = written(_simhash_pairs(texts), "pairs")
    members = texts.select("tid", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").count().filter("count > 1").select("key")
    members = written(members.join(sizes, "key"), "members")
    ends = tried.select(F.explode(F.array("a", "b")).alias("tid"))
    wanted = texts.join(members.select("tid").unionByName(ends).distinct(), "tid").select("tid", F.col("at.doc_id").alias("doc_id"), F.col("at.mark").alias("mark"))
    hashes = written(_shingles(docs, wanted).dropDuplicates(["tid"]), "shingles")
    release(spark)
    links, roots = written(_verified(tried, hashes), "links"), None
    while True:
        now = members if roots is None else members.join(roots, members.tid == roots.node, "left").select("key", "tid", F.coalesce("root", "tid").alias("root"))
        # One member of each group left in a bucket, the one with the least hash for that bucket.
        if roots is not None:
            now = now.groupBy("key", "root").agg(F.min_by("tid", F.struct(F.xxhash64("tid", "key"), "tid")).alias("tid")).select("key", "tid")
        counts = now.groupBy("key").agg(F.count("*").alias("n"), *[F.min_by("tid", F.xxhash64("tid", "key", F.lit(i))).alias(f"l{i}") for i in range(LEADERS)]).filter("n > 1")
        small = counts.filter(F.col("n") <= BUCKET).select("key")
        one = now.join(small, "key")
        pairs = one.select("key", F.col("tid").alias("a")).join(one.select("key", F.col("tid").alias("b")), "key")
        large = counts.filter(F.col("n") > BUCKET).select("key", F.array(*[f"l{i}" for i in range(LEADERS)]).alias("l"))
        led = now.join(large, "key").select(F.col("tid").alias("a"), F.explode("l").alias("b"))
        both = pairs.filter("a < b").select("a", "b").unionByName(led.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        both = written(both.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(both)
        new = written(_verified(both, hashes), "links")
        release(spark)
        if roots is not None and new.isEmpty():
            break
        links = links.unionByName(new)
        roots = written(components(links), "roots")
        release(spark)
    new = written(_rest(members, roots, hashes), "links")
    if not new.isEmpty():
        roots = written(components(links.unionByName(new)), "roots")
    joined = texts.join(roots, texts.tid == roots.node, "left").select("tid", "at", "root")
    grouped = joined.withColumns({"root": F.coalesce("root", "tid")})
    firsts = grouped.groupBy("root").agg(F.min("at").alias("first"))
    named = grouped.join(firsts, "root").select(F.col("tid").alias("key"), "first")
    return rows.join(named, rows.tid == named.key).select("doc_id", "mark", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"))


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are the first of their group by near_groups, with their columns as they were.

    Rows that repeat both a doc_id and its text are one document and stay or go together.
    """
    groups = near_groups(docs)
    firsts = groups.filter(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))).select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m")).distinct()
    marked = docs.withColumns({"__mark": text_hash()})
    return marked.join(firsts, marked["doc_id"].eqNullSafe(firsts["__d"]) & (marked["__mark"] == firsts["__m"]), "left_semi").drop("__mark")
