"""Benchmark decontamination by latent semantic retrieval (operator 9)."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemill.llm.common import documents

#: Words of a passage and between the starts of two; words of context on either side that the check reads.
PASSAGE, STRIDE, CONTEXT = 64, 32, 32
#: Latent dimensions, and spare ones that the randomised range finder draws; dimensions that terms are folded into beyond.
RANK, SPARE, TERMS = 256, 8, 1 << 14
#: Least weight of a term, so that one in every passage still has some.
LEAST = 0.01
#: Least cosine of a candidate, and least share of a benchmark passage's words in its longest common subsequence.
COSINE, LCS = 0.45, 0.6
#: Benchmark passages under SHORT words must be met whole. Of its ANSWER rarest words, which stand for its answer, one must be there.
SHORT, ANSWER = 10, 4
#: Characters of benchmark text that a scan of the documents is held against at once: about so much is on the driver, and some
#: thirty times that in a task. Passages folded, and cosines computed, at once.
BLOCK, FOLDED, COSINES = 1 << 22, 1 << 14, 1 << 22

#: Bytes that stand in words; all others become blanks.
_KEPT = bytes(b if chr(b).isalnum() or b >= 0x80 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z and characters beyond ASCII, in lower case."""
    return (text or "").lower().encode().translate(_KEPT).split()


def cut(words: list) -> list[list]:
    """A benchmark text as passages of up to PASSAGE words, none of them a short rest."""
    n = max(1, round(len(words) / (PASSAGE * 0.75))) if len(words) > PASSAGE else 1
    step = max(1, -(-len(words) // n))
    return [words[i : i + step] for i in range(0, len(words), step)]


def common_subsequence(masks: dict, size: int, words: list) -> int:
    """Length of the longest common subsequence, bit-parallel over the `size` words that `masks` has the places of."""
    full = (1 << size) - 1
    row = full
    for word in words:
        if (hit := masks.get(word)) is not None:
            use = row & hit
            row = ((row + use) | (row - use)) & full
    return size - row.bit_count()


@dataclass
class Terms:
    """Benchmark words and the dimension of each, inverse document frequencies by dimension, and the passages that hold each word."""

    place: dict[bytes, int]
    idf: np.ndarray
    held: dict[bytes, int]

    def rarest(self, words: list[bytes]) -> list[bytes]:
        return sorted(set(words), key=lambda x: (self.held.get(x, 0), x))[:ANSWER]

    def dims(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))


def starts(lengths: list[int]) -> np.ndarray:
    """The first passage of each text of so many words, and last how many passages there are."""
    return np.cumsum([0] + [max(1, -(-(n - (PASSAGE - STRIDE)) // STRIDE)) for n in lengths])


def passages(counts: list[np.ndarray]):
    """From each text's dims: first passage of each text, and (passage, dim) of every term in every passage that holds it."""
    first, where, dims = starts([len(own) for own in counts]), [], []
    for total, end, own in zip(first[:-1], first[1:], counts):
        n = end - total
        at = np.flatnonzero(own >= 0)
        block = at // STRIDE
        for shift in range(PASSAGE // STRIDE):
            p = block - shift
            ok = (p >= 0) & (p < n)
            where.append(p[ok] + total)
            dims.append(own[at[ok]])
    return first, np.concatenate(where or [np.zeros(0, np.int64)]), np.concatenate(dims or [np.zeros(0, np.int32)])


def weights(where: np.ndarray, dims: np.ndarray, idf: np.ndarray):
    """Sparse TF-IDF rows: passage, dim and weight of each distinct pair, passages in order."""
    key, times = np.unique(where * len(idf) + dims, return_counts=True)
    p, d = key // len(idf), key % len(idf)
    w = np.sqrt(times) * idf[d]
    keep = w > 0
    return p[keep], d[keep], w[keep]


def folded(p, d, w, n: int, basis: np.ndarray) -> np.ndarray:
    """Unit latent vectors of n passages under the basis; the norm is that of the projection, so that a copy's cosine is 1 at any rank."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    for low in range(0, len(p), 1 << 17):
        s = slice(low, low + (1 << 17))
        rows, at = np.unique(p[s], return_index=True)
        out[rows] += np.add.reduceat(basis[d[s]] * w[s, None].astype(np.float32), at)
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]


class Answers:
    """The rarest words of each benchmark passage and the passages that each of them stands for."""

    def __init__(self, rare: list[list[bytes]]):
        of: dict[bytes, list[int]] = {}
        for c, words in enumerate(rare):
            for word in words:
                of.setdefault(word, []).append(c)
        self.place = {word: i for i, word in enumerate(of)}
        self.size = np.array([len(cs) for cs in of.values()], np.int64)
        self.flat = np.array([c for cs in of.values() for c in cs], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.cuts = max(1, len(rare))

    def met(self, rows: list[list[bytes]], first: np.ndarray) -> np.ndarray:
        """passage * cuts + benchmark passage, sorted, of every pair whose answer is in the passage or its context."""
        out = []
        for i, words in enumerate(rows):
            own = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
            at = np.flatnonzero(own >= 0)
            if not len(at):
                continue
            n, block = int(first[i + 1] - first[i]), at // STRIDE
            for shift in range(-(CONTEXT // STRIDE), (PASSAGE + CONTEXT) // STRIDE):
                p = block - shift
                ok = (p >= 0) & (p < n)
                key = np.unique((p[ok] + first[i]) * len(self.place) + own[at[ok]])
                p, a = key // len(self.place), key % len(self.place)
                size = self.size[a]
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                out.append(np.repeat(p, size) * self.cuts + self.flat[np.repeat(self.start[a], size) + step])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _chunks(batch: pa.RecordBatch, column: int, size: int = 1 << 20):
    """(first row, texts' words) for stretches of a batch of about so many characters."""
    rows, start, held = [], 0, 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        rows.append(words_of(text))
        held += len(text)
        if held >= size:
            yield start, rows
            rows, start, held = [], i + 1, 0
    if rows:
        yield start, rows


def frequencies(docs: DataFrame, place: dict[bytes, int], size: int) -> np.ndarray:
    """The passages of all documents that hold each dimension, and last how many passages there are."""

    def run(batches):
        terms, out = Terms(place, np.ones(size), {}), np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, rows in _chunks(batch, 0):
                first, where, dims = passages([terms.dims(r) for r in rows])
                key = np.unique(where * size + dims)
                out[:size] += np.bincount(key % size, minlength=size)
                out[size] += first[-1]
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["dim", "n"])

    found = docs.select("text").mapInArrow(run, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[found["dim"].to_numpy()] = found["n"].to_numpy()
    return out


def latent_basis(benchmark: DataFrame, terms: Terms, rank: int) -> np.ndarray:
    """Right singular vectors of the benchmark passages' TF-IDF matrix by a randomised range finder with two power steps.

    Each step sums X'(X G) over the partitions: a row of `rank` numbers for each of at most TERMS dimensions.
    """
    size = len(terms.idf)
    basis = np.random.default_rng(42).standard_normal((size, rank))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def added(v: pd.Series) -> np.ndarray:
        return np.sum(np.stack(v.to_list()), axis=0)

    for _ in range(2):
        now = basis

        def run(batches, now=now):
            for batch in batches:
                own = [terms.dims(c) for t in batch.column(0) for c in cut(words_of(t.as_py()))]
                where = np.repeat(np.arange(len(own)), [len(o) for o in own])
                flat = np.concatenate(own) if own else np.zeros(0, np.int32)
                p, d, w = weights(where[flat >= 0], flat[flat >= 0].astype(np.int64), terms.idf)
                middle = np.zeros((len(own), now.shape[1]))
                np.add.at(middle, p, now[d] * w[:, None])
                dims, at = np.unique(d, return_inverse=True)
                part = np.zeros((len(dims), now.shape[1]))
                np.add.at(part, at, middle[p] * w[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(dims.astype(np.int32)), pa.array(list(part), pa.list_(pa.float64()))], ["dim", "v"])

        rows = benchmark.select("text").mapInArrow(run, "dim int, v array<double>").groupBy("dim").agg(added("v").alias("v")).collect()
        total = np.zeros_like(basis)
        for r in rows:
            total[r.dim] = r.v
        basis, _ = np.linalg.qr(total)
    return basis.astype(np.float32)


def matches(docs: DataFrame, items: list[tuple], kind: T.DataType, terms: Terms, basis: np.ndarray, through: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `through` and n_passages, items and score of every row, held against some items (id, of type `kind`, and passages)."""
    spark = docs.sparkSession
    cuts = [(item, c) for item, cs in items for c in cs]
    own = [terms.dims(c) for _, c in cuts]
    where = np.repeat(np.arange(len(cuts)), [len(o) for o in own])
    flat = np.concatenate(own) if own else np.zeros(0, np.int32)
    p, d, w = weights(where[flat >= 0], flat[flat >= 0].astype(np.int64), terms.idf)
    index = folded(p, d, w, len(cuts), basis)
    rare = [terms.rarest(c) for _, c in cuts]
    shared = spark.sparkContext.broadcast((cuts, Terms(terms.place, terms.idf, {}), basis, index, rare))  # BLOCK passages at most

    def run(batches):
        cuts, terms, basis, index, rare = shared.value
        answers, checks = Answers(rare), []
        for (item, words), own in zip(cuts, rare):
            masks: dict = {}
            for i, word in enumerate(words):
                masks[word] = masks.get(word, 0) | 1 << i
            checks.append((item, len(words), masks, own))
        for batch in batches:
            n_passages, hits, best = [], [], []
            for _, rows in _chunks(batch, batch.num_columns - 1):
                first = starts([len(r) for r in rows])
                pairs = [answers.met(rows, first)]
                # No hit is without an answer, so only passages with one within reach are folded.
                within = np.zeros(first[-1], bool)
                within[pairs[0] // answers.cuts] = True
                reached = np.add.reduceat(within, first[:-1]) > 0
                _, where, dims = passages([terms.dims(r) if ok else np.full(len(r), -1, np.int32) for ok, r in zip(reached, rows)])
                p, d, w = weights(where[within[where]], dims[within[where]].astype(np.int64), terms.idf)
                used = np.unique(p)
                at = np.searchsorted(used, p)
                found: list[dict] = [{} for _ in rows]
                for low in range(0, len(used), FOLDED):
                    high = min(len(used), low + FOLDED)
                    s = slice(*np.searchsorted(at, [low, high]))
                    vectors = folded(at[s] - low, d[s], w[s], high - low, basis)
                    step = max(1, COSINES // (high - low))
                    for from_ in range(0, len(index), step):
                        near, c = np.nonzero(vectors @ index[from_ : from_ + step].T >= COSINE)
                        pairs.append(used[low + near] * answers.cuts + c + from_)
                last = None
                for key in np.unique(np.concatenate(pairs)).tolist():
                    passage, c = divmod(key, answers.cuts)
                    if passage != last:
                        row = int(np.searchsorted(first, passage, "right")) - 1
                        start = (passage - int(first[row])) * STRIDE
                        words = rows[row][max(0, start - CONTEXT) : start + PASSAGE + CONTEXT]
                        held, last = set(words), passage
                    item, size, masks, own = checks[c]
                    if held.isdisjoint(own):
                        continue
                    share = common_subsequence(masks, size, words) / size
                    if share >= (LCS if size >= SHORT else 1.0):
                        found[row][item] = max(share, found[row].get(item, 0.0))
                n_passages += np.diff(first).tolist()
                hits += [sorted(f) for f in found]
                best += [max(f.values(), default=0.0) for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n_passages, pa.int64()), pa.array(hits, pa.list_(to_arrow_type(kind))), pa.array(best, pa.float64())],
                [*through, "n_passages", "items", "score"],
            )

    kept = docs.select(*through, F.col("text").alias("__text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{shape}, n_passages bigint, items array<{kind.simpleString()}>, score double")


def blocks(docs: DataFrame, benchmark: DataFrame):
    """For each block of the benchmark: items with their passages, terms and latent basis; one block is on the driver at a time."""
    known = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK))
    for i in range(n):
        block = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).distinct()
        rows = sorted((r.item_id, cut(words)) for r in block.toLocalIterator() if (words := words_of(r.text)))
        if rows or i == n - 1:
            yield rows, *prepared(docs, block, rows)


def prepared(docs: DataFrame, block: DataFrame, rows: list) -> tuple[Terms, np.ndarray]:
    """Terms and latent basis of the items in a block. Words beyond TERMS share dimensions; their counts stay their own."""
    vocabulary = sorted({w for _, cs in rows for c in cs for w in c})
    counts = frequencies(docs, {w: i for i, w in enumerate(vocabulary)}, max(1, len(vocabulary)))
    size = max(1, min(len(vocabulary), TERMS))
    place = {w: (i if len(vocabulary) <= TERMS else zlib.crc32(w) % TERMS) for i, w in enumerate(vocabulary)}
    held = np.zeros(size, np.int64)
    np.add.at(held, np.fromiter(place.values(), np.int64, len(place)), counts[: len(place)])
    terms = Terms(place, np.maximum(np.log((1 + max(1, counts[-1])) / (1 + held)), LEAST), dict(zip(vocabulary, counts.tolist())))
    rank = min(RANK + SPARE, sum(len(cs) for _, cs in rows) + SPARE, size)
    return terms, latent_basis(block, terms, rank) if rows else np.zeros((size, 1), np.float32)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_passages, items (ids of the benchmark items that a row holds, sorted) and score (largest share met, else 0).

    The latent space is that of the benchmark's passages, under frequencies over all passages of the documents, in which
    every term has a weight; every passage of every document that has an answer (one of some benchmark passage's rarest
    words) in it or its context is folded into it and held against every benchmark passage by cosine. Beside these, every
    such passage is a candidate for the benchmark passages of its answers, so none is lost whatever the rank or weights. A
    candidate counts if the longest common subsequence with the passage and its context has LCS of the benchmark passage's
    words, in order, and the answer is there. A benchmark of more than BLOCK characters is worked on in blocks, each with a
    space of its own, two scans of the documents a block; hits depend on words and their counts alone, so blocks change no row.
    Null and empty texts have one empty passage and no items. Repeated rows come out once each. Items with a null id or text
    or without words are left out; repeated items count once; ids may be of any ordered type.
    """
    kind = benchmark.schema["item_id"].dataType
    found = docs.select("doc_id", "text", F.array().cast(T.ArrayType(kind)).alias("__items"), F.lit(0.0).alias("__score"))
    for rows, terms, basis in blocks(docs, benchmark):
        held = matches(found, rows, kind, terms, basis, ("doc_id", "text", "__items", "__score"))
        merged = F.array_sort(F.array_union("__items", "items")).alias("__items"), F.greatest("__score", "score").alias("__score")
        found = held.select("doc_id", "text", "n_passages", *merged)
    return found.select("doc_id", "n_passages", F.col("__items").alias("items"), F.col("__score").alias("score"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item by find_leaks, with their columns as they were."""
    names, whole = tuple(docs.columns), docs
    for rows, terms, basis in blocks(whole, benchmark):
        docs = matches(docs, rows, benchmark.schema["item_id"].dataType, terms, basis, names).filter(F.size("items") == 0).select(*names)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_leaks() of the benchmark over all documents, and whether a row holds any item."""
    found = find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumns({"contaminated": F.size("items") > 0})
