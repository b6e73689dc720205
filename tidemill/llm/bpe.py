"""Byte-level BPE encoding and decoding (operator 2)."""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct words a worker remembers before it starts anew.
REMEMBERED = 1 << 18
#: Words longer than this are merged over a linked list with a heap instead of by rescanning.
RESCANNED = 64


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Token ids of one word: fold the merges over its bytes, lowest rank first, leftmost first among equals."""
    if (whole := rank.get(word)) is not None:
        return [whole]
    if len(word) > RESCANNED:
        return _merge_long(word, rank)
    parts = [word[i : i + 1] for i in range(len(word))]
    found = [rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
    while found:
        low = min(found)
        if low == 1 << 30:
            break
        i = found.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i:
            found[i - 1] = rank.get(parts[i - 1] + parts[i], 1 << 30)
        if i < len(found):
            found[i] = rank.get(parts[i] + parts[i + 1], 1 << 30)
    return [rank[p] for p in parts]


def _merge_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    from heapq import heapify, heappop, heappush

    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and (j := end[i]) < n and (r := rank.get(word[i : end[j]])) is not None:
            heappush(heap, (r, i, end[j]))

    while heap:
        _, i, stop = heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    return [rank[word[i : end[i]]] for i in range(n) if alive[i]]


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The rows of `docs` with ids, an array of token ids of `text`, and n_tokens and ids_sha256.

    Each match of `pattern` is merged by itself; a worker folds each distinct word once while it remembers it. Null and
    empty texts have no ids. Special tokens are ordinary text. Every row comes out once, repeated rows too. All columns pass
    through, but those named ids, n_tokens or ids_sha256, whose place the new ones take.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    names = [c for c in docs.columns if c not in ("ids", "n_tokens", "ids_sha256")]
    docs = docs.select(*names)
    at = names.index("text")

    def run(batches):
        rank, split, known = ranks(path), regex.compile(pattern), {}
        for batch in batches:
            ids, ends, digests = [], [0], []
            for value in batch.column(at):
                words = split.findall(value.as_py() or "")
                own: list[int] = []
                for word in words:
                    got = known.get(word)
                    if got is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        got = known[word] = merge(word.encode(), rank)
                    own += got
                own = np.array(own, "<u4")
                ids.append(own)
                ends.append(ends[-1] + len(own))
                digests.append(hashlib.sha256(own.tobytes()).hexdigest())
            flat = pa.array(np.concatenate(ids or [np.zeros(0, "<u4")]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(np.diff(ends), pa.int64()), pa.array(digests, pa.string())],
                [*batch.schema.names, "ids", "n_tokens", "ids_sha256"],
            )

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{shape}, ids array<int>, n_tokens bigint, ids_sha256 string")


def decoded(ids: str | Column, path: str | None = None) -> Column:
    """The bytes of an array of ids: its pieces, looked up by place in a literal array and concatenated. Null ids: null."""
    rank = ranks(path or public_tokenizers.path(VOCABULARY))
    pieces = [""] * (max(rank.values()) + 1)
    for piece, i in rank.items():
        pieces[i] = piece.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode() and decoded() over all documents: number and digest of the ids, digest of the bytes they decode to."""
    found = encode(documents(spark, sf_dir)).select("doc_id", "n_tokens", "ids_sha256", "ids")
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2(decoded("ids"), 256).alias("decoded_sha256"))
