"""Shared helpers of the training-text operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are maximal runs of bytes other than ASCII white space; Java form of the pattern.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where it is unset, a session of one process gets a temporary folder that goes with it; any other raises, since its
    executors would each write to a folder of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what written() wrote once nothing reads it any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the context's cleaner remove the shuffle files of plans that are gone; it acts when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *more)


def text_hash(text="text"):
    """A hash of a row's text that tells rows of one doc_id apart; never null."""
    return F.hash(F.coalesce(F.col(text), F.lit("")))


def same(left, right, *names: str):
    """Null-safe equality of the named columns: an equi-join condition."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out


def byte_texts(column: pa.Array) -> list:
    """Each text as UTF-8 bytes, one at a time; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def splitmix(n: int, seed: int) -> np.ndarray:
    """n 64-bit values of the SplitMix64 generator."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(z)


def mixed(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Rolling:
    """Hashes of byte ranges from prefix sums: a polynomial modulo 2^64 over a random table of byte values."""

    def __init__(self, seed: int):
        self.table = splitmix(256, seed) | np.uint64(1)
        self.base = int(splitmix(1, seed + 1)[0]) | 1
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) >= n:
            return
        size = 1 << max(17, int(n).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.inverse[start])


def joined_words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text joined by one space, and where each starts and ends in that."""
    words = text.split()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate((np.zeros(min(1, len(words)), np.int64), ends[:-1] + 1))
    return b" ".join(words), starts, ends


def winnowed(values: np.ndarray, window: int) -> np.ndarray:
    """For each window of that many values, the index of its rightmost least value (of all, if they are fewer)."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(values[::-1]))], np.int64)
    best, at, span = values, np.arange(n), 1
    while span * 2 <= window:
        take = best[span:] <= best[:-span]
        at = np.where(take, at[span:], at[:-span])
        best = np.where(take, best[span:], best[:-span])
        span *= 2
    if (rest := window - span) > 0:
        take = best[rest:] <= best[:-rest]
        at = np.where(take, at[rest:], at[:-rest])
    return at


class Bitmap:
    """Membership of 64-bit hashes in a bit table of bounded size; it may say yes wrongly, never no wrongly."""

    LEAST, MOST = 16, 28  # log2 of the number of bits

    def __init__(self, words: np.ndarray, log2: int):
        self.words, self.shift = words, np.uint64(64 - log2)

    @classmethod
    def of(cls, hashes: DataFrame, column: str, count: int) -> "Bitmap":
        """Of a DataFrame's distinct hashes; the table comes to the driver, at most 2^MOST bits (32 MB) whatever the input."""
        log2 = min(cls.MOST, max(cls.LEAST, (16 * max(1, count) - 1).bit_length()))
        slot = F.shiftrightunsigned(F.col(column), 64 - log2)
        parts = hashes.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({column}, {64 - log2}) & 63 AS INT))")).alias("b")).toArrow()
        words = np.zeros(1 << (log2 - 6), np.uint64)
        words[parts["w"].to_numpy()] = parts["b"].to_numpy().view(np.uint64)
        return cls(words, log2)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> self.shift
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
