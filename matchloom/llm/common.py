"""Helpers that several operators share: table access, scratch tables, word interning, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the query contracts: space and U+0009 to U+000D, which is what ``bytes.split()`` splits at.
SPACE = r"\x20\x09-\x0D"

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset (tests, one machine) a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        else:
            root = tempfile.mkdtemp(prefix="matchloom-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/matchloom/{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads it back with its own schema."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc32_mod(column: str, mod: int):
    """crc32 of the decimal text of an id, modulo ``mod`` (NULL ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def give_back() -> None:
    """Hands unused memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries
        pass


def tidy(run):
    """``run`` over Arrow batches that hands unused memory back to the system when the task ends.

    Worker processes outlive their tasks; without this, what one stage needed stays taken during the next.
    """

    def whole(batches):
        yield from run(batches)
        gc.collect()
        give_back()

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Interns words: ``self[word]`` is a row of ``hashes``.  ``trim`` bounds the memory between batches."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most, self.hashes, self.n = most, np.zeros(1 << 12, np.uint64), 0

    def __missing__(self, word: bytes) -> int:
        if self.n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[self.n] = xxhash.xxh64_intdigest(word)
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def of(self, words: list[bytes]) -> np.ndarray:
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[rows]

    def trim(self) -> None:
        if self.n > self.most:
            self.clear()
            self.n = 0


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < width:
        h = np.full(1, n, np.uint64) * GOLD
        for k in range(n):
            h = mix64((h ^ words[k : k + 1]) + GOLD)
        return h
    h = words[: n - width + 1].copy()
    for k in range(1, width):
        h = mix64(h + GOLD) ^ words[k : n - width + 1 + k]
    return np.unique(mix64(h))

