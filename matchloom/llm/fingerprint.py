"""Document fingerprints: bottom-k sketches of word shingles.

A sketch keeps the ``k`` smallest 64-bit hashes of a text's distinct five-word shingles, so the sketch of a
union is the ``k`` smallest of two sketches (``merge``), and two sketches estimate resemblance, containment and
the number of distinct shingles.  With at most ``k`` shingles all estimates are exact.

Defined results: NULL and blank texts have the empty sketch ``"0:"``; two empty sketches resemble each other
fully (1.0), an empty and a non-empty one not at all (0.0); equal texts have equal sketches.  Repeated rows
each keep their row; NULL ids come last in descending order.  An empty table gives an empty result.  Other
columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import WordHashes, as_bytes, shingle_hashes

K = 256
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(words: WordHashes, text: bytes, k: int = K) -> np.ndarray:
    return shingle_hashes(words.of(text.lower().split()))[:k]


def encode(values: np.ndarray, k: int = K) -> str:
    return f"{len(values)}:" + base64.b64encode(values.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), "<u8")


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two parts."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's k smallest hashes that both sketches hold."""
    if not len(a) and not len(b):
        return 1.0
    u = merge(a, b, k)
    return float(np.isin(u, a, assume_unique=True)[np.isin(u, b, assume_unique=True)].sum() / len(u))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * float(TOP) / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first text's shingles that the second holds (an empty text is contained)."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, both / distinct(a, k))


def edited(text: str, following: str) -> str:
    """``text`` whose last third (rounded down) gives way to as many leading code points of ``following``."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _buckets(n: int) -> int:
    return min(65_536, max(64, n // 250))


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Deals rows to buckets of neighbouring ids, each bucket with the first row of the one that follows it.

    One shuffle of the texts and no global window: bucket borders are quantiles of the ids, and only one id a
    bucket (65,536 at most) reaches the driver.
    """
    lowest = -(1 << 63)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(lowest)).alias("__k"))
    n = rows.count()
    if not n:
        return rows.withColumns({"__b": F.lit(0), "__extra": F.lit(False)})
    parts = _buckets(n)
    cuts = rows.agg(F.percentile_approx("__k", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    cuts = np.unique(np.array(cuts, np.int64))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("__k").to_numpy(zero_copy_only=False)
            yield b.append_column("__b", pa.array(-np.searchsorted(cuts, k, "left").astype(np.int32)))

    dealt = rows.select("__k").mapInArrow(bucket, "__k bigint, __b int").groupBy("__b").agg(F.max("__k").alias("k"))
    firsts = sorted((r["__b"], r["k"]) for r in dealt.collect())
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}
    keys = np.array(sorted(before), np.int64)
    target = np.array([before[k] for k in keys.tolist()], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("__k").to_numpy(zero_copy_only=False)
            own = -np.searchsorted(cuts, k, "left").astype(np.int32)
            at = np.searchsorted(keys, k).clip(0, len(keys) - 1)
            first = np.flatnonzero(keys[at] == k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(np.zeros(len(k), bool))], out)
            if len(first):
                more = b.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([*more.columns, pa.array(target[at[first]]), pa.array(np.ones(len(first), bool))], out)

    out = ["doc_id", "text", "__k", "__b", "__extra"]
    spread = rows.mapInArrow(deal, rows.select("doc_id", "text", "__k", F.lit(0).alias("__b"), F.lit(True).alias("__extra")).schema)
    return spread.repartition("__b").sortWithinPartitions("__b", "__extra", F.desc("__k"), F.asc_nulls_first("text"))


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles_est double, containment_edited double"


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document: its sketch, that of its edited text, and how alike they and the next document are."""
    dealt = with_neighbours(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        rows: list[tuple] = []

        def emit(doc_id, text: bytes, mine, following: bytes, theirs):
            plain = text.decode("utf-8", "replace")
            changed = edited(plain, following.decode("utf-8", "replace")).encode("utf-8", "replace") if len(plain) >= 3 else text
            other = sketch(words, changed, k) if changed != text else mine
            rows.append((doc_id, len(plain), hashlib.sha256(changed).hexdigest(), encode(mine), encode(other), resemblance(mine, other, k), resemblance(mine, theirs, k), distinct(mine, k), containment(mine, other, k)))

        def flush():
            out = [list(x) for x in zip(*rows)] or [[] for _ in NAMES]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, TYPES)], NAMES)

        held = None  # the row that waits for the one after it
        for b in batches:
            words.trim()
            for bucket, extra, doc_id, text in zip(b.column("__b").to_pylist(), b.column("__extra").to_pylist(), b.column("doc_id").to_pylist(), as_bytes(b.column("text"))):
                if held and held[0] != bucket:
                    held = None
                if extra and held is None:
                    continue
                mine = sketch(words, text, k)
                if held:
                    emit(held[1], held[2], held[3], text, mine)
                held = None if extra else (bucket, doc_id, text, mine)
            yield flush()

    return dealt.mapInArrow(run, OUT)


NAMES = [x.split()[0] for x in OUT.split(", ")]
TYPES = [{"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in OUT.split(", ")]
