"""Token-id files: Parquet with one list of ids a document, in ascending ``doc_id`` order over files and rows.

Each file is a range of ids.  All numbers are delta-encoded and bit-packed (token ids take 17 bits or so, the
ascending ``doc_id``, ``row`` and ``before`` far less), row groups and pages are kept small, and page indexes let a
reader fetch the tokens of a few documents, or the numbers alone, without the rest.  Columns: ``part`` and ``row``
(file and place in it), ``doc_id``, ``before`` (ids of earlier rows of the file), ``n_tokens`` and ``ids``.

The tokenizers library encodes the texts: Arrow's kernels find the words of a text as the tokenizer file says, the
library, as it stands, encodes every distinct word, and the words' ids are gathered (bounded cache).  The number of
files follows the bytes of text.

Defined results: NULL and empty texts hold the end id alone; rows with a NULL id come first; rows of one id are
ordered by text; an empty table gives files without rows and an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.bpe import Splitter, Words, default_path
from matchloom.llm.common import scratch_dir, tidy

END = 2
SCHEMA = "part int, row bigint, doc_id bigint, before bigint, n_tokens bigint, ids array<int>"
LAYOUT = {
    "compression": "snappy",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",  # integers are delta-encoded then
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
#: Bytes of text: in a file at most, in a file at least (unless the session has few partitions), encoded at a time.
MOST, LEAST, STEP = 1 << 30, 8 << 20, 1 << 21
#: Files up to which the bounds of their ids are part of the plan.
BOUNDS = 512
_HELD: dict[str, Words] = {}


def encoder(path: str) -> Words:
    """The library's tokenizer of a file, without truncation and padding; one for each process."""
    if path not in _HELD:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()

        splitter = Splitter(json.load(open(path, encoding="utf-8")))
        end = library.model.end_of_word_suffix
        ends_word = np.zeros(max(library.get_vocab().values()) + 1, bool)
        ends_word[[i for w, i in library.get_vocab().items() if w.endswith(end) or w in splitter.special]] = True

        def ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """One call for a thousand words; the last id of each word shows where it ends."""
            sizes, found = [], []
            for k in range(0, len(words), 1000):
                part = words[k : k + 1000]
                got = np.array(library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
                stops = np.flatnonzero(ends_word[got]) + 1
                if len(stops) != len(part):  # split otherwise than the library does: ask it one by one
                    single = [x.ids for x in library.encode_batch_fast(part, add_special_tokens=False)]
                    got, stops = np.fromiter(chain.from_iterable(single), np.int32), np.cumsum(list(map(len, single)))
                sizes.append(np.diff(stops, prepend=0))
                found.append(got)
            return np.concatenate(sizes), np.concatenate(found)

        _HELD[path] = Words(splitter, ids)
    return _HELD[path]


def encode_texts(texts: pa.StringArray, path: str, most: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: (first, behind, ids with end ids, end of each in them), some ``most`` bytes at a time."""
    first, held, ahead = 0, [], 0
    for ids, ends, goes_on in encoder(path).parts(texts, most):
        held.append(ids)
        if goes_on:
            ahead += len(ids)
            continue
        ends = ends + ahead
        behind = first + len(ends)
        stops = ends + np.arange(1, len(ends) + 1)
        whole, own = np.full(ahead + len(ids) + len(ends), END, np.int32), np.ones(ahead + len(ids) + len(ends), bool)
        own[stops - 1] = False
        whole[own] = np.concatenate(held) if len(held) > 1 else ids
        yield first, behind, whole, stops
        first, held, ahead = behind, [], 0


def files(docs: DataFrame) -> int:
    """Number of files: of ``MOST`` bytes of text at most; small tables spread over the session's partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // MOST), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST)))


def ranged(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` in ``n`` ranges of ids with about as many rows each; rows of one id stay together, NULL comes first.

    Bounds are quantiles of the ids alone, so texts are not read for them; beyond ``BOUNDS`` Spark samples rows.
    """
    if n > BOUNDS:
        return rows.repartitionByRange(n, F.asc_nulls_first("doc_id"))
    shares = [k / n for k in range(1, n)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 100 * n).alias("b")).first()["b"] if shares else []
    bounds = sorted(set(bounds or []))

    def place(low: int, high: int):
        """The number of bounds below an id, by halves."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("doc_id") > bounds[mid], place(mid + 1, high)).otherwise(place(low, mid))

    return rows.repartitionById(n, place(0, len(bounds)))


def write_tokens(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Encodes all texts and writes the files."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, before = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            names = b.column("doc_id")
            for first, behind, ids, ends in encode_texts(b.column("text"), path):
                sizes = np.diff(ends, prepend=0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                n = behind - first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), names.slice(first, behind - first), pa.array(before + ends - sizes), pa.array(sizes), lists],
                    ["part", "row", "doc_id", "before", "n_tokens", "ids"],
                )
                row, before = row + n, before + int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ranges = ranged(rows, files(docs)).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    ranges.mapInArrow(tidy(run), SCHEMA).write.options(**LAYOUT).mode("overwrite").parquet(out)


def read_tokens(spark: SparkSession, out: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) of all documents, or of some: page indexes skip the pages of others."""
    rows = spark.read.schema(SCHEMA).parquet(out)
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    return rows.select("doc_id", "ids")


def offsets(spark: SparkSession, out: str) -> DataFrame:
    """(part, ahead): the ids of all files before each; one row a file, read from the number columns alone."""
    sums = spark.read.schema(SCHEMA).parquet(out).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))


def index(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the ids in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), b.column("before"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["part", "doc_id", "before", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).parquet(out).select("part", "doc_id", "before", "ids").mapInArrow(run, "part int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")
    # One row a file.
    return rows.join(F.broadcast(offsets(spark, out)), "part").select("doc_id", (F.col("ahead") + F.col("before")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")


def token_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the files of ``docs`` to the scratch folder and returns their index."""
    out = f"{scratch_dir(docs.sparkSession)}/tokens"
    write_tokens(docs, out, path)
    return index(docs.sparkSession, out)
