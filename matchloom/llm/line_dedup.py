"""Line dedup: lines whose key is found in several documents stay only in the smallest ``doc_id`` that holds it.

Every text is split at ``\\n``.  The key of a line is the line without leading and trailing ASCII white space and
with A-Z in lower case.  Only (key digest, doc_id) pairs are shuffled to count the distinct documents of each
key; digests that qualify are joined back to the positions of their lines, and one join by document reassembles
the lines that stay, by position.  Keys of a third of all rows are summed map-side first; the join back leaves
its hot side to skew handling, since it has one row a key on the other side.

Defined results: NULL and empty texts are one empty line (kept text: empty); a key shorter than ``min_chars``
never drops a line; repeated lines inside one document all go or all stay; rows with the same doc_id count as
one document and share its decisions; rows with a NULL doc_id hold no key and lose no line.  Empty tables give
empty results.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import as_bytes, materialise, scratch_dir, tidy

MIN_CHARS, MIN_DOCS = 10, 2
BLANKS = b" \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, pos, digest): a 128-bit digest of each key of at least ``min_chars`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            ids, at, keys = [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text"))):
                for pos, line in enumerate(text.split(b"\n")):
                    key = line.strip(BLANKS).lower()
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
                        ids.append(doc_id)
                        at.append(pos)
                        keys.append(xxhash.xxh3_128_digest(key))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "pos", "digest"])

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), "doc_id bigint, pos int, digest binary")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, dropped): for each document that loses lines, their positions, ascending."""
    # Read twice below; the texts are split and hashed once.
    path = scratch_dir(docs.sparkSession)
    lines = materialise(line_digests(docs, min_chars), f"{path}/lines")
    if min_docs <= 2:  # two documents at least: the smallest id differs from the largest
        held = lines.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter(F.col("owner") < F.col("last"))
    else:
        held = lines.select("digest", "doc_id").distinct().groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    # Written, so that both sides of the join come through an exchange of their own and skew handling can split
    # the lines of a hot key.
    held = materialise(held.select("digest", "owner"), f"{path}/held")
    return (
        lines.join(held, "digest")
        .filter(F.col("doc_id") > F.col("owner"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, kept, n_lines, n_dropped) for each row of ``docs``, which is ``row``; ``kept`` is the text that stays."""
    lost = dropped_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias("id"), "dropped")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"), _lines(F.col("text")).alias("lines"))
    # Runs of kept lines lie between dropped positions, so a document's work is linear in its lines.
    ends = F.concat(F.col("dropped"), F.array(F.size("lines")))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.col("dropped"), lambda x: x + 1))
    runs = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(F.col("lines"), a + 1, F.greatest(b - a, F.lit(0)))))
    return rows.join(lost, F.col("key") == F.col("id"), "left").select(
        "row",
        F.when(F.col("dropped").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(F.array_join(runs, "\n")).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the same columns, whose ``text`` (and ``n_chars``, if there is one) is what stays."""
    found = dedup_lines(docs, min_chars, min_docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return found.select(*(new.get(f.name, F.col("row").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
held AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, h.owner IS NOT NULL AND k.doc_id <> h.owner AS lost
  FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the query: counts and the digest of each kept text."""
    return dedup_lines(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
