"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components become ``floor(256 * x)``.  Rows are dealt to blocks of bounded size; each block is indexed by posting
segments, one for each dimension and quantised impact.  A query's segments are processed by descending impact
(the most that the segment adds to a score over the least of its dimension) into accumulators.  Processing stops
when accumulator plus the most that unprocessed segments can add stays below a score that k rows are known to
reach for all but a small part of the block; rows that could still be among the k best are then scored exactly.
The bounds only exclude rows that are proven not to belong, so the result is exact at every stopping point.

All queries meet all rows, block by block; each block keeps its k best for each query and a ranking per query
merges them, so no task holds more than a block of rows and a batch of queries.

Defined results: vectors that are NULL or hold NULL, NaN or infinite components, and rows with a NULL id, take no
part; shorter vectors count as padded with zeros; components are limited to +-2^31 after scaling and scores to the
range of a long; rows of one id are one candidate (and one query) with the best of their scores; a query is
never its own candidate; ties go to the smaller id; a query without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, BLOCK, LEVELS, QUERIES = 5, 8192, 14, 256
LIMIT = float(1 << 31)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(vectors: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.clip(np.floor(256.0 * v.astype(np.float64)), -LIMIT, LIMIT)
    return out


class Index:
    """Posting segments of a block: ``order[d, starts[d, l]:starts[d, l + 1]]`` are the rows at level l of d."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, levels: int = LEVELS):
        self.ids, self.rows = ids, rows
        self.n, self.dims = rows.shape
        self.low = int(rows.min()) if rows.size else 0
        self.width = max(1, -(-(int(rows.max()) - self.low + 1) // levels)) if rows.size else 1
        at = (rows - self.low) // self.width
        self.levels = int(at.max()) + 1 if rows.size else 0
        self.order = np.ascontiguousarray(np.argsort(at, axis=0, kind="stable").T)
        self.starts = np.zeros((self.dims, self.levels + 1), np.int64)
        for d in range(self.dims):
            self.starts[d, 1:] = np.cumsum(np.bincount(at[:, d], minlength=self.levels))
        self.most = int(np.abs(rows).max()) if rows.size else 0
        self.floats = rows.astype(np.float64)

    def exact(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        bound = self.dims * self.most * int(np.abs(q).max() if q.size else 0)
        if bound < 1 << 53:
            return (self.floats[at] @ q.astype(np.float64)).astype(np.int64)
        scores = self.rows[at].astype(object) @ q.astype(object)
        return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in scores], np.int64)

    def search(self, own: int, q: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) of the block, without those proven to miss ``floor`` (k rows reach it)."""
        d = min(len(q), self.dims)
        query = np.zeros(self.dims, np.int64)
        query[:d] = q[:d]
        live = np.flatnonzero(query)
        if not len(live) or self.dims * self.most * int(np.abs(query).max()) >= 1 << 53:
            return best(self.exact(query, np.arange(self.n)), self.ids, own, k)
        edge = self.low + self.width * np.arange(self.levels)
        c = query[live, None]
        tops = np.where(c > 0, c * (edge + self.width - 1), c * edge)
        held = self.starts[live, 1:] > self.starts[live, :-1]
        least = np.where(held, tops, np.iinfo(np.int64).max).min(axis=1)
        gains = np.where(held, tops - least[:, None], -1)
        base = int(least.sum())
        flat = np.argsort(-gains, axis=None, kind="stable")
        flat = flat[gains.ravel()[flat] > 0]
        dim, level = np.divmod(flat, self.levels)
        begin, end, gain = self.starts[live[dim], level], self.starts[live[dim], level + 1], gains.ravel()[flat]
        # What a dimension can still add once a segment is processed: the gain of its next one.
        following = np.zeros(len(flat), np.int64)
        last: dict[int, int] = {}
        for i in range(len(flat) - 1, -1, -1):
            following[i] = last.get(dim[i], 0)
            last[dim[i]] = gain[i]
        rest = int(gains.max(axis=1).clip(0).sum()) - np.cumsum(gain - following)
        marks = np.searchsorted(np.cumsum(end - begin), np.array([0.75, 0.85, 0.92]) * self.n * len(live))
        marks = {*np.minimum(marks, len(flat) - 1).tolist(), len(flat) - 1}
        got = np.zeros(self.n, np.int64)
        order, rows = self.order, live[dim].tolist()
        may = np.arange(self.n)
        for i, (r, a, b, g) in enumerate(zip(rows, begin.tolist(), end.tolist(), gain.tolist())):
            got[order[r, a:b]] += g
            if i in marks:
                bar = floor
                if bar is None or i == len(flat) - 1:
                    front = np.argpartition(-got, min(4 * k, self.n - 1))[: 4 * k + 1]
                    seen = best(self.exact(query, front), self.ids[front], own, k)
                    if len(seen) == k and (bar is None or seen[-1][0] > bar):
                        bar = seen[-1][0]
                if bar is not None:
                    may = np.flatnonzero(got >= bar - base - int(rest[i]))
                    if len(may) <= self.n // 16:
                        break
        return best(self.exact(query, may), self.ids[may], own, k)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) with distinct ids, ties to the smaller id, without the query's own."""
    out: list[tuple[int, int]] = []
    seen = {own}
    if len(scores) > 8 * k:  # rows below the 8k-th score matter only if ids repeat; look at all then
        bar = np.partition(scores, len(scores) - 8 * k)[len(scores) - 8 * k]
        top = np.flatnonzero(scores >= bar)
        if len(set(ids[top].tolist()) - seen) >= k:
            scores, ids = scores[top], ids[top]
    for i in np.lexsort((ids, -scores)):
        if (x := int(ids[i])) not in seen:
            seen.add(x)
            out.append((int(scores[i]), x))
            if len(out) == k:
                break
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows for each query; both take (vec_id, embedding)."""
    ok = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = rows.select("vec_id", "embedding").filter(ok)
    queries = queries.select("vec_id", "embedding").filter(ok)
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("asks", F.lit(False))
    asked = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).withColumn("asks", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        waiting: list[tuple[int, np.ndarray]] = []
        index, group = None, None
        found: dict[int, list[tuple[int, int]]] = {}  # of this block

        def answer():
            nonlocal index
            if index is None:
                index = Index(np.array(ids, np.int64), matrix(vectors))
            if index.n:
                for own, q in waiting:
                    got = index.search(own, matrix([q])[0], k, None)
                    if own in found:
                        both = found[own] + got
                        got = best(np.array([x[0] for x in both], np.int64), np.array([x[1] for x in both], np.int64), own, k)
                    found[own] = got
            waiting.clear()

        def close():
            answer()
            out = [(q, x, s) for q, hits in found.items() for s, x in hits]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

        for b in batches:
            column = b.column("embedding")
            flat = column.values.to_numpy(zero_copy_only=False)
            ends = column.offsets.to_numpy()
            for i, (g, asks, vec_id) in enumerate(zip(b.column("g").to_pylist(), b.column("asks").to_pylist(), b.column("vec_id").to_pylist())):
                if g != group:
                    if group is not None:
                        yield close()
                    ids, vectors, index, group = [], [], None, g
                v = flat[ends[i] : ends[i + 1]].copy()
                if asks:
                    waiting.append((vec_id, v))
                    if len(waiting) == QUERIES:
                        answer()
                else:
                    ids.append(vec_id)
                    vectors.append(v)
        if group is not None:
            yield close()

    # A task a block: a hash of the block's number would put two of them in one task and none in another.
    hits = dealt.unionByName(asked).repartitionById(blocks, F.col("g").cast("int")).sortWithinPartitions("g", "asks").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
hits AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.e, r.e) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM hits)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
