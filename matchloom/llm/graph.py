"""Connected components of a distributed edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialise


def forest(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """Replaces the edges of each partition by a spanning forest, ``most`` edges at a time: a map-side combiner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        n = 0

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        def out():
            rows = [(x, root(x)) for x in parent]
            rows = [r for r in rows if r[0] != r[1]]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["u", "v"])

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                a, c = root(u), root(v)
                if a != c:
                    parent[max(a, c)] = min(a, c)
                    parent.setdefault(min(a, c), min(a, c))
            n += b.num_rows
            if n >= most:
                yield out()
                n = 0
        yield out()

    return edges.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, path: str, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of the component of each node that has an edge to a smaller one of it.

    Each round links the larger neighbours of every node to its smallest one, then the smaller ones; the rounds
    are logarithmic in practice and stop when the table does not change; more than ``rounds`` of them are an error.
    Tables are written between rounds.
    """
    now = materialise(forest(edges).filter("u <> v").distinct(), f"{path}/edges")
    state = None
    for k in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = materialise(small, f"{path}/round{k}")
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (r["n"], r["h"]) == state:
            break
        state = (r["n"], r["h"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
