import math

import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import topk
from tests.compare import same


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score int, g int")


def ok(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, k=5):
    rows = [(r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]]) for r in rows if r[0] is not None and ok(r[1])]
    out = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        best = {}
        for own, a in rows:
            if own == q:
                for i, b in rows:
                    if i != q:
                        best[i] = max(best.get(i, -(10**30)), sum(x * y for x, y in zip(a, b)))
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((q, rank, i, s))
    return out


def run(spark, rows, **k):
    f = frame(spark, rows)
    return sorted(tuple(r) for r in topk.top_k(f, f.filter(F.col("vec_id") % 50 == 0), **k).collect())


def vectors(n, d, seed, clusters=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(max(clusters, 1), d))
    x = rng.normal(size=(n, d)) * 0.2 + (centre[rng.integers(0, max(clusters, 1), n)] if clusters else 0)
    return [(i, [float(np.float32(v)) for v in row], 1, 2, 3) for i, row in enumerate(x)]


def test_matches_brute_force(spark):
    rows = vectors(700, 16, 1, clusters=5)
    assert run(spark, rows, block=200) == brute(rows)


def test_awkward_vectors(spark):
    rows = vectors(120, 4, 2)
    rows += [(200, None, 0, 0, 0), (250, [None, 1.0, 1.0, 1.0], 0, 0, 0), (300, [float("nan")] * 4, 0, 0, 0), (350, [float("inf"), 0.0, 0.0, 0.0], 0, 0, 0), (None, [1.0] * 4, 0, 0, 0)]
    rows += [(400, [], 0, 0, 0), (401, [0.5], 0, 0, 0), (402, [0.5, 0.25, 0.125, 1.0, 9.0], 0, 0, 0), (50, [0.1] * 4, 0, 0, 0), (7, [5.0] * 4, 0, 0, 0), (7, [5.0] * 4, 0, 0, 0)]
    rows += [(500 + i, [0.75, 0.75, 0.75, 0.75], 0, 0, 0) for i in range(9)] + [(600, [1e6, -1e6, 1e6, 1.0], 0, 0, 0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, block=20) == brute(rows)


def test_few_rows(spark):
    assert run(spark, [(0, [1.0], 0, 0, 0)]) == []
    assert run(spark, [(0, [1.0], 0, 0, 0), (1, [2.0], 0, 0, 0)]) == [(0, 1, 1, 131072)]
    assert run(spark, []) == []


def test_bounds_hold_at_every_stop():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(400, 12)) * 80).astype(np.int64)
    index = topk.Index(np.arange(400), x)
    for q in range(40):
        s = x @ x[q]
        want = sorted(((int(v), i) for i, v in enumerate(s) if i != q), key=lambda r: (-r[0], r[1]))[:5]
        assert index.search(q, x[q], 5, None) == want
        assert index.search(q, x[q], 5, want[-1][0]) == want


def test_sql(spark, duck, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    same(topk.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0)), duck, topk.ORACLE)
