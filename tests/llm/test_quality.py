import zlib

import numpy as np

from matchloom.llm import quality as ql
from tests.llm.data import documents


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in ql.quality(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    assert np.mean([p == q for p, q in held]) > 0.95


def test_awkward_rows(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x " * 40_000)], clash=True)
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 1), (1, None, 0), (9, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = ql.quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in ql.quality(docs, labels.filter("doc_id < 0")).collect()} == {0.5}
    assert ql.quality(documents(spark, []), labels).count() == 0


def test_features_and_updates():
    words = ql.Words()
    at, x = words.features(b"The cat the cat!!")
    assert len(set(at.tolist())) == len(at) and abs(float((x.astype(float) ** 2).sum()) - 4) < 1e-5
    assert words.features(b" \n")[0].size == 0
    assert ql.shape(b"Ered***") == b"Aa*" and ql.shape(b"THE") == b"A" and ql.shape("é1".encode()) == b"a9"
    model = ql.Ftrl(16)
    for _ in range(200):
        model.learn(np.array([1]), np.array([1.0]), 1)
        model.learn(np.array([2]), np.array([1.0]), 0)
    w = model.weights(slice(None))
    assert w[1] > 1 and w[2] < -1 and w[3] == 0
