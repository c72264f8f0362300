import itertools
import random
import zlib

import numpy as np

from matchloom.llm import toxicity as tox
from tests.llm.data import documents


def brute(scores):
    """Maximal segments: repeatedly the best-scoring run (shortest, then first), then left and right of it."""
    best = None
    for a, b in itertools.combinations(range(len(scores) + 1), 2):
        s = sum(scores[a:b])
        if s > 0 and (best is None or (s, -(b - a), -a) > (best[2], -(best[1] - best[0]), -best[0])):
            best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return brute(scores[:a]) + [(a, b, s)] + [(x + b, y + b, z) for x, y, z in brute(scores[b:])]


def test_segments_match_definition():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 1, 2, 4]) for _ in range(rng.randrange(0, 12))]
        got = tox.segments(np.array(scores, float)) if scores else []
        want = brute(scores)
        assert sorted(x[2] for x in got) == sorted(float(x[2]) for x in want), scores
        assert all(sum(scores[a:b]) == s for a, b, s in got)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in tox.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([p == q for p, q in held]) > 0.94
    assert sum(p for p, q in held if not q) <= 1


def test_awkward_rows(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x " * 40_000)], clash=True)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in tox.toxicity(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(3, 1, 1), (2, 1, None)], "doc_id bigint, quality int, toxic int")
    assert tox.toxicity(docs, one).count() == 5
    assert tox.without_toxic(docs, none).schema == docs.schema
    assert tox.toxicity(documents(spark, []), one).count() == 0


def test_bad_words_are_found_and_their_passage(spark):
    rng = random.Random(5)
    plain = [f"word{i}x" for i in range(300)]
    rows, marks = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(80)]
        if i % 4 == 0:
            words[30:34] = ["grublach", "snorfen" + "abcd"[i % 3], "grublach", "snorfend"]
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i % 4 == 0)))
    got = {r["doc_id"]: r for r in tox.toxicity(documents(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")).collect()}
    assert all(r["predicted"] == (i % 4 == 0) for i, r in got.items())
    p = got[4]["passages"][0]
    assert (p["begin"], p["end"]) == (60, 64)  # each plain word is two runs of letters
