"""The search by cells against sums over all hits."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import blocking, search, select
from matchloom.schema import BITS, SOURCE_BASE


def keyed(spark, one, seed=3):
    """Rows of keys; ``one``: an id has one country."""
    rng = random.Random(seed)
    make = lambda ids: [(i, ("x", "y", None)[i % 3] if one else rng.choice(["x", "y", None]), rng.choice(["name_token", "addr_token"]), rng.choice([None, *"abcdefgh"])) for i in ids for _ in range(6)]
    a, t = make(range(1, 60)), make([s * SOURCE_BASE + i for s in (2, 3) for i in range(1, 80)])
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} bigint, country string, channel string, key string")
    return a, t, frame(a, "anchor"), frame(t, "code")


def by_hand(a, t, cap, k):
    sizes, lists, sums = Counter(x[1:] for x in t), defaultdict(list), defaultdict(lambda: [0.0, 0])
    for code, *key in t:
        lists[tuple(key)].append(code)
    for anchor, *key in a:
        if None not in key and sizes[tuple(key)] <= cap:
            for code in lists[tuple(key)]:
                found = sums[anchor, code]
                found[0] += float(np.float32(math.log(1e7) - math.log(sizes[tuple(key)])))
                found[1] |= BITS[key[1]]
    groups = defaultdict(list)
    for (anchor, code), (w, bits) in sums.items():
        groups[anchor, code // SOURCE_BASE].append((-float(np.float32(round(w, 4))), code, bits))
    return sorted((anchor, code, w, bits, n) for (anchor, _), rows in groups.items() for n, (w, code, bits) in enumerate(sorted(rows)[:k]))


@pytest.mark.parametrize("parts", [None, (50, 4, 100, 40)])
@pytest.mark.parametrize("one, cap, k", [(True, 1000, 5), (False, 1000, 5), (True, 9, 3)])
def test_cells_find_what_all_hits_give(spark, monkeypatch, parts, one, cap, k):
    for name, value in zip(("HITS", "PARTS", "MOST_HITS", "POSTINGS"), parts or ()):
        monkeypatch.setattr(search, name, value)
    a, t, ak, tk = keyed(spark, one)
    got = blocking.candidates(ak, tk, cap, k).select("anchor", "code", (-F.col("score")).cast("double"), "channels", "ret_rank")
    assert sorted(map(tuple, got.collect())) == by_hand(a, t, cap, k)


def test_hits_are_not_rows(spark):
    # 400 anchors and 400 targets with one key: 160,000 hits, of which 400 return
    keys = lambda ids, c: spark.createDataFrame([(i, "x", "name_token", "k") for i in ids], f"{c} bigint, country string, channel string, key string")
    found = blocking.candidates(keys(range(400), "anchor"), keys(range(2 * SOURCE_BASE, 2 * SOURCE_BASE + 400), "code"), k=1).select("anchor", "code")
    assert sorted(map(tuple, found.collect())) == [(i, 2 * SOURCE_BASE) for i in range(400)]
    plan = found._jdf.queryExecution().executedPlan()
    made, todo = 0, [plan]
    while todo:  # the most rows that any join or generator made
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())] + ([node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else [node.plan()] if "QueryStage" in node.nodeName() else [])
        if node.metrics().contains("numOutputRows"):
            made = max(made, node.metrics().apply("numOutputRows").value())
    assert 0 < made <= 10_000


def test_no_keys_find_nothing(spark):
    empty = lambda c: spark.createDataFrame([], f"{c} bigint, country string, channel string, key string")
    assert blocking.candidates(empty("anchor"), empty("code")).count() == 0


@pytest.mark.parametrize("parts", [None, (50, 4, 100, 40)])
def test_tokens_are_compared_where_the_search_ranks(spark, monkeypatch, parts):
    for name, value in zip(("HITS", "PARTS", "MOST_HITS", "POSTINGS"), parts or ()):
        monkeypatch.setattr(search, name, value)
    _, _, ak, tk = keyed(spark, True)
    words = lambda x, c: x.groupBy(c, "country").agg(F.array_sort(F.collect_set("key")).alias("ntok")).withColumn("ntok", F.when(F.col(c) % 5 == 0, F.array().cast("array<string>")).otherwise(F.slice("ntok", 1, 3)))
    a, t = words(ak, "anchor"), words(tk, "code")
    joined = []
    monkeypatch.setattr(select, "reselect", lambda *x, f=select.reselect: joined.append(1) or f(*x))
    rows = lambda x: sorted(map(tuple, x.collect()))
    got = rows(select.select_by_tokens(a, t, ak, tk, 1000, 2, 8, 2))
    assert not joined
    twice = select.select_by_tokens(a, t.unionByName(t.limit(1).withColumn("code", F.lit(7).cast("bigint"))).unionByName(t.limit(1).withColumn("code", F.lit(7).cast("bigint"))), ak, tk, 1000, 2, 8, 2)
    assert joined and got == rows(twice) and len(got) > 100
