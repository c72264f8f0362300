"""Pair columns worked out in cells against column expressions on joined rows, and what they shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions.similarity import pair_similarities
from matchloom.operators import context, features, paired
from matchloom.schema import SOURCE_BASE

TEXT = ["", "acme", "acme tools ltd", "north acme tools", "blue river traders", "river blue", "ab", "x" * 90]
NUMBERS = [[], ["12"], ["12", "123"], ["1234", "123", "0"], ["7", "70", "12", "9", "99999"], ["9" * 400]]
RECORD = "country string, name string, name_ns string, glued string, addr string, nums array<string>, nums_j array<string>, postal array<string>, indic boolean, ntok array<string>"


def frames(spark, n=25, twice=False, seed=5):
    rng = random.Random(seed)
    pick = lambda: ("c", rng.choice(TEXT), rng.choice(TEXT), rng.choice(["", "acmetools", "blueriver"]), rng.choice(TEXT), rng.choice(NUMBERS), rng.choice(NUMBERS), rng.choice([[], ["12345"], ["12345", "99999"]]), rng.random() < 0.5, rng.choice([[], ["acme"], ["acme", "tools"], ["blue", "river", "tools"]]))
    ids, codes = range(1, n), [s * SOURCE_BASE + i for s in (2, 3) for i in range(1, n)]
    a = spark.createDataFrame([(i, *pick()) for i in [*ids, *[4] * twice]], f"anchor bigint, {RECORD}")
    t = spark.createDataFrame([(c, *pick()) for c in [*codes, *[codes[3]] * twice]], f"code bigint, {RECORD}")
    rows = [(i, c, c // SOURCE_BASE, rng.choice([1.5, 2.25, 9.0]), rng.randrange(1, 256), r, *(rng.randrange(4) for _ in range(4))) for i in [*ids, 999] for r, c in enumerate(rng.sample(codes, rng.randrange(1, 9)))]
    pairs = spark.createDataFrame(rows, "anchor bigint, code bigint, source tinyint, score float, channels int, ret_rank int, " + ", ".join(f"{c} int" for c in paired.COUNTS))
    freq = spark.createDataFrame([("n", "c", "acme", 900), ("n", "c", "tools", 30), ("a", "c", "acme", 5), ("a", "c", "river", 70)], "field string, scope string, token string, df bigint")
    return pairs, a, t, freq


def joined(pairs, a, t, freq):
    """The pairs as rows with both records, and the column expressions on them."""
    a, t = features.weighted(a, freq, "anchor"), features.weighted(t, freq, "code")
    own = features.TEXTS + features.WEIGHTS
    out = pairs.join(a.select("anchor", *(F.col(c).alias(f"{c}_a") for c in own)), "anchor").join(t.select("code", *(F.col(c).alias(f"{c}_t") for c in own)), "code")
    out = out.withColumn("s", pair_similarities("name_a", "name_t", "name_ns_a", "name_ns_t", "addr_a", "addr_t")).withColumnRenamed("score", "ret_score")
    out = out.withColumn("no", features.token_overlap(F.col("nw_a"), F.col("nw_t"))).withColumn("ao", features.token_overlap(F.col("aw_a"), F.col("aw_t")))
    out = out.select("*", "s.*", *(F.col(f"no.{k}").alias(f"name_{k}") for k in ("jacc", "wov", "wshared_max", "wmiss_a", "wmiss_t")), *(F.col(f"ao.{k}").alias(f"addr_{k}") for k in ("jacc", "wov", "wshared_max")))
    out = out.withColumns(features.number_evidence() | features.joined_numbers())
    return context.rival_context(out)


def values(frame, columns):
    rows = frame.select("anchor", "code", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in columns)).collect()
    return sorted([tuple(r) for r in rows], key=repr)


def same(got, want):
    assert len(got) == len(want) > 50
    for x, y in zip(got, want, strict=True):
        assert [v is None for v in x] == [v is None for v in y] and [v for v in x if v is not None] == pytest.approx([v for v in y if v is not None], abs=2e-4)


@pytest.mark.parametrize("parts", [None, (7, 3, 20)])
def test_cells_give_what_joined_rows_give(spark, monkeypatch, parts):
    for name, value in zip(("PAIRS", "ROWS", "ITEMS"), parts or ()):
        monkeypatch.setattr(paired, name, value)
    given = frames(spark)
    want = joined(*given)
    compared = [c for c in features.FEATURES if c in want.columns and c not in paired.COUNTS]
    assert len(compared) >= 46
    same(values(features.features(*given), compared), values(want, compared))
    cheap = {f"c_{c}": c for c in ("name_ratio", "name_jw", "name_tset", "ns_tset", "addr_ratio", "addr_tset")}
    got = features.cheap_features(*given[:3])
    same(values(got.select("anchor", "code", *(F.col(c).alias(n) for c, n in cheap.items())), cheap.values()), values(want, cheap.values()))


def test_counts_repeated_and_missing_records(spark):
    pairs, a, t, _ = frames(spark, twice=True)
    got = features.cheap_features(pairs, a, t)
    rows = pairs.join(a.select("anchor"), "anchor").join(t.select("code"), "code")  # anchor 999 has no record
    assert got.count() == rows.count() and got.filter("anchor = 999").isEmpty()
    counts = lambda x, c: sorted((r[0], r[1], round(r[2], 4)) for r in x.select("anchor", "code", c).collect())
    assert counts(got, "t_addr_cnt") == counts(rows.withColumn("t_addr_cnt", F.log1p("t_addr_cnt")), "t_addr_cnt")
    bare = pairs.drop(*paired.COUNTS)
    found = features.cheap_features(bare, a.withColumn("a_name_cnt", F.lit(3)), t.withColumn("t_name_cnt", F.lit(None).cast("int")))
    assert {(round(r[0], 4), r[1], r[2]) for r in found.select("a_name_cnt", "t_name_cnt", "a_addr_cnt").collect()} == {(1.3863, 0.0, 0.0)}
    assert features.cheap_features(pairs.limit(0), a, t).count() == 0


def shuffled(frame):
    """Bytes that the exchanges of a frame's run sent."""
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    size, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())] + ([node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else [node.plan()] if "QueryStage" in node.nodeName() else [])
        if node.nodeName() == "Exchange":
            size += node.metrics().apply("dataSize").value()
    return size


@pytest.mark.parametrize("full", [False, True])
def test_texts_are_not_shuffled_with_pairs(spark, full):
    """100 anchors with 100 candidates each and texts of 1000 characters: 40 MB if pairs took their texts along."""
    pairs, a, t, freq = frames(spark, 101)
    long = F.repeat(F.concat(F.lit("w"), F.substring(F.col("name"), 1, 1)), 500)
    a, t = (x.filter(F.col(c) % 1000 < 101).withColumns({c: long for c in ("name", "name_ns")}) for x, c in ((a, "anchor"), (t, "code")))
    t = t.filter(F.col("code") < 3 * SOURCE_BASE)
    wide = a.select("anchor").crossJoin(t.select("code")).withColumns({"source": F.lit(2), "score": F.lit(1.0).cast("float"), "channels": F.lit(1), "ret_rank": F.lit(0), **{c: F.lit(1) for c in paired.COUNTS}})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = features.features(wide, a, t, freq) if full else features.cheap_features(wide, a, t)
        assert out.count() == 10_000
        assert shuffled(out) < 10_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
