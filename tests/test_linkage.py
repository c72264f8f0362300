import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import blocking, compete, context, decide, features, keys, labels, metrics, records, select, splits, stats
from matchloom.schema import CHANNELS, EXTRA_CHANNELS, code_source, code_value, entity_id, id_value, safe_label, source_of, target_code


def recs(spark, rows):
    return records.prepared(records.with_codes(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")))


POOL = [
    ("S1-1", "Acme Tools Ltd", "12 Long Road, 02003 Springfield", "US"), ("S2-10", "ACME TOOLS", "12 long rd 2003 springfield", "US"), ("S2-11", "ACME TOOLS", "12 long rd 2003 springfield", "US"),
    ("S3-12", "acme-tools", "", "US"), ("S2-13", "Acme Tools", "12 Long Road 2003 Springfield", "UK"), ("S2-14", "", "", "US"), ("S1-2", "", "", "US"), ("S1-3", "Zeta Nowhere", "x", "Narnia"), ("S3-15", "Zeta Nowhere", "y", "Narnia"),
]


def sides(p):
    return p.filter("source = 1").withColumn("anchor", F.col("id")), p.filter("source <> 1")


def test_ids(spark):
    row = spark.createDataFrame([("S3-42",)], "e string").select(source_of(F.col("e")).alias("s"), id_value(F.col("e")).alias("v"))
    assert tuple(row.first()) == (3, 42)
    back = row.select(entity_id(F.col("s"), F.col("v")), code_source(target_code(F.col("s"), F.col("v"))), code_value(target_code(F.col("s"), F.col("v"))), safe_label(F.lit("a b/c")), safe_label(F.lit(" ")))
    assert tuple(back.first()) == ("S3-42", 3, 42, "a_b_c", "_blank_")
    for bad in ("S4-1", "S1-01", "S1-", "S1-2000000001", "S1-x", None):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "e string").select(source_of(F.col("e")), id_value(F.col("e"))).collect()


def test_blocking(spark):
    a, t = sides(recs(spark, POOL))
    ak, tk = keys.keys(a, CHANNELS, ("anchor",)), keys.keys(t, CHANNELS, ("code",))
    got = {(r["anchor"], r["code"]): r for r in blocking.candidates(ak, tk).collect()}
    base = 2_000_000_000
    assert set(got) == {(1, 2 * base + 10), (1, 2 * base + 11), (1, 3 * base + 12), (3, 3 * base + 15)}  # twins kept, other country and blanks never
    assert got[(1, 2 * base + 10)]["ret_rank"] == 0 and got[(1, 2 * base + 11)]["ret_rank"] == 1 and got[(1, 3 * base + 12)]["ret_rank"] == 0
    capped = {(r["anchor"], r["code"]) for r in blocking.candidates(ak, tk, cap=1).collect()}
    assert capped == {(3, 3 * base + 15)} or all(x[0] == 3 or x[1] == 3 * base + 12 for x in capped)
    counts = {r["code"]: r for r in blocking.pool_counts(blocking.candidates(ak, tk), ak, tk).collect()}
    assert counts[2 * base + 10]["t_name_cnt"] == 3 and counts[2 * base + 10]["t_addr_cnt"] == 2 and counts[3 * base + 12]["t_addr_cnt"] == 0


def test_partitions_do_not_matter(spark):
    p = recs(spark, POOL)
    run = lambda x: sorted(tuple(r) for r in blocking.candidates(*(keys.keys(s, CHANNELS, (c,)) for s, c in zip(sides(x), ("anchor", "code")))).collect())
    assert run(p.coalesce(1)) == run(p.repartition(7))


def test_extra_channels_and_bags(spark):
    p = recs(spark, [("S2-1", "abc", "4031 4052 400 longword", "US")])
    got = [r["key"] for r in keys.keys(p, ("num_trunc",)).collect()]
    assert sorted(got) == ["nt|40|longword"] * 3
    assert {r["channel"] for r in keys.keys(recs(spark, POOL), EXTRA_CHANNELS).collect()} >= {"addr_pair", "addr_nonum"}


def test_rarity(spark):
    p = recs(spark, [(f"S2-{i}", f"common rare{i} thing", "", "US") for i in range(1, 9)])
    freq = stats.token_freq(p)
    assert {(r["token"], r["scope"], r["df"]) for r in freq.collect()} == {(w, s, 8) for w in ("common", "thing") for s in ("US", "*")}
    first = stats.in_rarity_order(p, freq).select(F.element_at("ntok", 1).alias("t")).distinct().collect()
    assert {r["t"] for r in first} == {f"rare{i}" for i in range(1, 9)}


def test_select(spark):
    rows = [(1, 100 + i, 2, float(50 - i), 1, i, 0.1 * i) for i in range(10)]
    wide = spark.createDataFrame(rows, "anchor int, code int, source int, score double, channels int, ret_rank int, formula double")
    assert sorted(r["code"] for r in select.reselect(wide, 3, 2).collect()) == [100, 101, 102, 108, 109]
    extra = spark.createDataFrame([(1, 101, 2, 5.0, 1024, 0), (1, 999, 2, 4.0, 1024, 1)], "anchor int, code int, source int, score double, channels int, ret_rank int")
    got = {r["code"]: r for r in select.add_quota(wide.filter("ret_rank < 3"), extra, 150).collect()}
    assert got[101]["channels"] == 1025 and got[101]["ret_rank"] == 1 and got[101]["score"] == 49.0
    assert got[999]["ret_rank"] == 150 and got[999]["channels"] == 1024 and len(got) == 4


def test_context(spark):
    p = spark.createDataFrame([(1, 1, 2, 9.0, 0.9, None), (1, 2, 2, 8.0, 0.9, 0.5), (1, 3, 3, 7.0, 0.5, 0.2), (1, 4, 3, 6.0, None, None), (2, 5, 2, 1.0, 0.7, 0.7)], "anchor int, code int, source int, ret_score double, name_tset double, addr_tset double")
    got = {r["code"]: r for r in context.rival_context(p).collect()}
    assert [got[i]["name_rank_avail"] for i in (1, 2, 3, 4)] == [0, 0, 2, None]
    assert got[1]["name_tset_lead"] == 0 and got[5]["name_tset_lead"] == pytest.approx(0.7) and got[4]["name_tset_lead"] == pytest.approx(-0.9)
    assert got[1]["combo_rank"] == 1 and got[1]["avail_rank"] == 0 and got[4]["avail_rank"] is None
    assert got[1]["n_cands"] == 4 and got[3]["ret_score_gap"] == 2.0


def pairs(spark, rows):
    return spark.createDataFrame(rows, "anchor int, target int, p double")


def test_competition(spark):
    got = {(r["anchor"], r["target"]): r for r in compete.competition(pairs(spark, [(1, 7, 0.9), (1, 8, 0.3), (2, 7, 0.6)])).collect()}
    assert [got[x]["t_nclaims"] for x in ((1, 7), (1, 8), (2, 7))] == [2, 1, 2]
    assert [got[x]["t_best_other"] for x in ((1, 7), (1, 8), (2, 7))] == [0.6, 0.0, 0.9]
    assert [round(got[x]["t_margin"], 6) for x in ((1, 7), (1, 8), (2, 7))] == [0.3, 0.3, -0.3]


def kept(frame):
    return {(r["anchor"], r["target"]) for r in frame.collect() if r["keep"]}


def test_decisions(spark):
    p = pairs(spark, [(1, 7, 0.9), (2, 7, 0.95), (3, 7, 0.95), (3, 8, 0.4), (4, 9, 0.3)])
    owned = decide.one_owner(decide.threshold(p, 0.8))
    assert kept(owned) == {(2, 7)}
    assert kept(decide.rescue(owned, 0.35)) == {(2, 7), (1, 7), (3, 7)}
    claimed = spark.createDataFrame([(7,)], "target int")
    assert {(r["anchor"], r["target"]) for r in decide.unclaimed_rescue(p, claimed, 0.3).collect()} == {(3, 8), (4, 9)}
    assert kept(decide.expected_f05(pairs(spark, [(1, 1, 0.9), (1, 2, 0.1), (2, 3, 0.2)]))) == {(1, 1)}


@pytest.mark.parametrize("p", [[0.9, 0.5, 0.2], [1.0, 0.0], [0.3], [0.99, 0.98, 0.97, 0.5, 0.01], []])
def test_exact_utilities(p):
    want = []
    for k in range(len(p) + 1):
        total = 0.0
        for outcome in np.ndindex(*[2] * len(p)):
            chance = np.prod([x if o else 1 - x for x, o in zip(p, outcome)])
            tp, n = sum(outcome[:k]), sum(outcome)
            total += chance * ((1.0 if n == 0 else 0.0) if k == 0 else 5 * tp / (4 * k + n))
        want.append(total)
    assert np.allclose(decide.utilities(np.array(p)), want)


def test_metrics(spark):
    cases = [(0, 0, 0, 1.0), (0, 1, 0, 0.0), (0, 0, 2, 0.0), (2, 0, 2, 1.0), (1, 0, 2, 5 / 6), (1, 1, 1, 5 / 9), (0, 3, 2, 0.0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, tp int, fp int, n_true int, want double")
    for r in rows.withColumn("got", metrics.f05(F.col("tp"), F.col("fp"), F.col("n_true"))).collect():
        assert r["got"] == pytest.approx(r["want"])
    with pytest.raises(Exception):
        rows.select(metrics.f05(F.lit(3), F.lit(0), F.lit(2))).collect()
    counts = spark.createDataFrame([(i,) for i in [5, 1, 2, 2, 9]], "n int")
    assert tuple(metrics.lower_percentile(counts, "n", {"a": 0.5, "b": 0.95}).first()) == (2.0, 5.0)


def test_split(spark):
    anchors = spark.createDataFrame([(i, "A" if i % 3 else "B") for i in range(200)], "anchor int, country string")
    truth = spark.createDataFrame([(i, 1000 * i + j) for i in range(200) for j in range(i % 5)], "anchor int, code int")
    codes = [(1000 * i + j, 2 + j % 2, "A" if i % 3 else "B") for i in range(200) for j in range(i % 5)] + [(10**6 + i, 2 + i % 2, "A") for i in range(300)]
    targets = spark.createDataFrame(codes, "code int, source int, country string")
    a, t = splits.make_split(anchors, targets, truth)
    assert splits.leaks(a, t, truth).count() == 0 and a.count() == 200 and t.count() == len(codes)
    sizes = [r["count"] for r in a.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 10
    again, _ = splits.make_split(anchors.repartition(3), targets, truth)
    assert sorted(map(tuple, a.select("anchor", "fold").collect())) == sorted(map(tuple, again.select("anchor", "fold").collect()))


def test_features(spark):
    p = recs(spark, POOL)
    a, t = sides(p)
    ak, tk = keys.keys(a, CHANNELS, ("anchor",)), keys.keys(t, CHANNELS, ("code",))
    out = features.features(blocking.pool_counts(blocking.candidates(ak, tk), ak, tk), a, t, stats.token_freq(p))
    assert len(features.FEATURES) == 70 and out.columns == ["anchor", "code", "source", *features.FEATURES]
    assert len(features.CHEAP) == 30 and not {"country", "code", "anchor"} & set(features.FEATURES)
    got = {r["code"]: r for r in out.collect()}
    twin, bare = got[4_000_000_010], got[6_000_000_012]
    assert twin["name_tset"] == 1.0 and twin["num_jacc"] == 1.0 and twin["addr_tset"] > 0.9 and twin["ns_ratio"] == 1.0
    assert bare["addr_tset"] is None and bare["addr_empty_t"] == 1.0 and bare["addr_len_ratio"] is None and bare["num_jacc"] is None and bare["num_n_a"] == 2.0


def test_number_evidence(spark):
    rows = [(["1703"], ["170"], [], []), (["2046"], ["2048"], ["01234"], ["01234"]), (["0"], ["0"], ["11111"], ["22222"]), ([], ["1"], [], []), (["9" * 25], ["9" * 25], [], [])]
    f = spark.createDataFrame(rows, "nums_a array<string>, nums_t array<string>, postal_a array<string>, postal_t array<string>")
    got = f.select(*(c.alias(n) for n, c in features.number_evidence().items())).collect()
    assert got[0]["num_prefix"] == 1.0 and got[1]["num_min_reldiff"] == pytest.approx(2 / 2048) and got[1]["postal_equal"] == 1.0
    assert got[2]["num_min_reldiff"] == 0.0 and got[2]["postal_conflict"] == 1.0 and got[3]["num_jacc"] is None and got[3]["num_n_t"] == 1.0 and got[4]["num_first_equal"] == 1.0


def test_truth_edges_and_checks(spark):
    t = spark.createDataFrame([("S1-1", "S2-1, ,S3-2,S2-1"), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    assert [r["target_entity_id"] for r in labels.truth_edges(t).orderBy("position").collect()] == ["S2-1", "S3-2", "S2-1"]
    with pytest.raises(ValueError):
        labels.require_unique(labels.truth_edges(t), ["target_entity_id"], "ids")


def test_split_refuses_truth_that_does_not_fit(spark):
    anchors = spark.createDataFrame([(i, "x") for i in range(1, 5)], "anchor bigint, country string")
    targets = spark.createDataFrame([(i, 2, None) for i in range(10, 15)], "code bigint, source int, country string")
    truth = lambda rows: spark.createDataFrame(rows, "anchor bigint, code bigint")
    for rows, what in (([(9, 10)], "anchor 9"), ([(1, 99)], "target 99"), ([(1, 10), (2, 10)], "shared target 10")):
        with pytest.raises(ValueError, match=what):
            splits.make_split(anchors, targets, truth(rows))
    a, t = splits.make_split(anchors, targets, truth([(1, 10), (1, 11)]))
    assert a.count() == 4 and t.count() == 5 and not splits.leaks(a, t, truth([(1, 10), (1, 11)])).count()


def test_deal_is_a_rank_in_hash_order(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("s"))
    want = rows.withColumn("fold", ((F.row_number().over(Window.partitionBy("s").orderBy(F.xxhash64("id", F.lit(4)), "id")) - 1) % 5).cast("tinyint"))
    assert sorted(map(str, splits.deal(rows, ["s"], "id", 5, 4).collect())) == sorted(map(str, want.collect()))
