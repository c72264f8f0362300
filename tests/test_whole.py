"""Queries do the whole job: cases that a cut of their input would lose."""

from matchloom import queries as core


def test_gbt_match_scores_every_pair(spark):
    sf_dir = "/root/testdata/sf0.01"  # more than 20,000 pairs
    got = [(r["anchor"], r["target"]) for r in core.QUERIES["gbt_match"](spark, sf_dir).collect()]
    want = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect()
    assert len(got) == len(want) > 20_000 and set(got) == set(map(tuple, want))


def documents(spark, tmp_path, bodies):
    rows = [(i, f"amber birch\n{body}", "en", f"src{i}") for i, body in enumerate(bodies, 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_words_after_200_characters_count(spark, tmp_path):
    same = "filler " * 40
    sf_dir = documents(spark, tmp_path, [same + "cedar", same + "cedar", same + "delta"])
    assert [r["copies"] for r in core.QUERIES["exact_duplicates"](spark, sf_dir).collect()] == [2, 2]
    assert {r["token"]: r["df"] for r in core.QUERIES["token_freq"](spark, sf_dir).filter("field = 'a' and scope = '*'").collect()} == {"filler": 3, "cedar": 2}
    assert sorted(r["key"].split()[-1] for r in core.QUERIES["keys_addr_exact"](spark, sf_dir).collect()) == ["cedar", "cedar", "delta"]


def test_search_keeps_blocks_of_more_than_100(spark, tmp_path):
    # 1 anchor (source 1) and 120 targets with its text: one block of 120 a key
    rows = [(i, "amber birch\ncedar delta", "en", "src3" if i == 1 else "src1") for i in range(1, 122)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda n: core.QUERIES[n](spark, str(tmp_path)).count()
    assert run("blocking_topk") == 25 and run("missing_positives") == 95
    assert run("needed_records") == run("label_pairs") == 25


def test_chargrams_of_addresses_in_large_groups(spark, tmp_path):
    # 60 targets share only a long address with the anchor: over the cap of 40, no name gram in common
    name = lambda i: "qqqqqqqq" if i == 1 else f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 4
    body = "filler " * 40 + "zwischenraum"
    rows = [(i, f"{name(i)}\n{body}", "en", "src3" if i == 1 else "src1") for i in range(1, 62)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = core.QUERIES["chargram_topk"](spark, str(tmp_path)).collect()
    squeezed = body.replace(" ", "")
    grams = {squeezed[i : i + 5] for i in range(len(squeezed) - 4)}
    assert len(got) == 30 and {r["shared"] for r in got} == {len(grams)}


def test_audit_and_numbers_read_tables(spark, tmp_path):
    # a fault planted in the input: order 22 and part 5 are missing, all other rows are sound
    spark.createDataFrame([(i, i + 100) for i in range(1, 22)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i,) for i in range(1, 23) if i != 5], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, i) for i in range(1, 23)], "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["problem"]: r["n"] for r in core.QUERIES["truth_audit"](spark, str(tmp_path)).collect()}
    assert got == {"truth_without_record": 1, "record_without_truth": 0, "unknown_target": 1, "repeated_in_list": 0, "claimed_twice": 0}
    assert core.QUERIES["number_forms"](spark, str(tmp_path)).count() == 21


def test_no_scored_pair_is_left_out(spark, sf_dir):
    reasons = {r["reason"]: r["n"] for r in core.QUERIES["error_reasons"](spark, sf_dir).collect()}
    assert "not_retrieved" not in reasons and reasons["false_positive"] > 0
    owned = {r["target"] for r in core._owned(spark, sf_dir).filter("keep").collect()}
    assert not owned & {r["target"] for r in core.QUERIES["decide_unclaimed"](spark, sf_dir).collect()}
