from collections import Counter

import corpus_pipeline
from matchloom.llm import line_dedup, mixing, queries
from matchloom.llm.common import table
from matchloom.llm.toxicity import toxicity
from tests.llm.data import awkward, documents
from tests.llm.test_jaccard_join import brute as links
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_mixing import brute_taken, size


def test_stages_one_by_one(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "jaccard_join", "mixing", "bpe"]
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda f: [(r["doc_id"], r["text"], r["source"]) for r in f.collect()]

    clean = stage["toxicity"](spark, docs, sf_dir).cache()
    bad = {r["doc_id"] for r in toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").collect()}
    assert clean.schema == docs.schema and {r[0] for r in rows(docs)} - {r[0] for r in rows(clean)} == bad

    once = stage["line_dedup"](spark, clean, sf_dir).cache()
    assert once.columns == docs.columns and sorted((r[0], r[1]) for r in rows(once)) == sorted((i, t) for i, _, _, t in lines(rows(clean)))

    one = stage["jaccard_join"](spark, once, sf_dir).cache()
    assert one.columns == docs.columns and sorted(r[0] for r in rows(one)) == sorted(i for i, (_, c) in links(rows(once)).items() if i == c)

    mix = stage["mixing"](spark, one, sf_dir).cache()
    got = Counter()
    for i, t, _ in rows(mix):
        got[i] += size(t)
    assert mix.columns == docs.columns and dict(got) == {i: t for i, _, _, t, *_ in brute_taken(rows(one))[0] if t}

    last = stage["bpe"](spark, mix, sf_dir)
    assert last.count() == mix.count() and all(r["n_tokens"] == len(r["ids"]) for r in last.collect())


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    """NULLs, repeated ids, empty and long texts and clashing columns end to end; then no rows at all."""
    rows = awkward() + [(50, "unlike text of its own under a repeated id", "b"), (51, None, None), (None, None, None)]
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 1), (6, 1, None), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    for name, docs in (("some", documents(spark, rows, clash=True)), ("none", documents(spark, [], clash=True))):
        sf_dir = str(tmp_path / name)
        docs.write.parquet(f"{sf_dir}/documents.parquet")
        labels.write.parquet(f"{sf_dir}/labels.parquet")
        out = corpus_pipeline.run(spark, sf_dir)
        assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
        got = out.collect()
        assert {r["doc_id"] for r in got} <= {r[0] for r in rows} and all(r["n_tokens"] == len(r["ids"]) for r in got)
        assert bool(got) == (name == "some")
        stages = dict(corpus_pipeline.STAGES)
        for stage in ("toxicity", "line_dedup", "jaccard_join", "mixing"):
            assert stages[stage](spark, docs, sf_dir).columns == docs.columns


def test_unlike_rows_of_one_id_reach_the_end(spark, tmp_path):
    texts = [f"text number {i} " + " ".join(f"v{i}x{j}" for j in range(30)) for i in range(4)]
    rows = [(50, texts[0], "a"), (50, texts[1], "a"), (60, texts[2], "a"), (61, texts[2] + " tail", "a"), (70, texts[3], "b")]
    docs = documents(spark, rows)
    kept = sorted((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, "").collect())
    assert kept == sorted([(50, texts[0]), (50, texts[1]), (60, texts[2]), (70, texts[3])])


def test_registered(spark, sf_dir):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {x.split("_")[0] for x in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in found and set(__spark_entry__.oracle_sql()) <= set(found)
    assert {line_dedup.ORACLE, mixing.ORACLE} <= set(queries.oracle_sql().values())
