import hashlib

from matchloom.llm import line_dedup as ld
from tests.compare import same
from tests.llm.data import awkward, documents

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=2):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(UP)
    held = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(held.get(key(x), ())) >= min_docs and min(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = awkward() + [(60, "x\n" * 3000 + "a repeated line here"), (61, "ÄÖÜÄÖÜÄÖÜÄ\nund"), (62, "ÄÖÜÄÖÜÄÖÜÄ"), (63, "äöüäöüäöüä"), (64, "ééééééééé\nx"), (65, "ééééééééé"), (66, "a repeated line here"), (66, "a repeated line here")]


def test_matches_brute_force(spark):
    got = ld.dedup_lines(documents(spark, ROWS, clash=True)).collect()
    assert sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got), key=str) == brute(ROWS)


def test_more_documents(spark):
    got = ld.dedup_lines(documents(spark, ROWS), min_docs=4).collect()
    assert sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got), key=str) == brute(ROWS, 4)


def test_rows_keep_their_columns(spark):
    docs = documents(spark, ROWS, clash=True)
    out = ld.without_repeated_lines(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in out.collect()) == sorted((str(i), t, len(t)) for i, _, _, t in brute(ROWS))


def test_digests_and_empty_table(spark):
    got = {(r["doc_id"], r["kept_sha256"]) for r in ld.digests(documents(spark, ROWS)).collect()}
    assert got == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, _, _, t in brute(ROWS)}
    assert ld.digests(documents(spark, [])).count() == 0


def test_sql(spark, duck, sf_dir):
    same(ld.digests(spark.read.parquet(f"{sf_dir}/documents.parquet")), duck, ld.ORACLE)
