import random

import numpy as np
import pytest

from matchloom.llm import jaccard_join as jj
from matchloom.llm.graph import components
from tests.llm.data import awkward, documents, words


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} - {()})


def brute(rows):
    docs = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(docs):
        for j, b in docs[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in docs}


def corpus(seed, families=6, size=9, length=90, edits=9):
    rng = random.Random(seed)
    rows, n = [], 0
    for f in range(families):
        base = words(rng, rng.choice([3, 6, 12, length, 2 * length]), 5000)
        for _ in range(size):
            changed = list(base)
            for _ in range(rng.randrange(edits)):
                changed[rng.randrange(len(changed))] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(changed)))
            n += 1
    return rows


def result(spark, rows, **k):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.join(documents(spark, rows, **k)).collect())


def test_matches_brute_force_on_awkward_rows(spark):
    rows = [r for r in awkward() if r[0] != 50 and r[0] is not None]
    assert result(spark, rows, clash=True) == sorted((i, n, c) for i, (n, c) in brute(rows).items())


@pytest.mark.parametrize("small", [48, 3])
def test_matches_brute_force_on_families(spark, monkeypatch, small):
    monkeypatch.setattr(jj, "SMALL", small)
    rows = corpus(small)
    assert result(spark, rows) == sorted((i, n, c) for i, (n, c) in brute(rows).items())


def test_null_ids_repeated_ids_and_empty_table(spark):
    text = "a b c d e f g h"
    got = result(spark, [(1, text), (1, text), (2, text.upper()), (3, None)])
    assert got == [(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 0, 3)]
    assert [tuple(r) for r in jj.join(documents(spark, [(None, text)])).collect()] == [(None, 4, None)]
    assert jj.join(documents(spark, [])).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(5, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = a.copy()
        drop = int(rng.integers(0, max(1, n // 9) + 1))
        b = np.unique(np.concatenate([b[rng.permutation(len(b))[drop:]], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 9) + 1)), dtype=np.uint64) * np.uint64(2)]))
        both = len(np.intersect1d(a, b))
        if len(a) and len(b) and 100 * both >= 80 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            signs = [{(f, int(p), int(v)) for f, at, values in jj.signatures(x, 80) for p, v in zip(at, values)} for x in (a, b)]
            assert signs[0] & signs[1]
            x = jj.folded([jj.sketch(a, 4), jj.sketch(b, 8)])
            assert jj.may_link(len(a), len(b), x[0], x[1], 80)
            assert jj.linked(a, b, 80) and jj.linked(b, a, 80)


def test_components(spark, tmp_path):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (-5, 3)] + [(200, i) for i in range(201, 260)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), str(tmp_path / "c")).collect()}
    assert all(got[i] == -5 for i in range(0, 41)) and got[100] == 90 and got[95] == 90 and all(got[i] == 200 for i in range(201, 260))


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    text, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = text.replace("a0 ", "zz ")
    cases = [
        ([(10, text), (50, text), (50, other)], [(10, text), (50, other)]),
        ([(50, text), (50, other)], [(50, text), (50, other)]),
        ([(50, text), (50, text), (50, other), (50, other)], [(50, text), (50, other)]),
        ([(7, ""), (7, ""), (7, None), (None, text), (None, text), (9, text)], [(7, ""), (7, ""), (7, None), (9, text), (None, text), (None, text)]),
        ([(50, other), (50, text), (60, near), (60, other)], None),
    ]
    for rows, want in cases:
        got = sorted(((r["doc_id"], r["text"]) for r in jj.without_near_copies(documents(spark, rows)).collect()), key=str)
        if want is None:  # one row of either group, by id 50
            assert [i for i, _ in got] == [50, 50] and {t for _, t in got} == {text, other}
        else:
            assert got == sorted(want, key=str)
        assert got == sorted(((r["doc_id"], r["text"]) for r in jj.without_near_copies(documents(spark, rows[::-1])).collect()), key=str)
    got = sorted(tuple(r) for r in jj.join(documents(spark, [(50, text), (50, other), (3, near), (60, other)])).collect())
    assert got == [(3, 36, 3), (50, 36, 3), (50, 36, 50), (60, 36, 50)]


def test_hubs_are_split(spark, tmp_path):
    """Pairs of one class with many others give the same links from one task or many."""
    rows = [(i, " ".join(f"w{j}" for j in range(60 + i % 9))) for i in range(9)]
    docs = documents(spark, rows)
    sets = {i: jj.shingle_set(jj.WordHashes(), t.encode()) for i, t in rows}
    classes = spark.createDataFrame([(bytearray(jj.class_of(x)), i, i) for i, x in sets.items()], "class binary, no bigint, rep bigint")
    pairs = spark.createDataFrame([(bytearray(jj.class_of(sets[0])), bytearray(jj.class_of(sets[i])), 0, i) for i in range(1, 9)], jj.PAIRS)
    found = [sorted(tuple(r) for r in jj.verified(pairs, classes, docs, str(tmp_path / f"h{hub}"), 5, 80, hub).collect()) for hub in (2, 2000)]
    assert found[0] == found[1] == [(0, i) for i in range(1, 9)]


@pytest.mark.parametrize("how", [(1, 1), (1, 2), (1, 3), (2, 2), (3, 1)])
def test_all_ways_to_partition_keep_links(monkeypatch, how):
    """Whatever (n1, s) a band takes, linked sets share a signature."""
    monkeypatch.setattr(jj, "choose", lambda k: (min(how[0], k + 1), how[1]))
    jj.bands.cache_clear()
    try:
        families = jj.bands()[1][:14]
        assert all(n1 * n2 < 120 for n1, n2, _, _ in families)
        rng = np.random.default_rng(7)
        for _ in range(300):
            n = int(rng.integers(5, 40))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[int(rng.integers(0, n // 8 + 1)) :]], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64) * np.uint64(2)]))
            if jj.linked(a, b, 80) and not (len(a) == len(b) and (a == b).all()):
                x, y = ({(f, int(p), int(v)) for f, at, values in jj.signatures(e, 80) for p, v in zip(at, values)} for e in (a, b))
                assert x & y
    finally:
        jj.bands.cache_clear()


def test_one_of_each_group_stays(spark):
    rows = awkward()
    docs = documents(spark, rows, clash=True)
    kept = jj.without_near_copies(docs)
    assert kept.columns == docs.columns
    want = sorted([i for i, (_, c) in brute([r for r in rows if r[0] != 50]).items() if i == c] + [50, 50])
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == want and got.count(None) == 1
