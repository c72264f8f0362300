"""The character-gram search against dictionaries of grams, and what it makes rows of."""

import math
import random
import unicodedata
from collections import Counter, defaultdict

import pytest

from matchloom.functions import text as tx
from matchloom.operators import chargram, search
from matchloom.schema import SOURCE_BASE

FIELDS = "bigint, country string, glued string, nf string, af string"


def records(spark, n=50, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeß中国𝒳я") for _ in range(rng.randint(1, 3)))
    words = lambda n: " ".join(rng.choice(["rd", "ste", word()]) for _ in range(n))
    make = lambda ids: [(i, ("France", "x", None)[i % 7 % 3], "", words(rng.randint(0, 5)), words(rng.choice([0, 1, 30]))) for i in ids]
    a, t = make(range(1, n)), make([s * SOURCE_BASE + i for s in (2, 3) for i in range(1, n)])
    return a, t, spark.createDataFrame(a, f"anchor {FIELDS}"), spark.createDataFrame(t, f"code {FIELDS}")


def keys(country, glued, name, address):
    name = glued or name.replace(" ", "")
    own = tx.COUNTRY_WORDS.get(country, {})
    address = "".join(own.get(w, tx.ADDRESS_WORDS.get(w, w)) for w in address.split(" "))
    return {("n", name[i : i + 4]) for i in range(len(name) - 3)} | {("a", address[i : i + 5]) for i in range(len(address) - 4)}


def by_hand(a, t, cap, k):
    lists, sums, n = defaultdict(list), defaultdict(lambda: [0.0, 0]), Counter(x[1] for x in t)
    for code, country, *texts in t:
        for key in keys(country, *texts):
            lists[country, key].append(code)
    for anchor, country, *texts in a:
        for key in keys(country, *texts) if country else ():
            found = lists.get((country, key), ())
            for code in found if len(found) <= cap else ():
                sums[anchor, code][0] += math.log1p(n[country] / len(found))
                sums[anchor, code][1] += 1
    groups = defaultdict(list)
    for (anchor, code), (w, shared) in sums.items():
        if shared >= 2:
            groups[anchor, code // SOURCE_BASE].append((-round(w, 6), code, shared))
    return sorted((anchor, code, w, shared, r) for (anchor, _), rows in groups.items() for r, (w, code, shared) in enumerate(sorted(rows)[:k]))


def found(a, t, cap, k):
    got = chargram.gram_candidates(chargram.gram_rows(a, "anchor"), chargram.gram_rows(t, "code"), t, cap, k)
    return sorted((r["anchor"], r["code"], -round(r["score"], 6), r["shared"], r["rank"]) for r in got.collect())


@pytest.mark.parametrize("small", [False, True])
def test_packed_grams_find_what_dictionaries_give(spark, monkeypatch, small):
    if small:  # many cells, few common grams left out early, rows and sums put out often
        for module, name, value in ((search, "POSTINGS", 500), (search, "PARTS", 3), (search, "MOST_HITS", 4000), (chargram, "HITS", 1000), (chargram, "COMMON", 3), (chargram, "COUNTED", 50), (chargram, "SUMS", 20)):
            monkeypatch.setattr(module, name, value)
    a, t, aa, tt = records(spark)
    for cap, k in ((12, 5), (1000, 3)):
        want = by_hand(a, t, cap, k)
        assert found(aa, tt, cap, k) == want and len(want) > 100


def test_id_of_several_countries_is_summed(spark):
    a, t, _, _ = records(spark)
    more = [(i, "x" if c == "France" else "France", g, n, f) for i, c, g, n, f in a[:20] + t[:20]]
    a, t = a + more[:20], t + more[20:]
    assert found(spark.createDataFrame(a, f"anchor {FIELDS}"), spark.createDataFrame(t, f"code {FIELDS}"), 1000, 4) == by_hand(a, t, 1000, 4)


def test_grams_are_not_rows(spark):
    # 60 records of 3000 letters: 180,000 grams
    rng = random.Random(1)
    rows = [(i, "x", "", "", "".join(rng.choices("abcdefghij", k=3000))) for i in range(30)]
    a, t = spark.createDataFrame(rows, f"anchor {FIELDS}"), spark.createDataFrame([(2 * SOURCE_BASE + i, *x) for i, *x in rows], f"code {FIELDS}")
    got = chargram.gram_candidates(chargram.gram_rows(a, "anchor"), chargram.gram_rows(t, "code"), t, k=1).select("anchor", "code")
    assert sorted(map(tuple, got.collect())) == [(i, 2 * SOURCE_BASE + i) for i in range(30)]
    made, todo = 0, [got._jdf.queryExecution().executedPlan()]
    while todo:  # the most rows that any join or generator made
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())] + ([node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else [node.plan()] if "QueryStage" in node.nodeName() else [])
        if node.metrics().contains("numOutputRows"):
            made = max(made, node.metrics().apply("numOutputRows").value())
    assert 0 < made <= 10_000


def test_folding_is_as_before():
    texts = ["Ça été à l'Ångström ﬁx_e;d", "".join(map(chr, range(128))), "zz\x1cý̧ ῼé̈̈ 中国", "क़ाफ़ी", ""]
    for x in texts:
        assert tx.strip_accents(x) == unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))
        assert tx.collapse_punctuation(x) == " ".join(tx._NOT_WORD.sub(" ", x).split())
