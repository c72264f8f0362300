import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from matchloom.llm import mixing
from tests.compare import same
from tests.llm.data import awkward, documents


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows):
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = Fraction(3 * sum(total.values()), 2), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            out.update({s: level * weight[s] for s in free})
            break
        for s in over:
            out[s] = Fraction(2 * total[s])
            left -= out[s]
        free -= over
    return total, out


def brute_stream(rows):
    """For each source: (id, text, size, start) in the order of its stream."""
    out = defaultdict(list)
    for s in {r[2] for r in rows}:
        at = 0
        for i, x, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"{r[0] if r[0] is not None else ''}mix-1".encode()).hexdigest(), r[0] if r[0] is not None else -1, size(r[1]))):
            out[s].append((i, x, size(x), at))
            at += size(x)
    return out


def brute_schedule(rows, block):
    """(slot, source, begin, end) by walking the golden-ratio points one by one."""
    total, target = brute_targets(rows)
    order = [s for s in sorted(total, key=lambda s: (s is None, (s or "").encode())) if int(target[s])]
    words = {s: int(target[s]) for s in order}
    whole = sum(words.values())
    n, edges, at = -(-whole // block), {}, 0
    for s in order:
        edges[s] = at * 2**32 // whole, (at + words[s]) * 2**32 // whole
        at += words[s]
    got = defaultdict(list)
    for i in range(n):
        point = i * 2654435769 % 2**32
        got[next(s for s in order if edges[s][0] <= point < edges[s][1])].append(i)
    for s in order:
        if not got[s]:
            got[s] = [edges[s][0] * n // 2**32]
    return sorted(((slot, s, words[s] * r // len(got[s]), words[s] * (r + 1) // len(got[s])) for s in order for r, slot in enumerate(got[s])), key=lambda x: (x[0], str(x[1])))


def brute_taken(rows, block=mixing.BLOCK):
    """(id, size, source size, words taken, first slot, last slot) of each row."""
    total, target = brute_targets(rows)
    plan, out = brute_schedule(rows, block), []
    for s, stream in brute_stream(rows).items():
        for i, _, n, at in stream:
            hit = [(slot, min(b, first + n) - max(a, first)) for slot, x, a, b in plan if x == s for first in (at, at + total[s]) if n]
            hit = [(slot, w) for slot, w in hit if w > 0]
            out.append((i, n, total[s], sum(w for _, w in hit), min((x for x, _ in hit), default=None), max((x for x, _ in hit), default=None)))
    return out, target


@pytest.mark.parametrize("block", [16, 100, 4096])
def test_matches_brute_force(spark, block):
    rows = awkward()
    got = mixing.mix(documents(spark, rows, clash=True), block).collect()
    want, target = brute_taken(rows, block)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"], r["first_slot"], r["last_slot"]) for r in got if r["doc_id"] != 50), key=str) == sorted((x for x in want if x[0] != 50), key=str)
    for s in {r[2] for r in rows}:  # the two rows of one id and size may change places
        assert sum(r["taken"] for r in got if r["source"] == s) == int(target[s])
    for r in got:
        assert r["target"] == pytest.approx(float(target[r["source"]]))
        assert r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["words"] for p in r["passes"] or [])


def test_schedule_is_brute_force_and_spread(spark):
    """The rows of the schedule, and every front of it near the shares, at two block lengths."""
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1000, "a"), (3000, "b"), (6000, "c"), (3, "d")])]
    sizes = spark.createDataFrame([("a" + s, size(x)) for _, x, s in rows], "key string, size bigint")
    for block in (10, 64):
        target = mixing.targets(sizes, block)
        plan = sorted((r["slot"], r["key"][1:], r["begin"], r["end"]) for r in mixing.schedule(target).collect())
        assert plan == sorted(brute_schedule(rows, block))
        words = {r["key"][1:]: r["words"] for r in target.collect()}
        got = defaultdict(int)
        for n, (_, key, a, b) in enumerate(plan, 1):
            got[key] += b - a
            if n > 20:
                assert all(abs(got[k] / sum(got.values()) - words[k] / sum(words.values())) < 6 / n for k in words)
        assert got == words


def test_mixed_rows(spark):
    """The rows with NULL, repeated and unlike texts of one id: every row is mixed by itself."""
    rows = awkward() + [(60, "same text of five words", "b")] * 3 + [(61, "one text", "a"), (61, "another text", "a")]
    docs = documents(spark, rows, clash=True)
    out = mixing.mixed(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    total, target = brute_targets(rows)
    got, by = defaultdict(int), defaultdict(int)
    emitted = out.collect()
    for r in emitted:
        got[r["doc_id"]] += size(r["text"])
        by[r["source"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert dict(by) == {s: int(t) for s, t in target.items() if int(t)}
    want = defaultdict(int)
    for i, _, _, t, *_ in brute_taken(rows)[0]:
        want[i] += t
    assert {i: n for i, n in got.items() if i not in (50, 60, 61)} == {i: n for i, n in want.items() if n and i not in (50, 60, 61)}
    again = sorted((str(r) for r in mixing.mixed(docs).collect()))
    assert again == sorted(map(str, emitted))


def test_fronts_of_the_mix(spark):
    """Every front of the emitted rows, in file order, holds the sources near their target shares."""
    rows = [(i, f"w{i} " * 20, "abc"[i % 7 % 3]) for i in range(1500)]
    emitted = mixing.mixed(documents(spark, rows), 40).collect()
    _, target = brute_targets(rows)
    whole, got = sum(target.values()), defaultdict(int)
    for n, r in enumerate(emitted, 1):
        got[r["source"]] += size(r["text"])
        if n >= 100:
            assert all(abs(got[s] / sum(got.values()) - target[s] / whole) < 12 / n for s in target)


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    got = mixing.mix(documents(spark, [(1, None), (2, "")])).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_sql(spark, duck, sf_dir):
    out = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert out.filter("last_slot > 0").count()
    same(out.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot"), duck, mixing.ORACLE)
