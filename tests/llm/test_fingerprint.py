import hashlib

import numpy as np

from matchloom.llm import fingerprint as fp
from matchloom.llm.common import WordHashes
from tests.llm.data import awkward, documents


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_rows_match_brute_force(spark):
    rows = [r for r in awkward() if r[0] is not None and r[0] != 50] + [(-3, "min us three words here now")]
    got = {r["doc_id"]: r for r in fp.fingerprints(documents(spark, rows, clash=True)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for r, nxt in zip(order, order[1:] + order[:1]):
        text, other = r[1] or "", nxt[1] or ""
        m = len(text) // 3
        changed = text[: len(text) - m] + other[:m]
        x = got[r[0]]
        assert x["n_chars"] == len(text)
        assert x["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        exact = len(shingles(text) | shingles(changed)) <= fp.K
        assert abs(x["near_edited"] - jaccard(shingles(text), shingles(changed))) < (1e-9 if exact else 0.15)
        assert abs(x["near_next"] - jaccard(shingles(text), shingles(other))) < (1e-9 if len(shingles(text) | shingles(other)) <= fp.K else 0.15)
        if len(shingles(text)) < fp.K:
            assert x["n_shingles_est"] == len(shingles(text))


def test_equal_texts_have_equal_fingerprints_and_repeated_rows_stay(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A  b c D e\nf"), (None, "x"), (3, None)]
    got = fp.fingerprints(documents(spark, rows)).collect()
    assert len(got) == 5
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert [r["fingerprint"] for r in got if r["doc_id"] == 3] == ["0:"]


def test_one_row_and_empty_table(spark):
    (r,) = fp.fingerprints(documents(spark, [(5, "a b c d e f g h i")])).collect()
    assert r["near_next"] == 1.0
    assert fp.fingerprints(documents(spark, [])).count() == 0


def test_sketches_merge_and_estimate():
    w = WordHashes()
    parts = [" ".join(f"w{(i * 7 + j) % 5003}" for i in range(3000)).encode() for j in range(2)]
    a, b = (fp.sketch(w, p) for p in parts)
    whole = np.unique(np.concatenate([fp.shingle_hashes(w.of(p.split())) for p in parts]))
    assert (fp.merge(a, b) == whole[: fp.K]).all()
    assert abs(fp.distinct(fp.merge(a, b)) / len(whole) - 1) < 0.25
    assert fp.decode(fp.encode(a)).tolist() == a.tolist()
    assert fp.containment(a, a) == 1.0
