from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.functions import similarity as sim

WORDS = st.text(alphabet="abcé 1", max_size=14)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_lcs(a, b):
    assert sim.lcs_length(a, b) == lcs(a, b)
    assert 0 <= sim.jaro_winkler(a, b) <= 1 and abs(sim.jaro_winkler(a, b) - sim.jaro_winkler(b, a)) < 0.35
    assert sim.token_set_ratio(a, a) == (1.0 if a.split() else 0.0)
    assert sim.token_sort_ratio(a, " ".join(reversed(a.split()))) == sim.ratio(" ".join(sorted(a.split())), " ".join(sorted(a.split())))


SINGLE = {"ratio": sim.ratio, "jw": sim.jaro_winkler, "tsort": sim.token_sort_ratio, "tset": sim.token_set_ratio}
LONG = st.text(alphabet="abcé \0\U0001f600", max_size=90)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(LONG, LONG) | st.tuples(WORDS, WORDS), max_size=12))
def test_lanes_equal_single_pairs(pairs):
    pairs = pairs + [("a" * 64, "ba" * 32), ("ab" * 32, "ba" * 200), ("b" * 65, "ab" * 40)]
    assert list(sim.lcs_lengths(pairs)) == [lcs(a, b) for a, b in pairs]
    for kind, kernel in SINGLE.items():
        got = sim.KERNELS[kind]([p for p in pairs if p[0] and p[1]])
        assert list(got) == [kernel(*p) for p in pairs if p[0] and p[1]]


def test_known_values():
    assert abs(sim.jaro_winkler("martha", "marhta") - 0.9611111) < 1e-6
    assert abs(sim.jaro_winkler("dixon", "dicksonx") - 0.8133333) < 1e-6
    assert sim.ratio("abcd", "abxd") == 0.75
    assert sim.token_set_ratio("acme tools", "acme tools limited") == 1.0


def test_missing_sides(spark):
    rows = spark.createDataFrame([("", "a"), ("a", ""), ("a b", "b a"), (None, "a")], "a string, b string")
    assert [r[0] for r in rows.select(sim.similarity("tsort")("a", "b")).collect()] == [None, None, 1.0, None]
