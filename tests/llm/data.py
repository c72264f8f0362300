"""Small tables with the awkward cases: NULLs, empty and long texts, repeated rows, clashing names."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASH = ["score", "kept", "dropped", "class", "label", "key", "id", "row", "n", "size", "taken", "gid", "n_lines", "rep", "bucket", "__id", "lines"]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, rows, clash=False):
    """rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", None if r[1] is None else len(r[1])) for r in rows]
    frame = spark.createDataFrame(full, DOCS)
    if clash:
        from pyspark.sql import functions as F

        frame = frame.withColumns({c: F.lit(7) for c in CLASH})
    return frame


def awkward(seed=1, copies=12):
    """(doc_id, text, source) rows."""
    rng = random.Random(seed)
    long = " ".join(words(rng, 6000, 5000))
    base = words(rng, 120)
    rows = [(1, None, None), (2, "", "b"), (3, " \n\t ", "a"), (4, "one two", "a"), (5, "One  TWO", "c"), (6, long, "a"), (7, long + " tail", "Z"), (8, "Ünïcode ñandú " * 30, "é")]
    for i in range(copies):
        changed = list(base)
        changed[rng.randrange(120)] = f"x{i}"
        rows.append((10 + i, " ".join(changed), "hot"))
    rows += [(40, "\n".join(["A repeated LINE here", "  a repeated line here\t", "short", "only in forty"]), "a"), (41, "a repeated line here\nshort\nonly in forty one", None), (42, "a repeated line here\n", "b")]
    rows += [(50, " ".join(words(rng, 80)), "b"), (50, " ".join(words(rng, 80)), "b"), (None, " ".join(base), "a")]
    return rows
