import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import bpe, token_files
from tests.llm.data import awkward, documents


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def texts(n=1500, seed=3):
    rng = random.Random(seed)
    pool = [chr(c) for c in [*range(0, 0x250), *range(0x370, 0x400), *range(0x900, 0x950), *range(0x2000, 0x2070), 0x130, 0x1E9E, 0xFB01, 0x212B, 0x301, 0x308, 0x1F600, 0x4E2D, 0xAC00, 0x11A8, 0x85, 0xA0, 0x3000, 0xFEFF]]
    parts = ["a", "the", "'s", "'re", "<|endoftext|>", "<|startoftext|>", "<|", " ", "23", "!!", "ing", "ΑΣ", "'", "e"]
    out = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(n)] + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)]
    return ["", " \n", "word " * 5000, "x" * 3000, *out]


def test_automaton_equals_library(library):
    given = [*texts(), None]
    held = bpe.Encoder(bpe.tokenizer(bpe.default_path()))
    for most in (100, 2000, 1 << 20):
        found = list(held.digests(pa.array(given), most))
        for x, (n, numbers, labels, ids) in zip(given, found, strict=True):
            want = library.encode(x or "", add_special_tokens=False).ids
            assert np.concatenate(ids).tolist() == want and n == len(want), x
            assert numbers == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert labels == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_long_words(library):
    """Words beyond the batch walk, in windows of labels, and a word of megabytes in time linear in it."""
    rng = random.Random(4)
    automaton = bpe.tokenizer(bpe.default_path()).automaton
    for n in (513, 2000, 70_001):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz" if n < 70_000 else "aeinrst") for _ in range(n))
        want = library.encode(word, add_special_tokens=False).ids
        assert automaton.long_word(word.encode()).tolist() == want and automaton.long_word(word.encode(), 50).tolist() == want
        sizes, ids = automaton.words([b"the", word.encode(), b"of", b"of", word.encode() * 2])
        assert sizes[1] == len(want) and ids[1 : 1 + len(want)].tolist() == want
    began = time.process_time()
    automaton.long_word(b"abracadabra" * 20_000)
    small = time.process_time() - began
    began = time.process_time()
    automaton.long_word(b"abracadabra" * 160_000)
    assert time.process_time() - began < 24 * small + 1


def test_automaton_of_random_merges():
    """Against plain BPE: the leftmost of the earliest merges first, until none applies."""
    rng = random.Random(8)
    for _ in range(15):
        tokens, merges = ["a", "b", "c", "a</w>", "b</w>", "c</w>"], []
        while len(merges) < 25:
            x, y = rng.choice([t for t in tokens if not t.endswith("</w>")]), rng.choice(tokens)
            if x + y not in tokens and len(x + y) < 16:
                merges.append((x, y))
                tokens.append(x + y)
        vocab = {t: i for i, t in enumerate(tokens)}
        automaton = bpe.Automaton(vocab, merges, "</w>")
        for _ in range(150):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            parts = [*word[:-1], word[-1] + "</w>"]
            while True:
                ranks = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
                if not ranks:
                    break
                x, y = merges[min(ranks)[0]]
                i, out = 0, []
                while i < len(parts):
                    if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (x, y):
                        out.append(x + y)
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            for found in (automaton.words([word.encode()])[1], automaton.long_word(word.encode(), 2)):
                assert [automaton.label[t] for t in found.tolist()] == parts, (word, merges)


def test_digests_and_ids(spark, library):
    rows = [(r[0], r[1]) for r in awkward() if r[0] != 50]
    docs = documents(spark, rows, clash=True)
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    lists = {r["doc_id"]: r for r in bpe.encoded(docs).collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(docs)).collect()}
    for i, x in rows:
        ids = library.encode(x or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want
        assert lists[i]["ids"] == ids and (lists[i]["n_tokens"], lists[i]["ids_sha256"], lists[i]["decoded_sha256"]) == want and back[i] == text
    assert bpe.digests(documents(spark, [])).count() == 0


def test_encoder_equals_library(library):
    given = [None, *texts()]
    for most in (2000, 1 << 20):
        for k, j, ids, ends in token_files.encode_texts(pa.array(given), bpe.default_path(), most):
            parts = np.split(ids, ends[:-1])
            assert ends[-1] == len(ids)
            for x, p in zip(given[k:j], parts):
                assert p.tolist() == library.encode(x or "", add_special_tokens=False).ids + [token_files.END], x


def test_files(spark, tmp_path, library):
    rows = [(r[0], r[1]) for r in awkward()]
    out = str(tmp_path / "tokens")
    token_files.write_tokens(documents(spark, rows, clash=True), out)
    want, start = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_files.index(spark, out).collect()), key=lambda r: r[1])
    assert got == want
    some = {r["doc_id"]: r["ids"] for r in token_files.read_tokens(spark, out, [4, 6]).collect()}
    assert set(some) == {4, 6} and len(some[4]) == dict((w[0], w[2]) for w in want)[4]
    assert token_files.token_index(documents(spark, [])).count() == 0
    import glob

    import pyarrow.parquet as pq

    meta = pq.ParquetFile(max(glob.glob(f"{out}/*.parquet"))).metadata.row_group(0)
    assert all(meta.column(i).has_column_index and "DELTA_BINARY_PACKED" in meta.column(i).encodings for i in range(meta.num_columns))


def test_ranges_read_no_text(spark, tmp_path):
    """The bounds of the files come from the ids alone; order, NULL ids and repeated ids stay."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).select((F.col("id") * 37 % 1000).alias("doc_id"), F.col("id").cast("string").alias("text")).unionByName(spark.createDataFrame([(None, "x")] * 5, "doc_id bigint, text string"))
    boom = rows.withColumn("text", F.when(F.lit(True), F.raise_error(F.lit("text read")).cast("string")))
    token_files.ranged(boom, 7)  # planning asks for the bounds
    parts = token_files.ranged(rows, 7).select(F.spark_partition_id().alias("p"), "doc_id", "text").collect()
    ranges = {}
    for p, i, _ in parts:
        ranges.setdefault(p, []).append(-1 if i is None else i)
    order = [(min(v), max(v)) for _, v in sorted(ranges.items())]
    assert len(parts) == 3005 and len(order) == 7 and all(x[1] < y[0] for x, y in zip(order, order[1:]))
    assert max(map(len, ranges.values())) < 600
    for n in (1, 3):
        assert token_files.ranged(rows.filter("doc_id is null"), n).count() == 5 and token_files.ranged(rows.limit(0), n).count() == 0
