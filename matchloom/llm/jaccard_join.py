"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document's set is its distinct five-word shingles as 64-bit hashes.  Two sets link when their Jaccard
similarity is at least ``threshold`` (in per cent).  Equal sets form a class, represented by its smallest id, so
copies cost one signature set a task, not one a document.

Signatures.  Set sizes fall into bands [L, R] with R = L / threshold, so linked sets lie in one band or in
neighbouring ones; a set signs for its own band and for the next.  In the family of band [L, R] linked sets differ
in at most k = 2 R (1 - t) / (1 + t) elements.  The hash domain is cut into n1 equal first-level parts, so one of
them holds k2 = k // n1 differences at most; each is cut into n2 = k2 + s + m second-level parts, of which s + m
agree there, and a signature is a subset of s of these (first-level part, subset, and the elements in it).  Empty
parts would make all sets alike: where a set has m empty ones or fewer in a first-level part, its subsets leave them
out, since s of the s + m agreeing parts are not empty; where it has more, subsets take them too, and two such sets
meet there.  So every linked pair shares a signature.  ``choose`` fixes (n1, s) for a band by measured costs.

Candidates.  Signatures are dealt by family and part; sets that share one form a group, and equal groups count
once.  Pairs of a group must pass a parity sketch (one bit for the parity of the elements that hash to it; two
sketches differ in no more bits than the sets differ in elements, so it drops no link).  Small groups try all
pairs.  Large groups first try a few leaders; links found contract them, and only pairs of sets not yet in one
component are tried after that, in blocks over many tasks.  Surviving pairs are checked exactly on whole sets.

Defined results: a text with fewer than five words has its word sequence as one shingle; without words or text a
set is empty and links with nothing; rows with a NULL id link with nothing and have a NULL component; rows of one
id get the component of their own text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import GOLD, WordHashes, as_bytes, materialise, mix64, scratch_dir, shingle_hashes, tidy
from matchloom.llm.graph import components

WIDTH, THRESHOLD, BITS = 5, 80, 4
#: BITS of a sketch for two elements, at least.
#: Signatures that are dealt together; signatures in a dealt unit, about; groups that try all pairs (larger ones go by
#: leaders and blocks, exact either way); leaders; members in a block; classes that a task remembers; pairs of a hub
#: that one task verifies; bytes of a text for a shingle, to foresee set sizes.
PARTS, UNIT, SMALL, LEADERS, BLOCK, SEEN, HUB, BYTES = 8, 1_000_000, 48, 1, 2048, 200_000, 2000, 6.5
#: Bands of sets that differ in PAIRED elements at most enumerate subsets of two parts, others single parts.
PAIRED = 6


def choose(k: int) -> tuple[int, int]:
    """(n1, s) of a band whose linked sets differ in ``k`` elements at most.

    Measured on whole tables (README): subsets of two parts pay where parts are few, since single parts of small
    sets hold one or two elements; a second level makes more signatures than it saves candidates.
    """
    return 1, 2 if k <= PAIRED else 1


@cache
def bands(threshold: int = THRESHOLD, most: int = 1 << 40) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """First size of each band, and (n1, n2, s, m) of its family; all 0 where only equal sets link."""
    first, families, low, before = [], [], 1, 1
    while low < most:
        high = max(low, low * 100 // threshold)
        k = 2 * high * (100 - threshold) // (100 + threshold)
        n1, s = choose(k) if k else (0, 0)
        m = n2 = 0
        while k:
            n2 = k // n1 + s + m
            empty = n2 * np.exp(-before / (n1 * n2))  # expected empty parts of the smallest set that signs here
            if m >= empty + 2.5 * empty**0.5 or n2 >= 4 * (k // n1 + s):
                break
            m += max(1, m // 64)
        families.append((n1, n2, s, m))
        first.append(low)
        before, low = low, high + 1
    return np.array(first, np.int64), families


@cache
def subsets(n: int, s: int) -> np.ndarray:
    return np.array(list(combinations(range(n), s)), np.int64)


def signatures(elements: np.ndarray, threshold: int = THRESHOLD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(family, signature numbers, signatures) of a sorted set, for its own band and the next."""
    first, families = bands(threshold)
    own = int(np.searchsorted(first, len(elements), "right")) - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(elements)])
    high = elements >> np.uint64(32)
    for f in (own, own + 1):
        n1, n2, s, m = families[f]
        if not n1:
            continue  # sets of this size link only if they are equal
        n = n1 * n2
        edge = np.searchsorted(high * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
        full = (edge[1:] > edge[:-1]).reshape(n1, n2)
        taken = full | (n2 - full.sum(axis=1, keepdims=True) > m)
        value = mix64((total[edge[1:]] - total[edge[:-1]]) ^ mix64(np.arange(1, n + 1, dtype=np.uint64)))
        if s == 1:
            at = np.flatnonzero(taken)
            yield f, at, value[at]
        else:
            sets, value = subsets(n2, s), value.reshape(n1, n2)
            at = np.flatnonzero(taken[:, sets].all(axis=2))
            mixed = value[:, sets[:, 0]]
            for i in range(1, s):
                mixed = mix64(mixed + GOLD) ^ value[:, sets[:, i]]
            yield f, at, mix64(mixed.ravel()[at])


def unit_counts(docs: DataFrame, threshold: int) -> np.ndarray:
    """For each family, over how many units a dealt bucket's signatures are spread, from the lengths of all texts."""
    first, families = bands(threshold)
    # One row for each quarter more of length: some hundred at most.
    step = F.floor(F.log(F.greatest(F.octet_length("text"), F.lit(1))) / float(np.log(1.25)))
    found = docs.groupBy(step.alias("step")).agg(F.count("*").alias("n")).filter("step is not null").collect()
    total = np.zeros(len(families) + 1)
    for r in found:
        f = int(np.searchsorted(first, max(1, 1.25 ** (r["step"] + 0.5) / BYTES), "right")) - 1
        total[f : f + 2] += r["n"]
    made = [n1 * comb(n2, s) for n1, n2, s, _ in families] + [0]
    return np.array([max(1, round(n * min(x, PARTS) / UNIT)) for n, x in zip(total, made)], np.int64)


def sketch(elements: np.ndarray, per_two: int) -> bytes:
    """Parities of the elements' low bits, on a power of two of bits, ``per_two`` for two elements or more."""
    bits = 1 << max(6, (per_two * len(elements) // 2 - 1).bit_length())
    low = (elements & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(low, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the length of the shortest."""
    size = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), size), np.uint64)
    for i, x in enumerate(sketches):
        words = np.frombuffer(x, "<u8")
        out[i] = np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)
    return out


def may_link(na, nb, xa: np.ndarray, xb: np.ndarray, threshold: int) -> np.ndarray:
    """False only for pairs that cannot link: their sketches differ in more bits than the sizes allow."""
    apart = np.bitwise_count(xa ^ xb).sum(axis=-1, dtype=np.int64)
    apart = np.maximum(apart, np.abs(na - nb))
    return 100 * (na + nb - apart) >= threshold * (na + nb + apart)


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def shingle_set(words: WordHashes, text: bytes, width: int = WIDTH) -> np.ndarray:
    return shingle_hashes(words.of(text.lower().split()), width)


def class_of(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


SIGNED = "bucket bigint, blob binary, doc_id bigint, digest bigint, n bigint, class binary, sketch binary"
GROUPED = "gid bigint, size bigint, doc_id bigint, digest bigint, n bigint, class binary, sketch binary"


def _record(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], [n for n, _ in schema])


_T = {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(text: str) -> list[tuple[str, pa.DataType]]:
    return [(x.split()[0], _T[x.split()[1]]) for x in text.split(", ")]


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sign(docs: DataFrame, width: int, threshold: int, units: np.ndarray) -> DataFrame:
    """A row for each document (its set's size, class and sketch), and packed signatures by family and part.

    A blob holds, for the classes of a batch that sign in the bucket: their number, their digests, how many
    signatures each has (``PARTS`` at most), and their low 32 bits: in one unit, those of unlike signatures are
    seldom equal, and then make a candidate that the sketches drop.  ``units`` splits the buckets of a family by the signature.
    """
    schema = _schema(SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, turn = WordHashes(200_000), set(), 0
        rows: list[tuple] = []
        keys, sums, owners, classes, held = [], [], [], [], 0

        def packed() -> Iterator[tuple]:
            nonlocal held
            if not keys:
                classes.clear()
                return
            key, value, owner = np.concatenate(keys), np.concatenate(sums), np.concatenate(owners)
            spread = units[key >> 32]
            key = (key << 20) + (value >> np.uint64(40)).astype(np.int64) % spread
            order = np.argsort(key, kind="stable")
            key, value, owner = key[order], value[order], owner[order]
            digests = np.frombuffer(b"".join(classes), "V16")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own, count = np.unique(owner[a:b], return_counts=True)  # owners are in order inside a bucket
                yield int(key[a]), np.array([len(own)], "<u4").tobytes() + digests[own].tobytes() + count.astype("<u1").tobytes() + value[a:b].astype("<u4").tobytes(), None, None, None, None, None
            for x in (keys, sums, owners, classes):
                x.clear()
            held = 0

        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                words.trim()
                for doc_id, digest, text in zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist(), as_bytes(b.column("text"))):
                    elements = shingle_set(words, text, width)
                    turn += 1
                    c = class_of(elements) if len(elements) and doc_id is not None else None
                    if c is None or c in seen:
                        rows.append((-1 - turn % 4096, None, doc_id, digest, len(elements), c, None))
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    rows.append((-1 - turn % 4096, None, doc_id, digest, len(elements), c, sketch(elements, BITS)))
                    for f, at, values in signatures(elements, threshold):
                        keys.append((f << 32) + at // PARTS)
                        sums.append(values)
                        owners.append(np.full(len(values), len(classes), np.int32))
                        held += len(values)
                    classes.append(c)
                    if held >= 500_000:
                        rows += packed()
                        yield _record(schema, rows)
                        rows.clear()
        rows += packed()
        yield _record(schema, rows)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest"), "text").mapInArrow(tidy(run), SIGNED)


def group(signed: DataFrame) -> DataFrame:
    """Document rows as they are, and (gid, size, class) for the members of each group of two classes or more.

    ``gid`` is a digest of the members, so groups with the same members have the same rows.
    """
    schema = _schema(GROUPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []

        def groups() -> Iterator[tuple]:
            digests, owner, values, ahead = [], [], [], 0
            for x in blobs:
                n = int(np.frombuffer(x, "<u4", 1)[0])
                digests.append(np.frombuffer(x, "V16", n, 4))
                counts = np.frombuffer(x, "<u1", n, 4 + 16 * n).astype(np.int64)
                owner.append(np.repeat(np.arange(ahead, ahead + n), counts))
                values.append(np.frombuffer(x, "<u4", int(counts.sum()), 4 + 17 * n))
                ahead += n
            blobs.clear()
            names = np.concatenate(digests)
            pairs = names.view([("a", "<u8"), ("b", "<u8")])
            # classes that several tasks signed become one
            order = np.lexsort((pairs["b"], pairs["a"]))
            fresh = np.concatenate([[True], (np.diff(pairs["a"][order]) != 0) | (np.diff(pairs["b"][order]) != 0)])
            one = np.empty(len(names), np.int64)
            one[order] = np.cumsum(fresh) - 1
            names = names[order][fresh]
            value, who = np.concatenate(values), one[np.concatenate(owner)]
            order = np.argsort(value, kind="stable")
            value, who = value[order], who[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(value)) + 1, [len(value)]])
            long = np.flatnonzero(np.diff(cuts) > 1)
            known: set[int] = set()
            for a, b in zip(cuts[long].tolist(), cuts[long + 1].tolist()):
                members = np.unique(who[a:b])
                if len(members) > 1:
                    found = names[members].tobytes()
                    gid = xxhash.xxh64_intdigest(found) - (1 << 63)
                    if gid not in known:
                        known.add(gid)
                        for k in range(len(members)):
                            yield gid, len(members), None, None, None, found[16 * k : 16 * k + 16], None

        rows: list[tuple] = []
        for b in batches:
            blob, key = b.column("blob").to_pylist(), b.column("bucket").to_pylist()
            for i, x in enumerate(blob):
                if x is None:
                    continue
                if key[i] != bucket and blobs:
                    for row in groups():
                        rows.append(row)
                        if len(rows) == 100_000:
                            yield _record(schema, rows)
                            rows.clear()
                bucket = key[i]
                blobs.append(x)
            plain = pa.array([i for i, x in enumerate(blob) if x is None], pa.int64())
            kept = b.take(plain)
            none = pa.nulls(len(plain), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, kept.column("doc_id"), kept.column("digest"), kept.column("n"), kept.column("class"), kept.column("sketch")], [n for n, _ in schema])
        if blobs:
            rows += groups()
        yield _record(schema, rows)

    return signed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), GROUPED)


PAIRS = "a binary, b binary, ra bigint, rb bigint"


def _pair(c1, r1, c2, r2) -> tuple:
    return (c1, c2, r1, r2) if c1 < c2 else (c2, c1, r2, r1)


def small_group_pairs(members: DataFrame, threshold: int) -> DataFrame:
    """All pairs of each small group that may link."""
    schema = _schema(PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, held = None, []

        def pairs() -> Iterator[tuple]:
            x, n = folded([h[3] for h in held]), np.array([h[2] for h in held], np.int64)
            i, j = np.triu_indices(len(held), 1)
            for k in np.flatnonzero(may_link(n[i], n[j], x[i], x[j], threshold)):
                p, q = held[i[k]], held[j[k]]
                yield _pair(p[0], p[1], q[0], q[1])

        for b in batches:
            found: set[tuple] = set()
            for g, *row in zip(*(b.column(c).to_pylist() for c in ("gid", "class", "no", "n", "sketch"))):
                if g != gid:
                    if len(held) > 1:
                        found.update(pairs())
                    gid, held = g, []
                held.append(row)
            yield _record(schema, list(found))
        yield _record(schema, list(pairs()) if len(held) > 1 else [])

    return members.repartition("gid").sortWithinPartitions("gid").mapInArrow(tidy(run), PAIRS)


def leader_pairs(members: DataFrame, path: str, threshold: int, leaders: int = LEADERS) -> DataFrame:
    """Pairs of a few members of each large group with all its members, as far as they may link."""
    whole = F.struct("class", "no", "n", "sketch")
    # one row a group and leader, found map-side first
    chosen = members.groupBy("gid").agg(*(F.min(F.struct(F.xxhash64("class", "gid", F.lit(i)).alias("h"), whole.alias("who"))).alias(f"l{i}") for i in range(leaders)))
    chosen = materialise(chosen.select("gid", F.explode(F.array_distinct(F.array(*(F.col(f"l{i}")["who"] for i in range(leaders))))).alias("leader")), f"{path}/leaders")
    joined = members.join(chosen, "gid").select("class", "no", "n", "sketch", F.col("leader.class").alias("c2"), F.col("leader.no").alias("r2"), F.col("leader.n").alias("n2"), F.col("leader.sketch").alias("s2"))
    schema = _schema(PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple] = set()
            for c1, r1, n1, s1, c2, r2, n2, s2 in zip(*(x.to_pylist() for x in b.columns)):
                if c1 != c2:
                    x = folded([s1, s2])
                    if may_link(n1, n2, x[0], x[1], threshold):
                        found.add(_pair(c1, r1, c2, r2))
            yield _record(schema, list(found))

    return joined.filter("class <> c2 and 100 * least(n, n2) >= {0} * greatest(n, n2)".format(threshold)).mapInArrow(tidy(run), PAIRS)


def open_pairs(members: DataFrame, labels: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """Pairs of large groups that may link and whose sets are in different components so far.

    A group's members fall into blocks; each pair of blocks is a unit of work, so a task holds two blocks at most.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("bigint")
    rows = members.join(labels, F.col("no") == F.col("node"), "left").withColumn("label", F.coalesce("label", "no"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("class"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    rows = rows.select("gid", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "at", "class", "no", "n", "sketch", "label")
    schema = _schema(PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def pairs() -> Iterator[tuple]:
            x, n, label = folded([h[4] for h in held]), np.array([h[3] for h in held], np.int64), np.array([h[5] for h in held], np.int64)
            at = np.array([h[0] for h in held], np.int64)
            inside = unit[1] == unit[2]
            for i in range(len(held)):
                j = np.arange(i + 1, len(held))
                j = j[(label[j] != label[i]) & (inside | (at[j] != at[i]))]
                for k in j[may_link(n[i], n[j], x[i], x[j], threshold)].tolist() if len(j) else ():
                    yield _pair(held[i][1], held[i][2], held[k][1], held[k][2])

        found: set[tuple] = set()
        for b in batches:
            for g, lo, hi, *row in zip(*(b.column(c).to_pylist() for c in ("gid", "lo", "hi", "at", "class", "no", "n", "sketch", "label"))):
                if (g, lo, hi) != unit:
                    if len(held) > 1:
                        for p in pairs():
                            found.add(p)
                            if len(found) >= 200_000:
                                yield _record(schema, list(found))
                                found.clear()
                    unit, held = (g, lo, hi), []
                held.append(row)
        if len(held) > 1:
            found.update(pairs())
        yield _record(schema, list(found))

    return rows.repartition("gid", "lo", "hi").sortWithinPartitions("gid", "lo", "hi").mapInArrow(tidy(run), PAIRS)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, path: str, width: int, threshold: int, hub: int = HUB) -> DataFrame:
    """(u, v): numbers of the classes that link, checked on whole sets.

    The sets of the classes concerned are made again from a text of each; each goes once to every class ``a`` that
    it is paired with.  The partners of a class with more than ``hub`` of them are split over several tasks.
    """
    wanted = pairs.select(F.col("ra").alias("no")).unionByName(pairs.select(F.col("rb").alias("no"))).distinct()
    # Written, so that its true size decides how the texts meet it: a small one spares their shuffle.
    wanted = materialise(wanted.join(classes, "no").select(F.col("rep").alias("doc_id")).distinct(), f"{path}/wanted")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            words.trim()
            for k in range(0, b.num_rows, 500):
                sets = [shingle_set(words, x, width) for x in as_bytes(b.column("text").slice(k, 500))]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in sets], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["class", "elements"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    sets = materialise(texts.select("text").mapInArrow(tidy(make), "class binary, elements binary"), f"{path}/sets").dropDuplicates(["class"])
    per = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / hub).cast("bigint").alias("tasks")), f"{path}/hubs")
    split = per.filter("tasks > 1")
    small = F.broadcast if split.count() <= 100_000 else lambda x: x
    spread = pairs.join(small(split), "a", "left").withColumn("task", F.coalesce(F.pmod(F.xxhash64("b"), F.col("tasks")), F.lit(0)))
    firsts = per.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)).alias("task")).join(sets.withColumnRenamed("class", "a"), "a")
    firsts = firsts.select("a", "task", F.lit(False).alias("second"), F.lit(None).cast("bigint").alias("ra"), F.lit(None).cast("bigint").alias("rb"), "elements")
    seconds = spread.withColumnRenamed("b", "class").join(sets, "class").select("a", "task", F.lit(True).alias("second"), "ra", "rb", "elements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, first = None, None
        for b in batches:
            out = []
            for *key, second, ra, rb, elements in zip(*(b.column(c).to_pylist() for c in ("a", "task", "second", "ra", "rb", "elements"))):
                mine = np.frombuffer(elements, "<u8")
                if not second:
                    unit, first = key, mine
                elif key == unit and linked(first, mine, threshold):
                    out.append((ra, rb))
            yield _record([("u", pa.int64()), ("v", pa.int64())], out)

    return firsts.unionByName(seconds).repartition("a", "task").sortWithinPartitions("a", "task", "second").mapInArrow(tidy(run), "u bigint, v bigint")


def _rows(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """(doc_id, digest, n_shingles, root, component_id) of every row of ``docs``; ``root`` is NULL where nothing links.

    Classes have numbers, and ``root`` is one of each component's, so rows of one id with unlike texts stay apart;
    ``component_id`` is the smallest id of the component.
    """
    path = scratch_dir(docs.sparkSession)
    grouped = materialise(group(sign(docs, width, threshold, unit_counts(docs, threshold))), f"{path}/grouped")
    rows = grouped.filter("gid is null").select("doc_id", "digest", "n", "class", "sketch")
    classes = rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    classes = materialise(classes.withColumn("no", F.monotonically_increasing_id()), f"{path}/classes")
    members = grouped.filter("gid is not null").select("gid", "size", "class").distinct().join(classes, "class")
    members = materialise(members.select("gid", "size", "class", "no", "n", "sketch"), f"{path}/members")
    small, large = members.filter(F.col("size") <= SMALL), members.filter(F.col("size") > SMALL)
    is_open = not large.isEmpty()
    found = small_group_pairs(small, threshold)
    if is_open:
        found = found.unionByName(leader_pairs(large, path, threshold))
    pairs = materialise(found.distinct(), f"{path}/pairs")
    links = materialise(verified(pairs, classes, docs, path, width, threshold), f"{path}/links")
    labels = components(links, f"{path}/first")
    if is_open:
        labels = materialise(labels, f"{path}/labels")
        rest = materialise(open_pairs(large, labels, threshold).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti"), f"{path}/rest")
        if not rest.isEmpty():
            more = verified(rest, classes, docs, f"{path}/rest-of", width, threshold)
            labels = components(more.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))), f"{path}/second")
    labels = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())  # smallest nodes too
    labelled = materialise(labels.join(classes, F.col("node") == F.col("no")).select("class", "label", "rep"), f"{path}/labelled")
    least = labelled.groupBy("label").agg(F.min("rep").alias("component"))
    component = labelled.join(least, "label").select("class", "label", "component")
    named = classes.select("class", "no", "rep").join(component, "class", "left")
    named = materialise(named.select("class", F.coalesce("label", "no").alias("root"), F.coalesce("component", "rep").alias("component")), f"{path}/components")
    named = rows.select("doc_id", "digest", F.col("n").alias("n_shingles"), "class").join(named, "class", "left")
    return named.select("doc_id", "digest", "n_shingles", "root", F.coalesce("component", "doc_id").alias("component_id"))


def join(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    return _rows(docs, width, threshold).select("doc_id", "n_shingles", "component_id")


def without_near_copies(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each group of linked ones, that of the smallest id (then digest of the text), with the same columns.

    Rows of one id are judged by their own texts: those that link with nothing stay, of identical linked rows one
    stays.  Rows with a NULL id and rows without words stay.
    """
    path = scratch_dir(docs.sparkSession)
    found = _rows(docs, width, threshold).filter("root is not null").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("rows"))
    found = materialise(found, f"{path}/groups")
    firsts = found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    judged = found.join(firsts, "root").select(F.col("doc_id").alias("id"), "digest", "rows", (F.struct("doc_id", "digest") == F.col("first")).alias("stays"))
    judged = materialise(judged, f"{path}/judged")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("bigint").alias("id"), text_digest(F.col("text")).alias("digest"))
    kept = rows.join(judged.filter("not stays"), ["id", "digest"], "left_anti")
    again = judged.filter("stays and rows > 1").select("id", "digest")
    if not again.isEmpty():
        once = kept.join(again, ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.first("doc").alias("doc"))
        kept = kept.join(again, ["id", "digest"], "left_anti").select("doc").unionByName(once.select("doc"))
    return kept.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
