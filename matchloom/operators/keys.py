"""Blocking keys: a record becomes rows (channel, key), channel by channel, as array expressions.

Token lists arrive in priority order.  The country is a column of its own, so no text can run into it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import MIN_EXACT_ADDRESS, tokens
from matchloom.schema import BITS, CHANNELS, EXTRA_CHANNELS


def _one(when: Column, key: Column) -> Column:
    return F.when(when, F.array(key)).otherwise(F.array().cast("array<string>"))


def _front(column: str, n: int) -> Column:
    return F.slice(F.col(column), 1, n)


def _cross(left: Column, right: Column, make: Callable[[Column, Column], Column]) -> Column:
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: make(x, y))))


def _pairs(column: str, n: int) -> Column:
    """Unordered pairs of the first n tokens, each in alphabetical order, whatever the priority order."""
    front = _front(column, n)
    both = F.flatten(F.transform(front, lambda x: F.transform(F.filter(front, lambda y: y > x), lambda y: F.concat(x, F.lit("|"), y))))
    return F.array_sort(both)


def _bar(*parts) -> Column:
    return F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def channel_keys(channel: str) -> Column:
    """The array of keys of one channel of a prepared record."""
    nf, af = F.col("nf"), F.col("af")
    if channel == "name_exact":
        return _one(nf != "", nf)
    if channel == "name_sorted":
        return _one((nf != "") & (F.size("ntok") > 0), F.array_join(F.array_sort("ntok"), " "))
    if channel == "name_token":
        return _front("ntok", 6)
    if channel == "name_pair":
        return _pairs("ntok", 4)
    if channel == "addr_token":
        return F.transform(_front("atok", 6), lambda t: _bar("a", t))
    if channel == "num_token":
        return _cross(_front("key_nums", 2), _front("atok", 3), lambda n, t: _bar(n, t))
    if channel == "num_set":
        return _one(F.size("key_nums") > 0, _bar("#", F.array_join("key_nums", "-")))
    if channel == "name_num":
        return _cross(_front("ntok", 3), _front("key_nums", 2), lambda t, n: _bar(t, n))
    if channel == "name_glued":
        return _one(F.col("glued") != "", _bar("g", F.col("glued")))
    if channel == "addr_exact":
        return _one(F.length(af) >= MIN_EXACT_ADDRESS, _bar("x", af))
    if channel == "addr_pair":
        return F.transform(_pairs("atok", 3), lambda t: _bar("ap", t))
    if channel == "addr_nonum":
        plain = F.array_join(F.array_sort(F.array_distinct(F.filter(tokens(af), lambda t: ~t.rlike(r"\p{Nd}")))), " ")
        return _one(F.length(plain) >= 10, _bar("an", plain))
    if channel == "num_trunc":
        # Numbers that share two digits give the same key twice; blocks count it twice.
        long = F.slice(F.array_sort(F.filter("key_nums", lambda n: F.length(n) >= 3)), 1, 3)
        found = F.transform(long, lambda n: _bar("nt", F.substring(n, 1, 2), F.element_at("atok", 1)))
        return F.when(F.size("atok") > 0, found).otherwise(F.array().cast("array<string>"))
    raise ValueError(f"unknown channel {channel}")


def key_array(channels: tuple[str, ...] = CHANNELS) -> Column:
    """All keys of a record as structs (channel, key); repeated ones stay repeated."""
    def tagged(channel: str) -> Column:
        return F.transform(channel_keys(channel), lambda k: F.struct(F.lit(channel).alias("channel"), k.alias("key")))

    return F.flatten(F.array(*map(tagged, channels)))


def keys(records: DataFrame, channels: tuple[str, ...] = CHANNELS, carry: tuple[str, ...] = ("code",)) -> DataFrame:
    """(carried columns, country, channel, key): one row a key; repeated keys of a record stay repeated."""
    return records.select(*carry, "country", F.explode(key_array(channels)).alias("k")).select(*carry, "country", F.col("k.channel").alias("channel"), F.col("k.key").alias("key"))


def short(key: Column) -> Column:
    """A key of more than 64 characters as its digest, longer than any key that stays; equal ones stay equal."""
    return F.when(F.length(key) > 64, F.concat(F.lit("~"), F.sha2(key, 256))).otherwise(key)


def channel_bit(channel: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for c, b in BITS.items() for x in (c, b))), channel)


ALL_CHANNELS = CHANNELS + EXTRA_CHANNELS
