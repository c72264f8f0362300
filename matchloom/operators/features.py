"""Pair features: 70 columns in a fixed order, NULL meaning unknown.

They are worked out in cells (``paired``); ``token_overlap``, ``number_evidence`` and ``joined_numbers`` are the same as
column expressions, for pairs that are rows already.  Neither country nor any id is a feature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import address_tokens
from matchloom.operators import paired
from matchloom.operators.stats import token_counts
from matchloom.schema import CHANNELS, IDF_REF

# Fixed order of the columns.
NAMES = ("name_ratio", "name_jw", "name_tsort", "name_tset", "ns_ratio", "ns_tset", "name_equal", "glued_equal", "name_len_a", "name_len_t", "name_len_ratio")
NAME_TOKENS = ("name_jacc", "name_wov", "name_wshared_max", "name_wmiss_a", "name_wmiss_t")
ADDRESSES = ("addr_ratio", "addr_tsort", "addr_tset", "addr_jacc", "addr_wov", "addr_wshared_max", "addr_empty_a", "addr_empty_t", "addr_len_ratio")
NUMBERS = ("num_n_a", "num_n_t", "num_shared", "num_jacc", "num_first_equal", "num_conflict", "num_min_reldiff", "postal_equal", "postal_conflict", "numj_jacc", "numj_first_equal", "num_prefix")
SCRIPT = ("indic_a", "indic_t")
RETRIEVAL = ("ret_score", "ret_rank", "is_s3", "n_channels", *(f"ch_{c}" for c in CHANNELS))
COUNTS = ("t_name_cnt", "t_addr_cnt", "a_name_cnt", "a_addr_cnt")
CONTEXT = ("n_cands", "ret_score_gap", "name_tset_gap", "addr_tset_gap", "name_tset_lead", "addr_tset_lead", "combo_rank", "avail_mean", "avail_rank", "avail_gap", "name_rank_avail", "addr_rank_avail", "n_strong_rivals")
FEATURES = (*NAMES, *NAME_TOKENS, *ADDRESSES, *NUMBERS, *SCRIPT, *RETRIEVAL, *COUNTS, *CONTEXT)
CHEAP = (
    *RETRIEVAL, "c_name_ratio", "c_name_jw", "c_name_tset", "c_ns_tset", "c_addr_ratio", "c_addr_tset", "c_glued_eq",
    "c_name_best", "c_addr_best", "c_name_gap", "c_addr_gap", "c_combo_gap", *COUNTS,
)


def token_overlap(a: Column, t: Column) -> Column:
    """(jacc, wov, wshared_max, wmiss_a, wmiss_t) of two arrays of structs (token, w); NULL if either is empty.

    A shared token weighs the larger of its two weights.
    """
    words = lambda x: F.transform(x, lambda i: i["token"])
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, i: s + i["w"])
    both = F.filter(a, lambda i: F.array_contains(words(t), i["token"]))
    twin = F.filter(t, lambda i: F.array_contains(words(a), i["token"]))
    only_a = F.filter(a, lambda i: ~F.array_contains(words(t), i["token"]))
    only_t = F.filter(t, lambda i: ~F.array_contains(words(a), i["token"]))
    by_token = lambda x: F.array_sort(F.transform(x, lambda i: F.struct(i["token"].alias("token"), i["w"].alias("w"))))
    shared = F.zip_with(by_token(both), by_token(twin), lambda x, y: F.greatest(x["w"], y["w"]))
    w_shared = F.aggregate(shared, F.lit(0.0), lambda s, w: s + w)
    w_union = w_shared + total(only_a) + total(only_t)
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    found = F.struct(
        (F.size(both) / (F.size(both) + F.size(only_a) + F.size(only_t))).alias("jacc"),
        share(w_shared, w_union).alias("wov"),
        (F.coalesce(F.array_max(shared), F.lit(0.0)) / math.log(IDF_REF)).alias("wshared_max"),
        share(total(only_a), total(a)).alias("wmiss_a"),
        share(total(only_t), total(t)).alias("wmiss_t"),
    )
    return F.when((F.size(a) > 0) & (F.size(t) > 0), found)


def token_weights(records: DataFrame, freq: DataFrame, key: str, tokens: str, field: str) -> DataFrame:
    """(key, weights): each record's tokens with ln(1e7 / frequency) in the scope of its country."""
    found = token_counts(records, freq, key, tokens, field)
    return found.select(key, F.transform("items", lambda x: F.struct(x["token"].alias("token"), (F.lit(math.log(IDF_REF)) - F.log(x["df"])).alias("w"))).alias("weights"))


def _exists_pair(a: Column, t: Column, test) -> Column:
    return F.exists(F.slice(a, 1, 4), lambda p: F.exists(F.slice(t, 1, 4), lambda q: test(p, q)))


def number_evidence(a: str = "nums_a", t: str = "nums_t", pa: str = "postal_a", pt: str = "postal_t") -> dict[str, Column]:
    """Counts, overlap, first number, conflict, closest relative gap, postal codes, and numbers cut by a digit."""
    x, y = F.col(a), F.col(t)
    both = (F.size(x) > 0) & (F.size(y) > 0)
    shared = F.size(F.array_intersect(x, y))
    gap = lambda p, q: F.when(F.greatest(p, q) == 0, F.lit(0.0)).otherwise(F.abs(p - q) / F.greatest(p, q))
    gaps = F.flatten(F.transform(F.slice(x, 1, 4), lambda p: F.transform(F.slice(y, 1, 4), lambda q: gap(p.cast("double"), q.cast("double")))))
    cut = lambda p, q: (F.length(p) >= 2) & (F.length(q) >= 2) & (F.abs(F.length(p) - F.length(q)) == 1) & (F.startswith(p, q) | F.startswith(q, p))
    codes = (F.size(pa) > 0) & (F.size(pt) > 0)
    return {
        "num_n_a": F.size(x).cast("double"),
        "num_n_t": F.size(y).cast("double"),
        "num_shared": F.when(both, shared.cast("double")),
        "num_jacc": F.when(both, shared / F.size(F.array_union(x, y))),
        "num_first_equal": F.when(both, (F.get(x, F.lit(0)) == F.get(y, F.lit(0))).cast("double")),
        "num_conflict": F.when(both, (shared == 0).cast("double")),
        "num_min_reldiff": F.when(both, F.least(F.lit(1.0), F.array_min(gaps))),
        "num_prefix": F.when(both, _exists_pair(x, y, cut).cast("double")),
        "postal_equal": F.when(codes, F.arrays_overlap(pa, pt).cast("double")),
        "postal_conflict": F.when(codes, (~F.arrays_overlap(pa, pt)).cast("double")),
    }


def joined_numbers(a: str = "nums_j_a", t: str = "nums_j_t") -> dict[str, Column]:
    x, y = F.col(a), F.col(t)
    both = (F.size(x) > 0) & (F.size(y) > 0)
    return {
        "numj_jacc": F.when(both, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))),
        "numj_first_equal": F.when(both, (F.get(x, F.lit(0)) == F.get(y, F.lit(0))).cast("double")),
    }


TEXTS = ("name", "name_ns", "glued", "addr", "nums", "nums_j", "postal", "indic")


WEIGHTS = ("nw", "aw")


def weighted(records: DataFrame, freq: DataFrame, key: str) -> DataFrame:
    """Adds nw and aw, the weights of name and address tokens; [] without any.

    Tokens of pairs come from the expanded address, tokens of keys from the folded one.
    """
    words, out = records.withColumn("words", address_tokens(F.col("addr"))), records
    for column, tokens, field in zip(WEIGHTS, ("ntok", "words"), ("n", "a")):
        found = token_weights(words, freq, key, tokens, field).select(key, F.col("weights").alias(column))
        out = out.join(found, key, "left").withColumn(column, F.coalesce(column, _no_weights()))
    return out


def features(pairs: DataFrame, anchors: DataFrame, targets: DataFrame, freq: DataFrame) -> DataFrame:
    """anchor, code, source and the 70 columns, from held candidates with pool counts and prepared records.

    anchors: prepared records with ``anchor``; targets: with ``code``; the counts may be theirs (``blocking.counted``)
    instead of the pairs'.  All candidates of an anchor must be there.  Token weights are looked up once a record; both
    sides use the anchor's country, which equals the target's, since keys are scoped by country.
    """
    anchors, targets = weighted(anchors, freq, "anchor"), weighted(targets, freq, "code")
    return paired.worked_out(pairs, anchors, targets, TEXTS + WEIGHTS, FEATURES, True)


def _no_weights() -> Column:
    return F.array().cast("array<struct<token:string,w:double>>")


def cheap_features(pairs: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """anchor, code, source and the 30 columns of a first ranking over wide lists; see ``features``."""
    return paired.worked_out(pairs, anchors, targets, TEXTS[:4], CHEAP, False)
