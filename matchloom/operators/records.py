"""Records and their prepared forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.schema import id_value, source_of, target_code


def with_codes(records: DataFrame) -> DataFrame:
    """Adds ``source``, ``id`` and ``code`` from ``entity_id``."""
    return records.withColumn("source", source_of(F.col("entity_id"))).withColumn("id", id_value(F.col("entity_id"))).withColumn("code", target_code(F.col("source"), F.col("id")))


def prepared(records: DataFrame) -> DataFrame:
    """The record with its text views, worked out once; every later column is a built-in expression on them.

    Adds name, name_ns, glued, addr, nums, nums_j, postal, indic (for pairs) and nf, af, ntok, atok, key_nums (for
    keys).  The address of keys is the folded one without abbreviations, and its numbers come from the raw text.
    """
    name, addr = F.col("__name"), F.col("__addr")
    return (
        records.withColumn("__name", tx.views(F.col("business_name")))
        .withColumn("__addr", tx.views(F.col("business_address")))
        .withColumn("nf", name["folded"])
        .withColumn("af", addr["folded"])
        .withColumn("name", F.col("nf"))
        .withColumn("name_ns", tx.drop_legal_suffixes(F.col("nf")))
        .withColumn("glued", tx.glued_name(F.col("nf")))
        .withColumn("addr", tx.expand_address(F.col("af"), F.col("country")))
        .withColumn("nums", tx.canonical_numbers(F.col("af")))
        .withColumn("nums_j", tx.canonical_numbers(tx.join_hyphens(addr["translit"])))
        .withColumn("postal", tx.postal_codes(F.col("af")))
        .withColumn("indic", name["indic"] | addr["indic"])
        .withColumn("ntok", tx.name_tokens(F.col("nf")))
        .withColumn("atok", tx.address_tokens(F.col("af")))
        .withColumn("key_nums", tx.blocking_numbers(F.coalesce("business_address", F.lit(""))))
        .drop("__name", "__addr")
    )


def ascii_folded(text: Column) -> Column:
    """The folded view of ASCII texts in built-in expressions."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_]+", " "))
