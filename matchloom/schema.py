"""Schemas, id codes and constants of record linkage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("entity_id", "business_name", "business_address", "country")
RECORDS = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
TRUTH = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("matched_entity_ids", T.StringType())])

# Fixed values.
SOURCE_BASE = 2_000_000_000
IDF_REF = 10_000_000.0
MAX_ID = 2_000_000_000
CHANNELS = ("name_exact", "name_sorted", "name_token", "name_pair", "addr_token", "num_token", "num_set", "name_num", "name_glued", "addr_exact")
EXTRA_CHANNELS = ("addr_pair", "addr_nonum", "num_trunc")
COUNT_CHANNELS = ("name_exact", "addr_exact")

BITS = {c: 1 << i for i, c in enumerate(CHANNELS + EXTRA_CHANNELS)}
BASE_MASK = (1 << len(CHANNELS)) - 1


def source_of(entity_id: Column) -> Column:
    """1, 2 or 3 from the prefix of an id; any other prefix is an error when evaluated."""
    prefix = F.substring(entity_id, 1, 3)
    return F.when(prefix == "S1-", 1).when(prefix == "S2-", 2).when(prefix == "S3-", 3).otherwise(F.raise_error(F.concat(F.lit("unknown source in id "), F.coalesce(entity_id, F.lit("NULL")))).cast("int")).cast("tinyint")


def id_value(entity_id: Column) -> Column:
    """The number of an id without leading zeros and at most MAX_ID; anything else is an error when evaluated."""
    good = F.coalesce(entity_id.rlike(r"^S[123]-(0|[1-9][0-9]{0,9})$"), F.lit(False))
    value = F.try_to_number(F.substring(entity_id, 4, 10), F.lit("9999999999")).cast("bigint")
    bad = F.raise_error(F.concat(F.lit("bad id "), F.coalesce(entity_id, F.lit("NULL")))).cast("bigint")
    return F.when(good & (value <= MAX_ID), value).otherwise(bad)


def entity_id(source: Column, value: Column) -> Column:
    return F.concat(F.lit("S"), source.cast("string"), F.lit("-"), value.cast("string"))


def target_code(source: Column, value: Column) -> Column:
    """One number for a record of any source; sources do not collide."""
    return source.cast("bigint") * F.lit(SOURCE_BASE).cast("bigint") + value.cast("bigint")


def code_source(code: Column) -> Column:
    return F.floor(code / F.lit(SOURCE_BASE)).cast("tinyint")


def code_value(code: Column) -> Column:
    return F.pmod(code, F.lit(SOURCE_BASE).cast("bigint"))


def safe_label(label: Column) -> Column:
    """A label usable as a file name; a blank one gets a name of its own."""
    return F.when(F.trim(label) == "", F.lit("_blank_")).otherwise(F.regexp_replace(label, "[^A-Za-z0-9_-]+", "_"))
