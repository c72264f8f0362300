"""Token document frequencies by field and scope, and the rarity order of a record's tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "*"


def token_freq(records: DataFrame, min_count: int = 2) -> DataFrame:
    """(field, scope, token, df): records that hold a token, for each country and for all (scope ``*``).

    Tokens of a record are distinct, so a plain count is a document frequency; partial sums are made map-side.
    """
    rows = records.select("country", F.explode(F.array(F.struct(F.lit("n").alias("field"), F.col("ntok").alias("tokens")), F.struct(F.lit("a").alias("field"), F.col("atok").alias("tokens")))).alias("f"))
    rows = rows.select("country", F.col("f.field").alias("field"), F.explode("f.tokens").alias("token"))
    by_country = rows.groupBy("field", F.col("country").alias("scope"), "token").agg(F.count("*").alias("df"))
    whole = by_country.groupBy("field", F.lit(ANY).alias("scope"), "token").agg(F.sum("df").alias("df"))
    return by_country.unionByName(whole).filter(F.col("df") >= min_count).select("field", "scope", "token", "df")


def known_countries(freq: DataFrame) -> DataFrame:
    return freq.filter(F.col("scope") != ANY).select(F.col("scope").alias("country")).distinct()


def with_scope(records: DataFrame, freq: DataFrame) -> DataFrame:
    """Adds ``scope``: the record's country if the table knows it, else ``*`` (never token by token)."""
    known = known_countries(freq).withColumn("__known", F.lit(True))
    return records.join(known, "country", "left").withColumn("scope", F.when(F.col("__known"), F.col("country")).otherwise(ANY)).drop("__known")


def token_counts(records: DataFrame, freq: DataFrame, key: str, tokens: str, field: str) -> DataFrame:
    """(key, items): the record's tokens as structs (df, token), a missing frequency counting as 1."""
    rows = with_scope(records.select(key, "country", tokens), freq).select(key, "scope", F.explode_outer(tokens).alias("token"))
    found = rows.join(freq.filter(F.col("field") == field).select("scope", "token", "df"), ["scope", "token"], "left")
    item = F.when(F.col("token").isNotNull(), F.struct(F.coalesce("df", F.lit(1)).cast("bigint").alias("df"), "token"))
    return found.groupBy(key).agg(F.collect_list(item).alias("items"))


def by_rarity(items: Column) -> Column:
    """Tokens with the rarest first; then longer ones, then alphabetical."""
    order = F.transform(items, lambda x: F.struct(x["df"].alias("df"), (-F.length(x["token"])).alias("short"), x["token"].alias("token")))
    return F.transform(F.array_sort(order), lambda x: x["token"])


def in_rarity_order(records: DataFrame, freq: DataFrame, key: str = "code") -> DataFrame:
    """Replaces ``ntok`` and ``atok`` by their rarity order."""
    out = records
    for column, field in (("ntok", "n"), ("atok", "a")):
        found = token_counts(records, freq, key, column, field).select(key, by_rarity(F.col("items")).alias("__order"))
        out = out.join(found, key, "left").withColumn(column, F.coalesce("__order", F.array().cast("array<string>"))).drop("__order")
    return out
