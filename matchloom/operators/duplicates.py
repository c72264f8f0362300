"""Records with the same text, and matches extended to them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_NAME, MIN_ADDRESS = 5, 12


@F.pandas_udf(T.StringType())
def exact_text(texts: pd.Series) -> pd.Series:
    """Compatibility and case folded, white space squeezed."""
    return texts.fillna("").map(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def exact_groups(records: DataFrame) -> DataFrame:
    """(entity_id or code columns kept, print): records with long enough texts whose (country, name, address) repeat."""
    named = records.withColumn("__n", exact_text("business_name")).withColumn("__a", exact_text("business_address"))
    long = named.filter((F.length("__n") >= MIN_NAME) & (F.length("__a") >= MIN_ADDRESS))
    prints = long.withColumn("print", F.sha2(F.concat_ws("\u0001", "country", "__n", "__a"), 256)).drop("__n", "__a")
    repeated = prints.groupBy("print").agg(F.count("*").alias("copies")).filter("copies > 1")
    return prints.join(repeated, "print")


def expand_matches(matches: DataFrame, groups: DataFrame) -> DataFrame:
    """(anchor, code, p): matches and the text twins of their targets, each with its best probability."""
    members = groups.select("code", "print")
    twins = matches.join(members, "code").select("anchor", "print", "p").join(members, "print").select("anchor", "code", "p")
    return matches.select("anchor", "code", "p").unionByName(twins).groupBy("anchor", "code").agg(F.max("p").alias("p"))
