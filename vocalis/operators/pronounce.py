"""Pronunciation by dictionary as a plan: longest phrases first, then tokens, then initialisms; the text put together again.

Tokens are rows. A sweep over tokens and phrase spans tells which phrase covers a token, dictionary entries meet the rest
by an equi-join, and ordered groups give the text back. Only what lies between the tokens travels with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalis.functions.text import TOKEN, detect_language, initialism
from vocalis.operators.dictionary import lookup_tokens, match_phrases


def _parts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, gap, token, begin, end): a row for each token with what stands before it, and one for what is left."""
    zipped = F.arrays_zip(F.split(text, TOKEN, -1).alias("gap"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("token"))
    each = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), detect_language(F.col(text)).alias("_language"), F.posexplode(zipped).alias("pos", "_p")).select("_key", "_language", "pos", "_p.gap", "_p.token")
    end = F.sum(F.octet_length("gap") + F.coalesce(F.octet_length("token"), F.lit(0))).over(W.partitionBy("_key").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return each.withColumns({"end": end, "begin": end - F.coalesce(F.octet_length("token"), F.lit(0))})


def pronounced_words(df: DataFrame, entries: DataFrame, key: str, text: str = "text", initialisms: bool = False) -> DataFrame:
    """(key, pos, gap, surface, said, begin, record, stressed_vowel, source) for each token, and for what follows the last.

    key tells texts apart and is not null; a null text has no rows. said: a phrase's pronunciation at its first token and
    nothing at the others, else that of the token's entry, else (if asked, in Russian texts) the initialism's reading, else
    the token. source: dictionary, initialism or null. record: the number, from 0, of the replacement within its text; a
    token's entry that says what is written makes none, a phrase always does. gap is left out inside of a phrase.
    """
    words = _parts(df, key, text)
    found = match_phrases(df.where(F.col(text).isNotNull()), entries, key, text).select(F.col(key).alias("_key"), "begin", "end", F.col("pronunciation").alias("phrase"))
    both = words.withColumn("side", F.lit(1)).unionByName(found.withColumn("side", F.lit(0)), allowMissingColumns=True)
    order = W.partitionBy("_key").orderBy("begin", "side").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct(F.col("begin").alias("from"), F.col("end").alias("to"), "phrase")), ignorenulls=True).over(order)
    swept = both.withColumn("_last", last).where("side = 1").withColumn("_inside", F.when((F.col("_last.to") > F.col("begin")) & F.col("token").isNotNull(), F.col("_last")))
    met = lookup_tokens(swept.withColumn("_free", F.when(F.col("_inside").isNull(), F.col("token"))).drop("phrase", "side"), entries, "_free")
    first = F.col("_inside.from") == F.col("begin")
    reading: Column = F.when(F.col("_language") == "russian", initialism(F.col("_free"))) if initialisms else F.lit(None).cast("string")
    said = F.when(F.col("_inside").isNotNull(), F.when(first, F.col("_inside.phrase")).otherwise("")).otherwise(F.coalesce("pronunciation", reading, "token", F.lit("")))
    source = F.when(F.col("_inside").isNotNull() | F.col("entry").isNotNull(), "dictionary").when(reading.isNotNull(), "initialism")
    replaced = F.coalesce(first, F.lit(False)) | (F.col("entry").isNotNull() & (F.col("pronunciation") != F.col("token")))
    count = F.sum(replaced.cast("int")).over(W.partitionBy("_key").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return met.select(
        F.col("_key").alias(key), "pos", F.when(F.col("_inside").isNotNull() & ~first, "").otherwise(F.col("gap")).alias("gap"), F.col("token").alias("surface"), said.alias("said"), "begin",
        F.when(replaced | F.col("_inside").isNotNull(), count - 1).alias("record"), "stressed_vowel", source.alias("source"),
    )


def pronounce(df: DataFrame, entries: DataFrame, key: str, text: str = "text", initialisms: bool = False) -> DataFrame:
    """(key, pronunciation_text): every text with what pronounced_words() says in place of its tokens."""
    words = pronounced_words(df, entries, key, text, initialisms)
    listed = words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "gap", "said"))).alias("all"))
    return listed.select(key, F.array_join(F.transform("all", lambda w: F.concat(w["gap"], w["said"])), "").alias("pronunciation_text"))
