"""Readings that depend on the words around: rules with wildcards, the most specific one first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def apply_rules(tokens: DataFrame, rules: DataFrame, *order: str) -> DataFrame:
    """tokens with said (what the rule for it says, else null) and rule (its ord).

    tokens: token, the columns of order (the sequence's key first, the place last, which tell every token apart) and more.
    rules: ord, token, left, right, said; left and right are the words just before and after, null for any (also none).
    Of the rules that fit, the one with most words wins, then the one whose left word is given, then the least ord. Only
    tokens that rules name meet them, on the token itself, so the others cost nothing.
    """
    *key, place = order
    window = W.partitionBy(*key).orderBy(place)
    near = tokens.withColumns({"_left": F.lag("token").over(window), "_right": F.lead("token").over(window)})
    r = rules.select(F.col("token").alias("_t"), F.col("left").alias("_rl"), F.col("right").alias("_rr"), F.col("said").alias("_said"), F.col("ord").alias("_ord"))
    fits = (F.col("token") == F.col("_t")) & (F.col("_rl").isNull() | (F.col("_rl") == F.col("_left"))) & (F.col("_rr").isNull() | (F.col("_rr") == F.col("_right")))
    rank = F.struct((F.col("_rl").isNull().cast("int") + F.col("_rr").isNull().cast("int")).alias("free"), F.col("_rl").isNull().alias("any_left"), F.col("_ord").alias("ord"), F.col("_said").alias("said"))
    met = near.join(r, fits, "left").groupBy(*order).agg(F.first(F.struct(*tokens.columns)).alias("_token"), F.min(F.when(F.col("_t").isNotNull(), rank)).alias("_rule"))
    return met.select("_token.*", F.col("_rule.said").alias("said"), F.col("_rule.ord").alias("rule"))
