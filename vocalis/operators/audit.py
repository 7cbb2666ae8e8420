"""Quality audit: outcomes of normalised cases, counts, snapshots and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("correct_transformation", "justified_preservation", "unnecessary_refusal", "incorrect_or_partial")


def outcome(expectation: Column, text: Column, expected: Column, observed: Column) -> Column:
    same = observed == expected
    return F.when(same & (expectation == "preserve"), OUTCOMES[1]).when(same, OUTCOMES[0]).when(observed == text, OUTCOMES[2]).otherwise(OUTCOMES[3])


def counts(cases: DataFrame) -> DataFrame:
    """cases (language, category, outcome) counted by outcome, by language and outcome, by category and outcome, in one
    pass: level, name, outcome, n."""
    sets = cases.groupingSets([["outcome"], ["language", "outcome"], ["category", "outcome"]], "language", "category", "outcome").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    level = F.when(F.col("g") == 6, "all").when(F.col("g") == 2, "language").otherwise("category")
    return sets.select(level.alias("level"), F.coalesce("language", "category", F.lit("")).alias("name"), "outcome", "n")


def diversity(cases: DataFrame) -> DataFrame:
    return cases.agg(F.countDistinct("id").alias("ids"), F.countDistinct("category").alias("categories"), F.countDistinct("language").alias("languages"))


def snapshot(cases: DataFrame) -> DataFrame:
    """cases (id, category, outcome, observed) as tagged rows: tag, key, value."""
    counted = cases.groupBy("outcome").count()
    # the total is made of the counts, whose shuffle both read: the cases are not judged once more
    total = counted.agg(F.lit("cases").alias("tag"), F.lit("").alias("key"), F.coalesce(F.sum("count"), F.lit(0)).cast("string").alias("value"))
    by = counted.select(F.lit("outcome").alias("tag"), F.col("outcome").alias("key"), F.col("count").cast("string").alias("value"))
    off = cases.where(F.col("outcome").isin(*OUTCOMES[2:])).select(F.lit("mismatch").alias("tag"), F.col("id").alias("key"), F.concat_ws(":", "category", "outcome").alias("value"))
    return total.unionByName(by).unionByName(off)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two snapshots that differ: tag, key, old, new, change (added, removed, changed)."""
    a, b = old.withColumnRenamed("value", "old"), new.withColumnRenamed("value", "new")
    both = a.join(b, ["tag", "key"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Both hold the same rows, as often."""
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def unapproved(changes: DataFrame, approved: DataFrame) -> DataFrame:
    """Changes that the list of approved keys does not name."""
    return changes.join(approved, ["tag", "key"], "left_anti")


def first_mismatches(cases: DataFrame, n: int = 100) -> DataFrame:
    """The first n mismatches in corpus order (row_no); a report, so it is limited."""
    return cases.where(F.col("outcome").isin(*OUTCOMES[2:])).orderBy("row_no").limit(n)


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Nearest-rank percentiles, mean and range."""
    ranks = [F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return df.groupBy(*by).agg(F.min(value).alias("least"), F.avg(value).alias("mean"), *ranks, F.max(value).alias("most"))
