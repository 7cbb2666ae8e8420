"""Pieces of words as plans: greedy longest pieces of a vocabulary, bags of character n-grams as mean vectors.

Both work on distinct words; texts get their results by a join on the word, so a frequent word costs no more than a rare one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.functions.text import ngrams

UNKNOWN = "[UNK]"
#: What a piece inside of a word begins with.
INSIDE = "##"


def longest_pieces(words: DataFrame, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """(word, pieces): each distinct word cut from left to right into the longest pieces there are.

    vocabulary: piece, its entries inside of words with ## before them. Substrings of at most the longest piece's length
    meet the vocabulary in an equi-join; a word's longest pieces by their place are then walked from its first letter. A
    word that cannot be covered is [UNK]; an empty one has no pieces, a null one is left out.
    """
    one = words.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct()
    bare = vocabulary.select("piece").where("piece is not null").distinct()
    most = bare.agg(F.max(F.length("piece"))).first()[0] or 1
    starts = one.where("word <> ''").select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    ends = starts.select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.length("word") - F.col("at") + 1))).alias("n"))
    some = ends.withColumn("piece", F.concat(F.when(F.col("at") > 1, INSIDE).otherwise(""), F.substring("word", F.col("at"), F.col("n"))))
    best = some.join(bare, "piece").groupBy("word", "at").agg(F.max(F.struct("n", "piece")).alias("b"))
    listed = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "b"))).alias("by"))
    found = one.join(listed, "word", "left")
    none = F.array().cast("array<string>")

    def walk(acc: Column, at: Column) -> Column:
        step = F.try_element_at("by", at)
        return F.when((acc["next"] == at) & step.isNotNull(), F.struct((at + step["n"]).alias("next"), F.concat(acc["out"], F.array(step["piece"])).alias("out"))).otherwise(acc)

    walked = F.aggregate(F.sequence(F.lit(1), F.length("word")), F.struct(F.lit(1).alias("next"), none.alias("out")), walk)
    out = F.when(F.col("word") == "", none).when(F.col("by").isNull(), F.array(F.lit(UNKNOWN)))
    return found.withColumn("_w", F.when((F.col("word") != "") & F.col("by").isNotNull(), walked)).select("word", F.coalesce(out, F.when(F.col("_w.next") == F.length("word") + 1, F.col("_w.out")), F.array(F.lit(UNKNOWN))).alias("pieces"))


def bag_vectors(words: DataFrame, vectors: DataFrame, size: int, word: str = "word", least: int = 1, most: int | None = None) -> DataFrame:
    """(word, n_known, vector): for each distinct word the mean of the vectors of its n-grams that are known.

    vectors: gram, vector (an array of size numbers). N-grams are those of the word between < and >, of all lengths from
    least to most (None: to the whole), repeated ones counted each time. A word without a known one has zeros.
    """
    one = words.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct()
    upper = F.length("word") + 2 if most is None else F.lit(most)
    grams = one.select("word", F.explode(ngrams(F.col("word"), F.lit(least), upper)).alias("gram"))
    counted = grams.groupBy("word", "gram").agg(F.count("*").alias("times"))
    met = counted.join(vectors.select("gram", "vector"), "gram")
    sums = [F.sum(F.col("times") * F.col("vector")[i].cast("double")).alias(f"s{i}") for i in range(size)]
    totals = met.groupBy("word").agg(F.sum("times").alias("n_known"), *sums)
    mean = F.array(*[F.coalesce(F.col(f"s{i}") / F.col("n_known"), F.lit(0.0)) for i in range(size)])
    return one.join(totals, "word", "left").select("word", F.coalesce("n_known", F.lit(0)).cast("long").alias("n_known"), mean.alias("vector"))
