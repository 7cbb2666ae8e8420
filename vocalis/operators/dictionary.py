"""Dictionary operators: token lookup by insertion order, longest phrase matching. The dictionary is a small frame.

A dictionary frame has ord (insertion order), pattern, pronunciation, match (exact, folded, phrase), stressed_vowel. It
is written by hand, checked by the loader and at most MAX_ENTRIES long, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalis.functions.text import TOKEN, case_fold

#: About 10 MB; larger dictionaries are joined by shuffle.
MAX_ENTRIES = 100_000


def _sized(entries: DataFrame) -> DataFrame:
    few = entries.limit(MAX_ENTRIES + 1).count() <= MAX_ENTRIES
    return F.broadcast(entries) if few else entries


def lookup_tokens(words: DataFrame, entries: DataFrame, token: str = "token") -> DataFrame:
    """words with pronunciation, stressed_vowel, entry (its ord): of the first entry whose pattern is the token, or,
    ignoring case, the folded token. Exact entries do not outrank folded ones; nulls where none fits."""
    one = entries.where("match <> 'phrase'").withColumn("_key", F.when(F.col("match") == "exact", F.col("pattern")).otherwise(case_fold(F.col("pattern"))))
    best = one.groupBy("_key", "match").agg(F.min_by(F.struct("ord", "pronunciation", "stressed_vowel"), "ord").alias("e"))
    exact = _sized(best.where("match = 'exact'").select(F.col("_key").alias("_x"), F.col("e").alias("ex")))
    fold = _sized(best.where("match = 'folded'").select(F.col("_key").alias("_f"), F.col("e").alias("ef")))
    both = words.join(exact, F.col(token) == F.col("_x"), "left").join(fold, case_fold(F.col(token)) == F.col("_f"), "left")
    hit = F.when(F.col("ex.ord") < F.coalesce("ef.ord", F.lit(2**31 - 1)), F.col("ex")).otherwise(F.coalesce("ef", "ex"))
    return both.withColumn("_hit", hit).withColumns({"pronunciation": F.col("_hit.pronunciation"), "stressed_vowel": F.col("_hit.stressed_vowel"), "entry": F.col("_hit.ord")}).drop("_x", "_f", "ex", "ef", "_hit")


def match_phrases(df: DataFrame, entries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, begin, end, phrase, pronunciation): at each place the longest phrase, left to right, without overlap.

    A phrase stands between token borders, letter by letter as in the pattern. Runs of as many tokens as phrases have,
    with what stands between them, meet the phrases in an equi-join; the greedy choice runs over each text's hits. Rows that
    share a key are matched one by one.
    """
    phrases = entries.where("match = 'phrase'").withColumn("pattern", F.btrim("pattern")).withColumn("n", F.size(F.regexp_extract_all("pattern", F.lit(TOKEN), F.lit(0))))
    lengths = sorted(r["n"] for r in phrases.select("n").distinct().collect() if r["n"] > 0)
    if not lengths:
        return df.select(key, F.lit(0).cast("bigint").alias("begin"), F.lit(0).cast("bigint").alias("end"), F.lit("").alias("phrase"), F.lit("").alias("pronunciation")).limit(0)
    first = phrases.groupBy("pattern", "n").agg(F.min_by("pronunciation", "ord").alias("pronunciation"))
    pairs = F.zip_with(F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda g, t: F.struct(g.alias("gap"), t.alias("token")))
    each = df.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("row"), pairs.alias("ps")).select("k", "row", F.posexplode("ps").alias("pos", "p")).where("p.token is not null")
    order = W.partitionBy("row").orderBy("pos")
    end = F.sum(F.octet_length("p.gap") + F.octet_length("p.token")).over(order.rowsBetween(W.unboundedPreceding, 0))
    toks = each.select("k", "row", "pos", "p.token", F.concat("p.gap", "p.token").alias("more"), end.alias("end"))
    said = lambda n: F.struct(F.concat("token", *[F.lead("more", j).over(order) for j in range(1, n)]).alias("phrase"), F.lead("end", n - 1).over(order).alias("end"))
    grams = toks.select("k", "row", (F.col("end") - F.octet_length("token")).alias("begin"), F.array(*[said(n) for n in lengths]).alias("gs"))
    grams = grams.select("k", "row", "begin", F.inline("gs")).where("phrase is not null")
    hits = grams.join(_sized(first.select(F.col("pattern").alias("phrase"), "pronunciation")), "phrase")
    listed = hits.groupBy("k", "row").agg(F.sort_array(F.collect_list(F.struct("begin", F.negative("end").alias("last"), "phrase", "pronunciation"))).alias("hs"))
    kind = "array<struct<begin: bigint, end: bigint, phrase: string, pronunciation: string>>"

    def take(acc: Column, h: Column) -> Column:
        one = F.struct(h["begin"].alias("begin"), F.negative(h["last"]).alias("end"), h["phrase"].alias("phrase"), h["pronunciation"].alias("pronunciation"))
        return F.when(h["begin"] < acc["at"], acc).otherwise(F.struct(F.negative(h["last"]).alias("at"), F.concat(acc["out"], F.array(one)).cast(kind).alias("out")))

    chosen = F.aggregate("hs", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out")), take, lambda acc: acc["out"])
    return listed.select(F.col("k").alias(key), F.inline(chosen))
