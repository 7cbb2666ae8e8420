"""Diagnostics of the verbalising plan: two streams, what later ones replace, and where they stand in the text as given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalis.kernel.frontend import MIXED, PRESERVED
from vocalis.kernel.text import CYRILLIC, LATIN
from vocalis.operators.lexemes import _S
from vocalis.operators.verbalise import read_parts

# fixed diagnostic text
COMPOUND = "Unable to inflect a compound numeric surface"


def original_bytes(clean: Column, island: Column, at: Column) -> Column:
    """Bytes of an island before the place that is code point at of its cleaned form: cleaning changes spaces only, so
    it is found by the number of other characters before it. The counted group is possessive: Java steps through it in a
    loop, where others call themselves once a character and overflow the stack."""
    before = F.length(F.replace(F.substring(clean, F.lit(1), at), F.lit(" ")))
    prefix = F.regexp_substr(island, F.concat(F.lit(f"^(?:[{_S}]*+[^{_S}]){{"), before.cast("string"), F.lit("}+")))
    return F.octet_length(F.when(clean.startswith(island), F.substring(island, F.lit(1), at)).otherwise(prefix))


def superseded(spans: DataFrame, *key: str) -> DataFrame:
    """Spans (key, stage, begin, end) without repeats and without those that a later stage replaces.

    Of equal ranges the earliest stage stays. A range inside of a larger one of a later stage goes: a sweep by begin with
    the furthest end so far of the later stage decides, so no pairs are made. Two stages, 0 and 1.
    """
    first = W.partitionBy(*key, "begin", "end").orderBy("stage")
    one = spans.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    # later ranges come before those that begin where they do
    order = W.partitionBy(*key).orderBy("begin", F.desc("stage"), F.desc("end")).rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("stage") == 1, F.col("end"))).over(order)
    return one.withColumn("_reach", reach).where((F.col("stage") == 1) | ~F.coalesce(F.col("_reach") >= F.col("end"), F.lit(False))).drop("_reach")


def diagnostics(df: DataFrame, keep: list[str], text: str = "text", language: str = "auto") -> DataFrame:
    """The columns kept, and code, message, offset, length: one row for each diagnostic, in bytes of the text as given.

    Surfaces that stay are unresolved_number. Compound numbers after a word that asks for a case are reported by a pass
    of their own, and what is kept later replaces those inside of it. In auto, texts in both scripts are
    ambiguous_normalization as a whole. Null and empty texts have none; rows that are repeated each have their own.
    """
    if clash := {"code", "message", "offset", "length"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are there already")
    given = df.select(F.struct(*keep).alias("_keep"), F.col(text).alias("_text"))
    parts = read_parts(given.where(F.col("_text").rlike("[0-9]")), language)
    order = W.partitionBy("_row").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    size = F.octet_length("gap") + F.coalesce(F.octet_length("island"), F.lit(0))
    placed = parts.withColumn("_start", F.sum(size).over(order) - F.coalesce(F.octet_length("island"), F.lit(0)))
    staged = lambda c, stage: F.transform(F.coalesce(c, F.array().cast("array<struct<begin: bigint, end: bigint>>")), lambda s: F.struct(F.lit(stage).alias("stage"), s["begin"].alias("begin"), s["end"].alias("end")))
    each = placed.select("_keep", "_row", "_start", "clean", "island", F.explode(F.concat(staged("early", 0), staged("kept", 1))).alias("s"))
    at = lambda c: F.col("_start") + original_bytes(F.col("clean"), F.col("island"), F.col(c).cast("int"))
    # a surface ends behind its last character, and begins behind the spaces before it
    begin = F.col("_start") + original_bytes(F.col("clean"), F.col("island"), (F.col("s.begin") + 1).cast("int")) - F.octet_length(F.substring(F.col("clean"), (F.col("s.begin") + 1).cast("int"), F.lit(1)))
    spans = each.select("_keep", "_row", "s.stage", begin.alias("begin"), at("s.end").alias("end"))
    kept = superseded(spans, "_row").select("_keep.*", F.lit("unresolved_number").alias("code"), F.when(F.col("stage") == 0, COMPOUND).otherwise(PRESERVED).alias("message"), F.col("begin").cast("long").alias("offset"), (F.col("end") - F.col("begin")).cast("long").alias("length"))
    if language != "auto":
        return kept
    both = given.where(F.col("_text").rlike(f"[{CYRILLIC}]") & F.col("_text").rlike(f"[{LATIN}]"))
    return kept.unionByName(both.select("_keep.*", F.lit("ambiguous_normalization").alias("code"), F.lit(MIXED["dominant"]).alias("message"), F.lit(0).cast("long").alias("offset"), F.octet_length("_text").cast("long").alias("length")))
