"""Spans of regular expressions as DataFrame functions: text between matches gives the places of the matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<begin: bigint, end: bigint, hit: string>>"


def spans(text: Column, pattern: str, maybe: Column, unit: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches nothing: array of begin, end (code points, end
    exclusive) and the matched text. maybe: a cheap test that holds wherever the pattern can match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, both: Column) -> Column:
        begin = acc["at"] + F.char_length(both["gap"])
        end = begin + F.char_length(both["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.cast("bigint").alias("begin"), end.cast("bigint").alias("end"), both["hit"].alias("hit")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    found = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(text.isNotNull() & maybe, found).otherwise(F.array().cast(SPAN))


def tagged(name: str, found: Column, rank: int) -> Column:
    """Spans as struct(begin, rank, end, kind), which sort by begin, then by rank."""
    return F.transform(found, lambda s: F.struct(s["begin"].alias("begin"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind")))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined, of tagged spans in order."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(found: Column, begin: Column, end: Column) -> Column:
    return F.exists(found, lambda s: (s["begin"] < end) & (begin < s["end"]))
