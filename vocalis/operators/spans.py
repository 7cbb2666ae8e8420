"""Span operators: where patterns match, merging, overlap, ownership. Spans are byte ranges (begin, end exclusive)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalis.functions.text import TOKEN, let, technical_marked, technical_pattern
from vocalis.kernel import technical
from vocalis.kernel.text import CYRILLIC, LATIN, MARKS

SPAN = "array<struct<begin: bigint, end: bigint, hit: string>>"
LEXICAL = f"[{CYRILLIC}{LATIN}{MARKS}]+"
BOUNDARY = ".,;:!?\n"


def match_spans(text: Column, pattern: str, maybe: Column | None = None) -> Column:
    """Matches of a pattern in order: array of begin, end (bytes) and hit. Split and extract give gaps and hits; running
    sums of their byte lengths give the places, so nothing leaves the JVM. maybe: a cheap test that holds wherever the
    pattern can match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = let(hits, lambda found: F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))))

    def step(acc: Column, both: Column) -> Column:
        begin = acc["at"] + F.octet_length(both["gap"])
        end = begin + F.octet_length(both["hit"])
        one = F.struct(begin.cast("bigint").alias("begin"), end.cast("bigint").alias("end"), both["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(text.isNotNull() & (F.lit(True) if maybe is None else maybe) & text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def token_spans(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, begin, end, token) of each word token. Texts have many tokens, so places are running sums over the
    exploded tokens of a row and not a fold over one array."""
    hits, gaps = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)
    pairs = let(hits, lambda found: F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(F.octet_length(g).alias("gap"), h.alias("token"))))
    each = df.select(key, F.monotonically_increasing_id().alias("_row"), pairs.alias("_p")).select(key, "_row", F.posexplode("_p").alias("pos", "_p"))
    end = F.sum(F.col("_p.gap") + F.octet_length("_p.token")).over(W.partitionBy("_row").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return each.select(key, "pos", (end - F.octet_length("_p.token")).alias("begin"), end.alias("end"), F.col("_p.token").alias("token"))


def technical_spans(df: DataFrame, key: str, text: str = "text", classes: tuple[str, ...] = tuple(technical.CLASSES)) -> DataFrame:
    """(key, class, begin, end, surface) of each class's matches; classes may overlap."""
    named = F.array(*[F.struct(F.lit(c).alias("class"), match_spans(F.col(text), technical_pattern(c), technical_marked(F.col(text), c)).alias("found")) for c in classes])
    # the outer explode keeps Spark from filtering by the whole array first, which would match every class twice
    each = df.select(key, F.explode_outer(named).alias("c")).select(key, "c.class", F.explode("c.found").alias("s"))
    return each.select(key, "class", "s.begin", "s.end", F.col("s.hit").alias("surface"))


def merge_spans(spans: DataFrame, *key: str, touching: bool = True) -> DataFrame:
    """Islands of overlapping spans (touching: of adjacent ones too): key, begin, end. Running maxima within the key."""
    order = W.partitionBy(*key).orderBy("begin", F.desc("end"))
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = before.isNull() | ((F.col("begin") > before) if touching else (F.col("begin") >= before))
    marked = spans.withColumn("_new", F.when(new, 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*key, "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_island")


def _overlap(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """Left rows (as _left), and whether any right span of their key overlaps them. A sweep instead of a join of pairs:
    right spans stand at their begin, left ones at their end, so the furthest end so far decides."""
    ours = left.select(F.struct(*[left[c] for c in left.columns]).alias("_left"), F.col(key).alias("_k"), F.col("end").alias("_at"), F.lit(0).alias("_side"))
    theirs = right.select(F.col(key).alias("_k"), F.col("begin").alias("_at"), F.lit(1).alias("_side"), F.col("end").alias("_end"))
    order = W.partitionBy("_k").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    swept = ours.unionByName(theirs, allowMissingColumns=True).withColumn("_last", F.max("_end").over(order)).where("_side = 0")
    return swept, F.coalesce(F.col("_k").isNotNull() & (F.col("_last") > F.col("_left.begin")), F.lit(False))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left spans that overlap any right span of their key. A null key meets none."""
    rows, met = _overlap(left, right, key)
    return rows.where(met).select("_left.*")


def apart(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left spans that overlap no right span of their key."""
    rows, met = _overlap(left, right, key)
    return rows.where(~met).select("_left.*")


def colliding(spans: DataFrame, *key: str) -> DataFrame:
    """Spans that begin before the end of the one before them."""
    order = W.partitionBy(*key).orderBy("begin", "end")
    return spans.withColumn("_last", F.lag("end").over(order)).where("_last > begin").drop("_last")


def indexed(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges as an interval index: key, level, bucket, range_begin, range_end. A range of up to 2 ** level places stands in
    the one or two buckets of that width that it touches; empty ranges hold nothing and are left out."""
    level = F.length(F.bin(F.col("end") - F.col("begin") - 1))
    some = ranges.where("begin < end").select(F.col(key).alias("_k"), F.col("begin").alias("range_begin"), F.col("end").alias("range_end"), level.alias("_level"))
    touched = F.sequence(F.expr("shiftright(range_begin, _level)"), F.expr("shiftright(range_end - 1, _level)"))
    return some.withColumn("_bucket", F.explode(touched))


def containing(words: DataFrame, ranges: DataFrame, key: str, held: bool = False) -> DataFrame:
    """Each word with the first range of its key (by begin, then end) that holds it: adds range_begin, range_end or nulls.
    held: only words that a range holds; the others leave at the join.

    An equi-join of key, level and bucket with the interval index, then the exact test: a key that holds most of all spans
    is spread by its buckets, and a word meets only ranges about its place. An empty word at the end of a range is outside
    of it. The levels that occur, 64 at most, are
    collected. Words that are repeated stay; a null key meets none.
    """
    index = indexed(ranges, key)
    levels = sorted(r["_level"] for r in index.select("_level").distinct().collect())
    if not levels:
        words = words.limit(0) if held else words
        return words.withColumns({"range_begin": F.lit(None).cast("bigint"), "range_end": F.lit(None).cast("bigint")})
    probes = F.explode(F.array(*[F.struct(F.lit(n).alias("_level"), F.shiftright(F.col("_at"), n).alias("_bucket")) for n in levels]))
    numbered = words.select(F.struct(*words.columns).alias("_word"), F.col(key).alias("_k"), F.col("begin").cast("bigint").alias("_at"), F.col("end").alias("_to"), F.monotonically_increasing_id().alias("_id"))
    probing = numbered.select("_word", "_k", "_at", "_to", "_id", probes.alias("_p")).select("_word", "_k", "_at", "_to", "_id", "_p.*")
    met = probing.join(index, ["_k", "_level", "_bucket"], "inner" if held else "left")
    holds = (F.col("range_begin") <= F.col("_at")) & (F.col("_to") <= F.col("range_end"))
    met = met.where(holds) if held else met
    first = met.groupBy("_id").agg(F.first("_word").alias("_word"), F.min(F.when(holds, F.struct("range_begin", "range_end"))).alias("_range"))
    return first.select("_word.*", "_range.range_begin", "_range.range_end")


def segments(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lexical runs, numbers and boundaries in order, each with its segment's number: key, kind, begin, end, hit, segment."""
    pattern = f"{LEXICAL}|[0-9]+|[{BOUNDARY}]"
    each = df.select(key, F.explode(match_spans(F.col(text), pattern)).alias("s")).select(key, "s.*")
    kind = F.when(F.col("hit").rlike("^[0-9]"), "number").when(F.col("hit").rlike(f"^[{BOUNDARY}]"), "boundary").otherwise("word")
    order = W.partitionBy(key).orderBy("begin").rowsBetween(W.unboundedPreceding, 0)
    return each.withColumn("kind", kind).withColumn("segment", F.sum(F.when(kind == "boundary", 1).otherwise(0)).over(order))


def owners(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Each number with the language of the nearest word of one script in its segment (the left one in ties), or null.

    A two-way as-of join inside of each row: one fold over its lexemes carries the last word along, another from the end
    the next one, and a boundary forgets it. Nothing is shuffled or sorted.
    """
    word_type, number_type = "struct<begin: bigint, end: bigint, tongue: string>", "begin: bigint, end: bigint, hit: string"

    def told(h: Column) -> Column:
        cyrillic, latin = h["hit"].rlike(f"[{CYRILLIC}]"), h["hit"].rlike(f"[{LATIN}]")
        number, boundary = h["hit"].rlike("^[0-9]"), h["hit"].rlike(f"^[{BOUNDARY}]")
        kind = F.when(number, "number").when(boundary, "boundary").otherwise("word")
        tongue = F.when(~number & ~boundary & (cyrillic != latin), F.when(cyrillic, "russian").otherwise("english"))
        return F.struct(h["begin"].alias("begin"), h["end"].alias("end"), h["hit"].alias("hit"), kind.alias("kind"), tongue.alias("tongue"))

    def carried(hits: Column) -> Column:
        """The numbers in the order of the hits, each with the last word before it."""
        start = F.struct(F.lit(None).cast(word_type).alias("word"), F.array().cast(f"array<struct<{number_type}, word: {word_type}>>").alias("out"))

        def step(acc: Column, h: Column) -> Column:
            word = F.when(h["kind"] == "boundary", F.lit(None).cast(word_type)).when(h["tongue"].isNotNull(), F.struct(h["begin"].alias("begin"), h["end"].alias("end"), h["tongue"].alias("tongue"))).otherwise(acc["word"])
            number = F.struct(h["begin"].alias("begin"), h["end"].alias("end"), h["hit"].alias("hit"), acc["word"].alias("word"))
            return F.struct(word.alias("word"), F.when(h["kind"] == "number", F.concat(acc["out"], F.array(number))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(hits, start, step, lambda acc: acc["out"])

    both = lambda hits: F.zip_with(carried(hits), F.reverse(carried(F.reverse(hits))), lambda a, b: F.struct(a["begin"].alias("begin"), a["end"].alias("end"), a["hit"].alias("hit"), a["word"].alias("left"), b["word"].alias("right")))
    found = let(F.transform(match_spans(F.col(text), f"{LEXICAL}|[0-9]+|[{BOUNDARY}]"), told), both)
    near = df.select(key, F.explode_outer(found).alias("_n")).where("_n is not null").select(key, "_n.*")
    nearer = F.when(F.col("right").isNull() | (F.col("begin") - F.col("left.end") <= F.col("right.begin") - F.col("end")), F.col("left.tongue")).otherwise(F.col("right.tongue"))
    return near.select(key, "begin", "end", F.col("hit").alias("number"), F.when(F.col("left").isNull(), F.col("right.tongue")).otherwise(nearer).alias("owner"))


def splice(text: Column, edits: Column) -> Column:
    """text with edits (array of begin, end in code points, said), which must not overlap, applied left to right."""
    ordered = F.array_sort(edits)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (e["begin"] - acc["at"]).cast("int"))
        return F.struct(e["end"].cast("bigint").alias("at"), F.concat(acc["out"], gap, e["said"]).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def merge_streams(first: DataFrame, second: DataFrame, *key: str) -> DataFrame:
    """The spans of two streams as one stream of islands: overlapping and touching ones become one, empty ones go."""
    return merge_spans(union_all([first.select(*key, "begin", "end"), second.select(*key, "begin", "end")]).where("begin < end"), *key)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
