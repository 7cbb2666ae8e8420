"""Diagnostics in bytes of the text as given, what later ones replace, and the interval index."""

import random

from pyspark.sql import functions as F

from vocalis.operators import spans
from vocalis.operators.diagnostics import COMPOUND, diagnostics, original_bytes, superseded


def found(spark, texts, language="auto"):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = {}
    for r in diagnostics(df, ["i"], "text", language).collect():
        data = texts[r["i"]].encode()
        out.setdefault(texts[r["i"]], []).append((r["code"], r["offset"], data[r["offset"] : r["offset"] + r["length"]].decode(), r["message"] == COMPOUND))
    return {t: sorted(v) for t, v in out.items()}


def test_surfaces_in_the_text_as_given(spark):
    texts = ["x  2  kg   /3 , y", "два 2 кг  #3 и 1:02%", "после  2 / 3", "Use 2 кг /3.", "five", "", " 5 km ", "é 5  6 7 kg#3 \t"]
    got = found(spark, texts)
    un = "unresolved_number"
    assert got == {
        texts[0]: [(un, 5, "2  kg   /3", False)],
        texts[1]: [(un, 7, "2 кг  #3", False), (un, 21, "1:02%", False)],
        texts[2]: [(un, 12, "2 / 3", True)],
        texts[3]: [("ambiguous_normalization", 0, "Use 2 кг /3.", False), (un, 4, "2 кг /3", False)],
        texts[7]: [(un, 8, "7 kg#3", False)],
    }


def test_later_ranges_replace_what_they_hold(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(2), b := r.randrange(30), b + r.randrange(1, 8)) for _ in range(300)]
    rows += rows[:40]
    got = {tuple(x) for x in superseded(spark.createDataFrame(rows, "k string, stage int, begin int, end int"), "k").select("k", "stage", "begin", "end").collect()}
    one = {}
    for k, stage, b, e in sorted(rows, key=lambda x: x[1]):
        one.setdefault((k, b, e), stage)
    late = [x for x, stage in one.items() if stage == 1]
    want = {(k, stage, b, e) for (k, b, e), stage in one.items() if stage == 1 or not any(k2 == k and b2 <= b and e <= e2 for k2, b2, e2 in late)}
    assert got == want


def test_interval_index_against_all_pairs(spark):
    r = random.Random(4)
    ranges = [(r.choice(["a", "b", None]), b := r.randrange(-50, 4000), b + r.choice((0, 1, 2, 3, 8, 9, 100, 3000))) for _ in range(300)]
    words = [(r.choice(["a", "b", None]), b := r.randrange(-50, 4000), b + r.randrange(1, 6), i) for i in range(400)]
    words += words[:5]
    schema = "k string, begin long, end long"
    out = spans.containing(spark.createDataFrame(words, schema + ", i int"), spark.createDataFrame(ranges, schema), "k")
    got = sorted((i, k, b, e, x, y) for k, b, e, i, x, y in [tuple(row) for row in out.select("k", "begin", "end", "i", "range_begin", "range_end").collect()])
    want = []
    for k, b, e, i in words:
        best = min(((x, y) for k2, x, y in ranges if k is not None and k2 == k and x <= b and e <= y), default=(None, None))
        want.append((i, k, b, e, *best))
    assert sorted(map(str, got)) == sorted(map(str, want))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert spans.containing(spark.createDataFrame(words, schema + ", i int"), spark.createDataFrame([], schema), "k").where(F.col("range_begin").isNotNull()).isEmpty()


def test_places_in_long_islands(spark):
    """A group counted by a greedy quantifier overflows Java's stack here."""
    island = "ab  " * 50_000 + "9"
    df = spark.createDataFrame([(" ".join(island.split()), island)], "clean string, island string")
    assert df.select(original_bytes(F.col("clean"), F.col("island"), F.lit(150_001))).first()[0] == len(island)
