"""Pronunciation as a plan against the row-level normaliser."""

import random

from vocalis.kernel.frontend import Entry, Options, process
from vocalis.operators.pronounce import pronounce, pronounced_words
from vocalis.sources import dictionary

ENTRIES = (Entry("the", "thee", "folded"), Entry("The", "thuh"), Entry("same", "same", "exact", 1), Entry("of the", "uv thuh", "phrase"), Entry("the of the", "long", "phrase"), Entry("of the", "never", "phrase"), Entry("cat, dog", "pets", "phrase"), Entry("кот", "к+от", "folded", 0))
WORDS = ["the", "The", "THE", "of", "same", "cat,", "dog", "cat", "кот", "КОТ", "МФЦ", "ИП", "x", "(the)", "a_b", "é", "—"]


def test_plan_equals_the_kernel(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 14))) for _ in range(150)] + ["", "—", "of the", "of the."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9999, None, "x")], "k int, text string, gap string")
    entries = dictionary.frame(spark, ENTRIES)
    want = [process(t, Options(entries=ENTRIES, initialisms=True)) for t in texts]
    got = {x["k"]: x["pronunciation_text"] for x in pronounce(df, entries, "k", initialisms=True).collect()}
    assert got == {i: w.pronunciation for i, w in enumerate(want)}
    words = {}
    for x in sorted(pronounced_words(df, entries, "k", initialisms=True).where("surface is not null").collect(), key=lambda x: (x["k"], x["pos"])):
        words.setdefault(x["k"], []).append((x["surface"], x["said"], x["begin"], x["record"], x["stressed_vowel"], x["source"]))
    for i, w in enumerate(want):
        kernel = [(s, said, at, record, vowel, "dictionary" if known else "initialism" if auto else None) for s, said, at, record, vowel, known, auto in w.words]
        assert words.get(i, []) == kernel, texts[i]


def test_empty_tables(spark):
    entries = dictionary.frame(spark, ENTRIES)
    empty = spark.createDataFrame([], "k int, text string")
    assert pronounce(empty, entries, "k").collect() == []
    one = spark.createDataFrame([(1, "the cat")], "k int, text string")
    assert [x["pronunciation_text"] for x in pronounce(one, entries.limit(0), "k").collect()] == ["the cat"]
