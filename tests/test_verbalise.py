"""The verbalising plan: written forms in context, surfaces that stay whole, SQL over whole texts, awkward rows."""

import random
import re
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vocalis.operators import lexemes
from vocalis.operators.verbalise import verbalise
from vocalis.plans.verbalised import _LAST, english_sql

STAY_EN = ["2 kg /3", "2 kg #3", "2 kg#3", "2 kg+3", "2 kg−3", "2 GB #3", "2 kg $3", "Use 2 кг.", "Use 2 kg % 3.", "$ 1", "$-1", "€1", "1$", "1:02%", "1,234.56.7", "from 1999 to 2004 ok", "May 35, 2024 is", "at 25:00", "5-6", "5/6", "1.5.2", "+3 kg", "11st", "1234567890", "5 messages", "1:02#3", "12 34567 x"]
STAY_RU = ["2 кг #3", "2 кг % 3", "2 руб.$3", "2 руб. $3", "после 2 руб... / 2", "после 2́ / 2", "после 2́ % 2", "после 2́ — 2", "после 2́ кг / 2", "после 2 / 3", "после 2/ 3", "после 2 + 3", "после 2# 3", "после 2- 3", "после 2= 3", "после 2* 3", "после 2$ 3", "1,234 руб.", "35.06.2024 x", "0999 x", "С 1999 по 2004 год", "2.5% 40", "Рост 2.5%/7", "+3 дня", "3 книгиz тут", "3 ошибки / 7", "5€", "5 ₽", "24:00", "1:02%"]
SPOKEN_EN = {
    "2 kg 3": "two kilograms three",
    "1 kg -2 kg": "one kilogram minus two kilograms",
    "in 1999 we": "in nineteen ninety nine we",
    "in 2100 we": "in two thousand one hundred we",
    "May 5, 2024 is": "May fifth, two thousand twenty four is",
    "$12.5 and $1": "twelve dollars fifty cents and one dollar",
    "$5 $6": "five dollars six dollars",
    "1st 22nd 113th": "first twenty second one hundred thirteenth",
    "-0 and 7.05": "minus zero and seven point zero five",
    "12.5%  off , 5 %": "twelve point five percent off, five percent",
    "1 234 567 x": "one million two hundred thirty four thousand five hundred sixty seven x",
    "1,234 x": "one thousand two hundred thirty four x",
    "ip 1.2.3.4, RTX 4090, C++ 5": "ip 1.2.3.4, RTX 4090, C++ five",
    "(5) [6] \"7\"": "(five) [six] \"seven\"",
    "see https://a.co/5 v1.2 a1@b.co #7 5": "see https://a.co/5 v1.2 a1@b.co #7 five",
}
SPOKEN_RU = {
    "2 руб.": "два рубля.",
    "2 руб., да": "два рубля, да",
    "2,5 руб. тут": "два рубля пятьдесят копеек тут",
    "в 1999 году": "в тысяча девятьсот девяносто девятом году",
    "за 1999 год": "за тысяча девятьсот девяносто девятый год",
    "2024 г. был": "две тысячи двадцать четвёртом году был",
    "после 05.06.2024": "после пятого июня две тысячи двадцать четвёртого года",
    "5% и 2,5%": "пять процентов и две целых пять десятых процента",
    "до 2,5 тут": "до двух целых пяти десятых тут",
    "после 5 дней": "после пяти дней",
    "из 21 дня": "из двадцать один дня",
    "3 книги и 5 ошибки": "три книги и пять ошибок",
    "12 500 -42": "двенадцать тысяч пятьсот минус сорок два",
    "Use 2 кг 3.": "Use два килограмма три.",
    "т.д. 5 т.п.": "так далее пять тому подобное",
    "2,5 км и 5 ГБ": "две целых пять десятых километра и пять гигабайт",
}


def read(spark, texts, language):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r["i"]: r["normalized_text"] for r in verbalise(df, ["i"], "text", language).collect()}


@pytest.mark.parametrize("language, stay, spoken", [("english", STAY_EN, SPOKEN_EN), ("russian", STAY_RU, SPOKEN_RU)])
def test_forms_and_surfaces(spark, language, stay, spoken):
    texts = [*stay, *spoken]
    want = [*stay, *spoken.values()]
    got = read(spark, texts, language)
    assert {t: got[i] for i, t in enumerate(texts)} == dict(zip(texts, want, strict=True))


def test_by_segments_and_foreign_units(spark):
    texts = {"Use 2 кг.": "Use два килограмма.", "Use 2 кг 3.": "Use два килограмма three.", "Привет 2 kg /3": "Привет 2 kg /3", "Use 2 кг #3.": "Use 2 кг #3.", "Use 2 kg % 3.": "Use 2 kg % 3.", "five 5": "five five", "$5 за 05.06.2024 там": "five dollars за пятое июня две тысячи двадцать четвёртого года там"}
    assert read(spark, list(texts), "segment") == dict(enumerate(texts.values()))
    auto = {"Привет 2 kg /3": "Привет 2 kg /3", "Use 2 кг 3.": "Use два килограмма три.", "Use 2 кг % 3.": "Use 2 кг % 3."}
    assert read(spark, list(auto), "auto") == dict(enumerate(auto.values()))


PARTS = ["5", "12", "1999", "2 000", "1,234", "3.5", "$7", "$1.25", "9:30", "1st", "2nd", "%", "kg", "km,", "meters", "/", "#3", "+4", "-6", "from", "to", "in", "May", "7,", "2024.", "the", "word", "a-b", "x/3", "€9", "kg#3", "a@b.co", "http://a.b/1", "...", "8:99", "dollars", "(4)", "=", "* 2", "1.2.3.4", "v2.1", "C#", "é", "д", "5́", "минут"]


def test_sql_over_whole_texts_agrees(spark):
    """Islands and windows against SQL that never cuts a text, on sentences put together at random."""
    r = random.Random(5)
    texts = [" ".join(r.choice(PARTS) for _ in range(r.choice((1, 3, 6, 12, 40)))) for _ in range(600)]
    texts += ["".join(r.choice("0123 4567.,:/-+$%#abkg") for _ in range(r.choice((5, 20)))) for _ in range(600)]
    docs = pd.DataFrame({"i": range(len(texts)), "text": texts})  # noqa: F841
    want = dict(duckdb.sql(english_sql("docs", "i") + f"SELECT i, {_LAST} FROM d LEFT JOIN spoken USING (r)").fetchall())
    got = read(spark, texts, "english")
    assert [(texts[i], got[i], want[i]) for i in range(len(texts)) if got[i] != want[i]] == []


def test_awkward_rows(spark):
    rows = [(None, "5 км"), (1, None), (1, ""), (2, " \t"), (3, "5 km"), (3, "5 km"), (4, "x " * 3000 + "7"), (5, "7")]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "id int, text string, _row string, _text string, spoken string")
    got = sorted((str(r["id"]), str(r["normalized_text"])[-9:]) for r in verbalise(df, df.columns).collect())
    assert got == sorted([("None", "илометров"), ("1", "None"), ("1", ""), ("2", ""), ("3", "ilometers"), ("3", "ilometers"), ("4", "x x seven"), ("5", "seven")])
    assert verbalise(df.limit(0), ["id"]).collect() == []
    with pytest.raises(ValueError):
        verbalise(df.withColumnRenamed("spoken", "normalized_text"), ["normalized_text"])


def test_a_long_chain_is_one_surface(spark):
    """Twenty thousand numbers joined by slashes, and as many apart, in about the same time for each."""
    chain, apart = "/".join(["12"] * 20_000), " ".join(["12"] * 20_000)
    began = time.perf_counter()
    got = read(spark, [f"x {chain} y", apart], "english")
    assert got[0] == f"x {chain} y" and got[1] == " ".join(["twelve"] * 20_000)
    assert time.perf_counter() - began < 90


def test_islands_and_gaps_make_up_the_text(spark):
    texts = ["a b c d 5 e f g h i j 6 k", "5", "no number", "1 a 2 b c d e f 3"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in lexemes.pieces(df).collect():
        parts = [x for pair in zip(row["_gaps"], [*row["_islands"], ""], strict=True) for x in pair]
        assert "".join(parts) == row["text"]
        assert [x.endswith("\n") for x in row["_clean"]] == [i + 1 == len(row["_islands"]) and row["_gaps"][-1] == "" for i in range(len(row["_islands"]))]
    assert df.select(F.size(F.regexp_extract_all(F.lit("a b c d 5 e f g h i j 6 k"), F.lit(lexemes.ISLAND), F.lit(0)))).first()[0] == 2


def test_parts_are_islands_with_their_gaps(spark):
    """No row without an island, whose null key would bring one row of each text to one task; each text is cut once."""
    texts = ["a b c d 5 e f g h i j 6 k", "5", "1 a 2 b c d e f 3 ", "x y z w 7 a b c d"]
    got = lexemes.parts(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"])
    filters = [line for line in got.where("clean is not null")._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert not any("regexp_extract_all" in line for line in filters)
    for i, text in enumerate(texts):
        rows = got.where(F.col("i") == i).orderBy("_pos").collect()
        assert "".join(r["gap"] + r["island"] + (r["tail"] or "") for r in rows) == text
        assert [r["tail"] is not None for r in rows] == [False] * (len(rows) - 1) + [True]
        assert [r["clean"].endswith("\n") for r in rows] == [r["tail"] == "" for r in rows]


def test_cutting_runs_to_the_next_digit(spark):
    """Gaps and islands are those of ISLAND alone, whose search would try every word of a long text without digits."""
    r = random.Random(29)
    texts = ["".join(r.choice(["a", "bc", "7", "12", "1,5", " ", " ", " ", "  ", "\n", "\u00a0", "x9", "Ж.", "\x01" if i % 9 == 0 else "$1"]) for _ in range(r.randrange(60))) for i in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", " ", "7", " a 7 "]], "text string").select("text", F.regexp_extract_all("text", F.lit(lexemes.ISLAND), F.lit(0)).alias("islands"), F.split("text", lexemes.ISLAND, -1).alias("gaps"))
    for row in lexemes.pieces(df).collect():
        assert (row["_islands"], row["_gaps"]) == (row["islands"], row["gaps"]), row["text"]
    parts = lexemes.parts(df.withColumn("n", F.monotonically_increasing_id()).where("text rlike '[0-9]'"), ["n", "islands", "gaps"])
    for row in parts.collect():
        at = row["_pos"]
        assert row["gap"] == row["gaps"][at] and row["island"] == row["islands"][at] and row["tail"] == (row["gaps"][-1] if at + 1 == len(row["islands"]) else None)
    long = spark.range(40).select(F.repeat(F.lit("word "), 200_000).alias("text"), F.lit(1).alias("n")).withColumn("text", F.concat("text", F.lit("7")))
    began = time.perf_counter()
    assert lexemes.parts(long, ["n"]).where("island = 'word word 7'").count() == 40
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("name", ["verbalized_contexts_en", "verbalized_contexts_ru", "verbalized_contexts_mixed"])
def test_contexts_are_cut_on_all_cores(spark, tmp_path, name):
    """A file of one row group is one task, however long its texts take to cut."""
    from vocalis.plans.library import QUERIES

    spark.range(40).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange RoundRobinPartitioning" in plan


def test_dominant_language_with_and_without_marks(spark):
    """Texts that no technical mark is in are counted at once, with the same result."""
    from vocalis.functions.text import dominant_language
    from vocalis.kernel import technical
    from vocalis.kernel.text import CYRILLIC, LATIN

    rng = random.Random(7)
    some = ["дом ", "слово ", "word ", "tea ", "v1.2 ", "1.2.3.4 ", "V 2. ", "GPU 5 ", "C++ ", "C# ", "#12 ", "a-b ", "a@b.co ", "HTTP/2 ", "https://ab.cd/ef ", "12 ", "3.5 ", "$4 ", "cost+x "]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 6))) for _ in range(300)]

    def wanted(text: str) -> str:
        for pattern in technical._COMPILED.values():
            text = pattern.sub(" ", text)
        cyrillic, latin = (len(re.findall(f"[{s}]", text)) for s in (CYRILLIC, LATIN))
        return "russian" if cyrillic and cyrillic >= latin else "english"

    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", dominant_language(F.col("text")).alias("said")).collect()
    assert [r["said"] for r in got] == [wanted(r["text"]) for r in got]
