"""Functions, operators, sources, Arrow functions, streaming, and every query against its SQL."""

import random
import re

import duckdb
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from vocalis.functions import text as T
from vocalis.functions import words as N
from vocalis.functions.text import known_prefix
from vocalis.kernel import english, russian
from vocalis.kernel.frontend import Entry, Options, process
from vocalis.operators import audit, dictionary, spans
from vocalis.plans.library import ORACLE_SQL, QUERIES
from vocalis.sources import corpora
from vocalis.sources import dictionary as files
from vocalis.udf import normalize

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.register(t, ds.dataset(f"{small}/{t}.parquet").to_table())
    return con


def rows_of(table, names):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r.values()) for r in table.select(names).to_pylist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small).toArrow()
    if name not in ORACLE_SQL:
        assert got.num_rows
        return
    want = duck.sql(ORACLE_SQL[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    assert rows_of(got, names) == rows_of(want, names)


def test_native_words_equal_the_kernels(spark):
    ns = [0, 1, 2, 5, 11, 14, 19, 20, 21, 99, 100, 101, 111, 112, 999, 1000, 1001, 2000, 5000, 11000, 21001, 999_999, 1_000_000, 2_000_002, 999_999_999, -1, -21, -1000]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = df.select("n", N.en_cardinal(F.col("n")), N.en_ordinal(F.col("n")), N.ru_cardinal(F.col("n")), N.ru_cardinal(F.col("n"), True), N.ru_genitive(F.col("n")), N.en_suffix(F.col("n"))).collect()
    for n, *words in got:
        assert words == [english.cardinal(n), english.ordinal(n), russian.cardinal(n), russian.cardinal(n, True), russian.genitive(n), english.suffix(n)]


def test_native_tokens_equal_the_kernels(spark):
    tokens = ["7.05", "0.50", "-0.5", "12"]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(N.en_decimal(F.col("t")), N.ru_decimal(F.replace("t", F.lit("."), F.lit(",")))).collect()
    assert [r[0] for r in got] == ["seven point zero five", "zero point five zero", "minus zero point five", "twelve"]
    assert [r[1] for r in got][:2] == [russian.decimal("7", "05"), russian.decimal("0", "50")]


def test_cleanup_and_bytes(spark):
    texts = [" a  \t b ,c ", "", "x\n\n.y", " ", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.clean_spacing(F.col("t"))).collect()]
    assert got == ["a b,c", "", "x.y", "", None]
    raw = ["C0AF", "EDA080", "F4908080", "E228A1", "F09F98", "F09F9880"]
    valid = [r[0] for r in spark.createDataFrame([(bytes.fromhex(x),) for x in raw], "b binary").select(T.utf8_valid(F.col("b"))).collect()]
    assert valid == [False] * 5 + [True]


def test_case_like_and_argmax(spark):
    got = spark.sql("select 1").select(T.case_like(F.lit("WORD"), F.lit("при")), T.case_like(F.lit("Word"), F.lit("при")), T.case_like(F.lit("word"), F.lit("при")), T.argmax(F.array(F.lit(1), F.lit(3), F.lit(3)))).first()
    assert tuple(got) == ("ПРИ", "При", "при", 1)


def test_span_operators(spark):
    s = spark.createDataFrame([(1, 0, 4), (1, 2, 6), (1, 6, 8), (1, 10, 12), (2, 0, 1)], "doc long, begin long, end long")
    assert sorted(tuple(r) for r in spans.merge_spans(s, "doc").collect()) == [(1, 0, 8), (1, 10, 12), (2, 0, 1)]
    assert (1, 0, 6) in {tuple(r) for r in spans.merge_spans(s, "doc", touching=False).collect()}
    other = spark.createDataFrame([(1, 3, 5)], "doc long, begin long, end long")
    assert spans.overlapping(s, other, "doc").count() == 2 and spans.apart(s, other, "doc").count() == 3
    assert spans.colliding(s, "doc").count() == 1
    inside = {(r.doc, r.begin): r.range_begin for r in spans.containing(other, s, "doc").collect()}
    assert inside == {(1, 3): 2}


def test_phrases_take_the_longest_and_do_not_overlap(spark):
    entries = files.frame(spark, (Entry("a b", "AB", "phrase"), Entry("a b c", "ABC", "phrase"), Entry("c d", "CD", "phrase")))
    df = spark.createDataFrame([(1, "a b c d a b"), (2, "a  b"), (3, None)], "id long, text string")
    got = sorted((r.id, r.begin, r.pronunciation) for r in dictionary.match_phrases(df, entries, "id").collect())
    assert got == [(1, 0, "ABC"), (1, 8, "AB")]


@pytest.mark.parametrize(
    "bad",
    [b"[] x", b"[{'a':1}]", b'[{"token":"a","pronunciation":"b","x":1}]', b'[{"token":"a","token":"b","pronunciation":"c"}]', b'[{"token":"A","pronunciation":"b","match":"case_insensitive"},{"token":"a","pronunciation":"c","match":"case_insensitive"}]', b'[{"token":"a\x01","pronunciation":"b"}]', b'[{"token":"\\ud800","pronunciation":"b"}]', b"\xc0\xaf", b"[NaN]", b"{}", b'[{"token":"a"}]', b'[{"phrase":"a b","pronunciation":"c","match":"exact_token"}]'],
)
def test_bad_dictionaries(bad):
    with pytest.raises(ValueError):
        files.parse(bad)


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.json").write_bytes('[{"token":"\\u0430","pronunciation":"b"},{"phrase":"a b","replacement":"c","stressed_vowel":2}]'.encode())
    got = files.load(spark, str(tmp_path / "d.json"))
    assert got == (Entry("а", "b"), Entry("a b", "c", "phrase", 2))
    with pytest.raises(ValueError):
        files.add(got, [Entry("x", "y"), Entry("а", "z")])


def test_corpus_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", "en", "explicit", "c", "normalize", "a\n5", "a five", "a five", "none"), ("a", "en", "auto", "c", "preserve", "x\ty", "x\ty", "x y", "none")], corpora.CORPUS)
    corpora.write_corpus(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, corpora.read_corpus(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, rows.collect()))
    corpora.write_corpus(rows.union(rows.limit(1)), str(tmp_path / "d"))
    with pytest.raises(ValueError):
        corpora.read_corpus(spark, str(tmp_path / "d"))


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("cases", "", "2"), ("mismatch", "x", "c:incorrect_or_partial")], "tag string, key string, value string")
    corpora.write_snapshot(rows, str(tmp_path / "s"))
    back = corpora.read_snapshot(spark, str(tmp_path / "s"))
    assert audit.same_rows(rows, back) and audit.difference(rows, back).count() == 0


def test_assets(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"abc")
    found = corpora.asset_hashes(spark, str(tmp_path / "m"))
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    manifest = spark.createDataFrame([("a.bin", good), ("b.bin", good)], "name string, sha256 string")
    assert [r.name for r in corpora.broken_assets(found, manifest).collect()] == ["b.bin"]


def test_arrow_functions(spark):
    from vocalis.udf import NumericCandidates, TokenSpans, normalize, normalize_frame, normalize_text, register

    texts = ["Pay $5 by 25:00", "no digits , here", None, "и т.д.", "C++ is 1st"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    full = {r.id: r.r for r in df.select("id", normalize(F.col("text")).alias("r")).collect()}
    short = {r.id: r.t for r in df.select("id", normalize_text(F.col("text")).alias("t")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert full[i] is None and short[i] is None
            continue
        want = process(t)
        assert full[i].normalized_text == want.normalized == short[i]
        assert full[i].pronunciation_text == want.pronunciation
        assert [tuple(w) for w in full[i].warnings] == want.warnings and [tuple(w) for w in full[i].words] == want.words
    assert "normalized_text" in normalize_frame(df).columns
    register(spark)
    assert NumericCandidates(F.lit("at 25:00"), F.lit("english")).collect()[0].surface == "25:00"
    assert [r.token for r in TokenSpans(F.lit("é x1.5")).collect()] == ["é", "x1.5"]
    assert [r.begin for r in spark.sql("select * from token_spans('é x1.5')").collect()] == [0, 3]


def test_streaming(spark, tmp_path):
    from vocalis.streaming.normalize import normalize_stream, warning_counts

    src = str(tmp_path / "in")
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "5 kg"), ("2024-01-01 00:02:00", "at 25:00"), ("2024-01-01 03:00:00", "9%")], "ts string, text string").select(F.to_timestamp("ts").alias("ts"), "text")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = normalize_stream(stream).writeStream.format("memory").queryName("spoken").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.normalized for r in spark.table("spoken").collect()} == {"five kilograms", "at 25:00", "nine percent"}
    q = warning_counts(spark.readStream.schema(rows.schema).parquet(src), "ts").writeStream.format("memory").queryName("codes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.code, r.n) for r in spark.table("codes").collect()] == [("unresolved_number", 1)]
    batch = normalize_stream(rows, options=Options(language="english"))
    assert batch.count() == 3


def test_plans_stay_in_the_jvm(spark, small):
    for name in ("en_currency", "ru_date", "token_frequency", "technical_spans_merged", "owner_asof"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "ArrowEval" not in plan
    scan = QUERIES["en_currency"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in scan


def test_phrases_of_any_number_match_letter_by_letter(spark):
    """More phrases than any pattern would hold, with marks between their words, against a plain search."""
    from vocalis.kernel.frontend import Entry
    from vocalis.operators import dictionary
    from vocalis.sources import dictionary as files

    words = [f"w{i}" for i in range(700)]
    entries = [Entry(f"{w} x{i}", f"p{i}", "phrase") for i, w in enumerate(words)] + [Entry("don't go", "stay", "phrase"), Entry("don't go on", "halt", "phrase"), Entry("a  b", "two", "phrase")]
    texts = ["I don't go on. don't  go, w5 x5 w699 x699 don't go", "a b a  b", "", None, "w3 x33 (w3 x3)", "é don't go é"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {(r.i, r.begin, r.end, r.pronunciation) for r in dictionary.match_phrases(df, files.frame(spark, entries), "i").collect()}
    place = lambda t, p: (len(t[: t.index(p)].encode()), len(t[: t.index(p)].encode()) + len(p.encode()))
    want = {(0, *place(texts[0], "don't go on"), "halt"), (0, *place(texts[0], "w5 x5"), "p5"), (0, *place(texts[0], "w699 x699"), "p699"), (0, 42, 50, "stay"), (1, *place(texts[1], "a  b"), "two"), (4, 8, 13, "p3"), (5, *place(texts[5], "don't go"), "stay")}
    assert got == want


def test_generator_takes_every_number(spark):
    from vocalis.sources.corpora import generate

    templates = spark.createDataFrame([("a", "%s x", "%s y"), ("b", "%s", "%s")], "category string, template string, spoken_template string")
    numbers = spark.range(10_050).selectExpr("cast(id as string) written", "cast(-id as string) spoken")
    out = generate(templates, numbers)
    assert out.count() == 20_100 and out.where("input = '10049 x' and expected = '-10049 y'").count() == 1
    assert generate(templates, numbers.limit(0)).count() == 0


def test_binary_texts(spark):
    rows = spark.createDataFrame([(1, bytearray("3 apples".encode())), (2, bytearray(b"\xff3")), (3, None)], "id int, data binary")
    got = {r["id"]: r["r"] for r in rows.select("id", normalize(F.col("data")).alias("r")).collect()}
    assert got[1]["normalized_text"] == "three apples" and not got[1]["warnings"]
    assert got[2]["normalized_text"] == "" and [(w["code"], w["length"]) for w in got[2]["warnings"]] == [("invalid_utf8", 2)]
    assert got[3] is None


def test_known_prefixes(spark):
    rows = spark.createDataFrame([("RTX9",), ("C++",), ("aRTX",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(known_prefix(F.col("t"))).collect()] == [True, True, False, False, None]


def test_sweeps_equal_joins(spark):
    rng = random.Random(3)
    sides = []
    for n in (120, 60):
        rows = [(rng.choice([1, 2, 3, None]), b := rng.randrange(200), b + rng.randrange(6)) for _ in range(n)]
        sides.append(rows + rows[:5])
    left, right = (spark.createDataFrame(s, "k int, begin int, end int") for s in sides)
    met = [any(k is not None and k == j and a < d and c < b for j, c, d in sides[1]) for k, a, b in sides[0]]
    tuples = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert tuples(spans.overlapping(left, right, "k")) == sorted([r for r, m in zip(sides[0], met) if m], key=str)
    assert tuples(spans.apart(left, right, "k")) == sorted([r for r, m in zip(sides[0], met) if not m], key=str)
    cells = {(k, p) for s in sides for k, a, b in s for p in range(a, b)}
    joined = spans.merge_streams(left, right, "k").collect()
    assert {(k, p) for k, a, b in joined for p in range(a, b)} == cells
    assert all((k, a - 1) not in cells and (k, b) not in cells for k, a, b in joined)


def test_only_wanted_fields_leave_the_normaliser(spark):
    df = spark.createDataFrame([("I have 5 cats",), (None,), ("",)], "text string")
    got = df.select(normalize(F.col("text"), fields=("normalized_text", "n_words", "warnings")).alias("r"))
    assert got.schema["r"].dataType.names == ["normalized_text", "n_words", "warnings"]
    assert [r["r"] and tuple(r["r"]) for r in got.collect()] == [("I have five cats", 4, []), None, ("", 0, [])]


def test_owners_are_found_inside_of_rows(spark):
    """No shuffle, so no task holds more than its own rows; rows with one key do not meet."""
    df = spark.createDataFrame([(1, "два 2. 3 for 4"), (1, "5"), (2, None)], "k int, text string")
    got = spans.owners(df, "k")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["number"], r["owner"]) for r in got.collect()) == [("2", "russian"), ("3", "english"), ("4", "english"), ("5", None)]


@pytest.mark.parametrize("name", ["normalize_synthetic_en", "normalize_synthetic_ru"])
def test_short_rows_are_dealt_before_python(spark, tmp_path, name):
    """One file of one row group is one task; the readers of its rows are not."""
    spark.range(2000).selectExpr("id AS p_partkey", "cast(id % 50 + 1 AS int) AS p_size", "id + 0.25 AS p_retailprice").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES[name](spark, str(tmp_path))
    tasks = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == 2000 and len(tasks) >= spark.sparkContext.defaultParallelism and max(tasks) <= 2000 // 8


def test_pipeline_settles_the_driver(spark, monkeypatch):
    """What ended queries hold in the driver goes before each stage: frames in cycles too, without waiting for Python."""
    import gc
    import weakref

    import corpus_pipeline
    from vocalis.llm.common import settle

    gc.disable()
    try:
        df = spark.range(3)
        df.itself, alive = df, weakref.ref(df)
        del df
        assert alive() is not None
        settle(spark)
        assert alive() is None
    finally:
        gc.enable()
    calls = []
    monkeypatch.setattr(corpus_pipeline, "settle", calls.append)
    docs = spark.createDataFrame([(i, f"some words of text {i}", "en", "web", 20) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("lines", "packing"):
        getattr(corpus_pipeline, name)(spark, docs, "/root/testdata/sf0.001")
    assert len(calls) == 2


def test_pipeline_settles_executors(spark, monkeypatch):
    """Where executors are not the driver, their collectors are asked as well."""
    from types import SimpleNamespace

    from vocalis.llm import common

    jvm = spark.sparkContext._jvm
    full = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName())
    before = full()
    common.settle_executors(spark)
    assert full() > before
    calls = []
    monkeypatch.setattr(common, "settle_executors", calls.append)
    for master in ("local[8]", "local-cluster[3,2,3000]", "yarn"):
        common.settle(SimpleNamespace(sparkContext=SimpleNamespace(master=master, _jvm=jvm)))
    assert len(calls) == 2


def test_pipeline_lines_run_no_python(spark, small, monkeypatch):
    """The stage of lines is DataFrame functions only, and so is what is run on a cluster's executors before it."""
    import corpus_pipeline

    def ran(stage, docs):
        store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
        known = lambda: {e.executionId(): e.physicalPlanDescription() for e in map(store.executionsList().apply, range(store.executionsList().size()))}
        bus.waitUntilEmpty(30_000)
        before = known()
        stage(spark, docs, small).write.format("noop").mode("overwrite").save()
        bus.waitUntilEmpty(30_000)
        plans = [p for k, p in known().items() if k not in before]
        return [p for p in plans if "java.lang.System" in p], [p for p in plans if re.search("Python|Pandas|Arrow", p)]

    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,3000]")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    asked, python = ran(corpus_pipeline.lines, docs)
    assert len(asked) == 1 and not python
    asked, python = ran(corpus_pipeline.benchmark, docs)
    assert len(asked) == 1 and any("_settled(" in p for p in python)  # workers are settled where Python runs
