"""Subwords, bags, rules by context, assets, and diagnostics of streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalis.kernel import stress
from vocalis.kernel.frontend import Entry
from vocalis.operators import contexts, subwords
from vocalis.sources import assets, dictionary
from vocalis.streaming.normalize import distinct_warnings, read_tokens


def test_longest_pieces_against_the_walk(spark):
    r = random.Random(6)
    words = ["", "a", "zzz", *["".join(r.choice("abcé") for _ in range(r.randrange(1, 12))) for _ in range(300)], "ab" * 200]
    vocabulary = {p: i for i, p in enumerate(sorted({"[UNK]", "a", "b", "##a", "##b", "##c", *["".join(r.choice("abcé") for _ in range(r.randrange(1, 5))) for _ in range(40)], *["##" + "".join(r.choice("abcé") for _ in range(r.randrange(1, 6))) for _ in range(60)]}))}
    names = {i: p for p, i in vocabulary.items()}
    df = spark.createDataFrame([(w,) for w in [*words, *words[:20], None]], "word string")
    got = {x["word"]: x["pieces"] for x in subwords.longest_pieces(df, spark.createDataFrame([(p, 1) for p in vocabulary], "piece string, at int")).collect()}
    assert got == {w: [names[i] for i in stress.pieces(w, vocabulary)] for w in words}
    assert subwords.longest_pieces(df.limit(0), spark.createDataFrame([], "piece string")).collect() == []


def test_bags_against_the_kernel(spark):
    r = np.random.default_rng(7)
    words = ["aba", "abab", "b", "", "xyz", "aaaaaaa"]
    grams = {g: r.normal(size=4).astype(np.float32) for w in ("abab", "aaaa", "b") for g in stress.grams(w)}
    df = spark.createDataFrame([(w,) for w in [*words, "aba", None]], "word string")
    table = spark.createDataFrame([(g, v.tolist()) for g, v in grams.items()], "gram string, vector array<float>")
    got = {x["word"]: x for x in subwords.bag_vectors(df, table, 4).collect()}
    assert set(got) == set(words)
    for w in words:
        assert np.allclose(got[w]["vector"], stress.embed(w, grams, 4), atol=1e-6)
        assert got[w]["n_known"] == sum(g in grams for g in stress.grams(w))


def test_rules_against_brute_force(spark):
    r = random.Random(8)
    rows = [(k, i, r.choice(["a", "b", "c", None])) for k in range(20) for i in range(r.randrange(1, 12))]
    rules = [(i, r.choice("ab"), r.choice(["a", "b", "c", None]), r.choice(["a", "b", "c", None]), f"r{i}") for i in range(12)]
    out = contexts.apply_rules(spark.createDataFrame(rows, "k int, pos int, token string"), spark.createDataFrame(rules, "ord int, token string, left string, right string, said string"), "k", "pos")
    got = {(x["k"], x["pos"]): x["rule"] for x in out.collect()}
    at = {(k, i): t for k, i, t in rows}
    for (k, i), t in at.items():
        fit = [((left is None) + (right is None), left is None, o) for o, tok, left, right, _ in rules if tok == t and left in (None, at.get((k, i - 1))) and right in (None, at.get((k, i + 1)))]
        fit = [f for f in fit if f]
        assert got[k, i] == (min(fit)[2] if fit else None)


def test_assets_are_read_or_refused(spark, tmp_path):
    values = np.arange(10_000 * 3, dtype="<f4").reshape(-1, 3)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.f32").write_bytes(values.tobytes())
    (tmp_path / "m" / "b.f32").write_bytes(b"")
    rows = assets.read_matrix(spark, str(tmp_path / "m"), 3)
    assert rows.count() == 10_000 and rows.where("row = 9999").first()["vector"] == values[9999].tolist()
    with pytest.raises(ValueError, match="a.f32"):
        assets.read_matrix(spark, str(tmp_path / "m"), 7)
    (tmp_path / "nan.f32").write_bytes(np.array([1, np.nan], "<f4").tobytes())
    with pytest.raises(Exception, match="not finite"):
        assets.read_matrix(spark, str(tmp_path / "nan.f32"), 2).collect()
    (tmp_path / "v.txt").write_text("a\n##b\r\n\nc", encoding="utf-8")
    assert sorted(tuple(x) for x in assets.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()) == [("##b", 1), ("a", 0), ("c", 3)]
    (tmp_path / "w.txt").write_text("a\nb\na\n")
    with pytest.raises(ValueError, match="twice"):
        assets.read_vocabulary(spark, str(tmp_path / "w.txt"))
    (tmp_path / "p.tsv").write_text("замок\tз+амок\tзам+ок\nмука\tм+ука\tмук+а\n", encoding="utf-8")
    assert sorted(assets.read_pairs(spark, str(tmp_path / "p.tsv"), "first", "second").collect())[0]["second"] == "зам+ок"
    for broken, why in (("a\tb\n", "fields"), ("a\t\tb\n", "fields"), ("a\tb\tc\na\td\te\n", "twice")):
        (tmp_path / "q.tsv").write_text(broken)
        with pytest.raises(ValueError, match=why):
            assets.read_pairs(spark, str(tmp_path / "q.tsv"), "first", "second")


def test_streams_tell_each_diagnostic_once(spark, tmp_path):
    """Three files, one a batch: repeats within the watermark go, and so do rows that come later than it."""
    src = tmp_path / "in"
    src.mkdir()
    batches = [[("2024-01-01 00:00:00", 1, "at 25:00"), ("2024-01-01 00:01:00", 1, "at 25:00"), ("2024-01-01 00:01:00", 2, "at 25:00 26:00")], [("2024-01-01 00:05:00", 1, "at 25:00"), ("2024-01-01 09:00:00", 3, "26:00 5 kg")], [("2024-01-01 00:06:00", 9, "at 25:00"), ("2024-01-01 09:00:01", 1, "at 25:00")]]
    schema = "ts timestamp, k int, text string"
    entries = dictionary.frame(spark, (Entry("at", "aht"), Entry("kg", "kay gee", "folded")))
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))
    q = distinct_warnings(stream(), "ts", "k").writeStream.format("memory").queryName("once").outputMode("append").start()
    for rows in batches:
        df = spark.createDataFrame(rows, "ts string, k int, text string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(src))
        q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], r["offset"]) for r in spark.table("once").collect()) == [(1, 3), (1, 3), (2, 3), (2, 9), (3, 0)]
    q = read_tokens(stream(), entries, "k").writeStream.format("memory").queryName("said").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], r["pronunciation"]) for r in spark.table("said").collect()) == [(1, "aht")] * 4 + [(2, "aht"), (3, "kay gee"), (9, "aht")]
