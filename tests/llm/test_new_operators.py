"""Byte-level BPE, spelling variants and hard negatives against brute force, with awkward rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from vocalis.llm import byte_bpe, hard_negatives, registry, spelling

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def odd_texts():
    r = random.Random(1)
    mixed = lambda n: "".join(chr(r.choice((r.randrange(1, 0x250), r.randrange(0x400, 0x500), r.randrange(0x3000, 0x9000), r.randrange(0x1F300, 0x1F600)))) for _ in range(n))
    return [None, "", " ", "a" * 5000, " " * 777 + "x", "=" * 500 + "ab" * 300, "\r\n" * 301, "".join(r.choice("abcdefgh") for _ in range(3000)), "日本語" * 50 + "😀" * 20, *[mixed(n) for n in (1, 7, 80, 2000)], "hello world's  end\t\t x <|endoftext|>", "word " * 50_000]


# Operator 11


def test_bpe_equals_the_library(spark, own):
    texts = odd_texts() + odd_texts()[:4]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "i int, text string, w string, _text string")
    coded = byte_bpe.encode(df, PATH, public_tokenizers.PATTERN, keep=["i", "w", "_text"], data="back")
    rows = {r["i"]: r for r in coded.collect()}
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == own.encode_ordinary(t or "")
        assert bytes(rows[i]["back"]) == (t or "").encode()
    assert byte_bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN, keep=["i"]).collect() == []
    with pytest.raises(ValueError):
        byte_bpe.encode(df, PATH, public_tokenizers.PATTERN, keep=["i"], ids="I")


def test_decoding_of_any_ids(spark, own):
    rows = [(0, [31373, 995]), (1, []), (2, None), (3, [5, None]), (4, [99_999_999]), (5, [10_263, 99]), (6, list(range(50_000)))]
    got = {r["i"]: r["decoded"] for r in byte_bpe.decode(spark.createDataFrame(rows, "i int, ids array<int>"), PATH, public_tokenizers.PATTERN, keep=["i"]).collect()}
    for i, ids in rows:
        want = None if ids is None or None in ids or max(ids, default=0) > 60_000 else own.decode_bytes(ids)
        assert (got[i] if got[i] is None else bytes(got[i])) == want


def test_bpe_query_over_whole_documents(spark, small, own):
    got = {r["doc_id"]: r for r in registry.op11_byte_bpe(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc, text in docs:
        ids = own.encode_ordinary(text or "")
        assert got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_words_come_back_from_the_older_generation(monkeypatch, own):
    monkeypatch.setattr(byte_bpe, "MEMORY_WORDS", 20)
    coder = byte_bpe.Codec(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for k in range(6):
        texts = [f"the recurrent zzqx{k * 100 + i} wqords" for i in range(15)]
        assert [x.tolist() for x in coder.encode(texts)] == [own.encode_ordinary(t) for t in texts]


# Operator 12


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_brute(counts):
    out, form = {}, {}
    for w, n in counts.items():
        close = sorted((-m, x) for x, m in counts.items() if near(w, x))
        form[w] = close[0] if close and -close[0][0] >= 2 * n else None
        out[w] = len(close)
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root][1]
        rows.add((w, n, out[w], form[w] and form[w][1], form[w] and -form[w][0], root))
    return rows


def awkward_words(seed=2):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.choice((5, 6, 7, 9)))) for _ in range(60)]
    base += ["aaaaaa", "aaaaa", "aaaaaaa", "aabbbaa", "a" * 64, "a" * 65, "a" * 66, "x" * 300, "x" * 150 + "y" + "x" * 149, "x" * 301, "q" * 66, "q" * 65 + "r", "r" + "q" * 65]
    words = set(base)
    for w in base * 3:
        i = r.randrange(len(w))
        words.add(r.choice((w[:i] + w[i + 1 :], w[:i] + r.choice("abcéx") + w[i:], w[:i] + r.choice("abcéx") + w[i + 1 :])))
    return {w: r.choice((3, 3, 4, 6, 8, 20, 100, 100)) for w in words}


def test_variants_against_brute_force(spark):
    counts = awkward_words()
    df = spark.createDataFrame([(w, n, "x", "y") for w, n in counts.items()], "word string, n long, key string, root string")
    got = spelling.variants(df)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(counts) and set(rows) == variants_brute(counts)
    assert spelling.variants(df.limit(0)).collect() == []


def test_runs_and_planted_misspellings(spark):
    texts = [(1, "Haus HAUS häuser ÄRGER x1y foo_bar " * 4), (2, None), (None, "Straße strasse straße " * 3), (3, ""), (1, "Haus " * 3), (4, "langeswort " * 5000), *[(i, "gelegentlich wieder einmal") for i in range(100, 400)]]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, word string")
    words = spelling.document_words(df).select(spelling.misspelt(F.col("word"), F.col("doc_id")).alias("word"))
    got = {r["word"]: r["n"] for r in spelling.vocabulary(words).collect()}
    want = Counter()
    for i, t in texts:
        run = ""
        for c in (t or "") + "\0":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                at = h % len(run)
                want[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert sum(w not in ("haus", "gelegentlich", "wieder", "einmal") for w in want) > 5


# Operator 13


def negatives_brute(rows, positives=5, negatives=5):
    best = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        key = (label, [float(v) for v in x])
        if i not in best or key < best[i]:
            best[i] = key
    whole = {i: (label, [int(v * 256 // 1) if abs(v) < 2**40 else int(v) * 256 for v in x]) for i, (label, x) in best.items()}
    out = []
    for a, (label, q) in whole.items():
        if a % 100:
            continue
        score = {i: max(-(2**63), min(2**63 - 1, sum(u * v for u, v in zip(q, x)))) for i, (_, x) in whole.items()}
        mine = sorted((i for i, (other, _) in whole.items() if other == label and i != a), key=lambda i: (-score[i], i))[:positives]
        for p in mine:
            fits = sorted((i for i, (other, _) in whole.items() if other != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]), key=lambda i: (-score[i], i))
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:negatives])]
    return sorted(out)


def vectors(seed, n=500, d=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, d))
    rows = [(int(i), int(r.integers(0, 4)), (0.3 * (centres[r.integers(0, 4)] + 0.4 * r.normal(size=d))).astype(np.float32).tolist()) for i in range(n)]
    same = rows[3][2]
    return rows + [(n + i, int(i % 3), same) for i in range(150)]  # many ties


@pytest.mark.parametrize("cells, block", [(1 << 19, 512), (300, 2)])
def test_negatives_against_brute_force(spark, monkeypatch, cells, block):
    """In one chunk, and in many small ones."""
    monkeypatch.setattr(hard_negatives, "CHUNK_CELLS", cells)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    rows = vectors(1)
    rows += [(None, 1, rows[0][2]), (700, None, rows[0][2]), (701, 1, None), (702, 1, [1.0, None]), (703, 1, [float("nan")]), (800, 1, [float("inf")]), (5, 0, rows[9][2]), rows[7], (900, 2, []), (1000, 1, [0.5, -0.25]), (1001, 1, [9.0] * 3)]
    df = spark.createDataFrame([(*x, "a", "b") for x in rows], "vec_id long, label int, embedding array<float>, x string, ps string")
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df).collect())
    assert got == negatives_brute(rows) and len(got) > 50
    assert hard_negatives.hard_negatives(df.limit(0)).collect() == []


def test_wide_numbers_stay_exact(spark):
    rows = [(0, 1, [2.0**40, 1.0]), (1, 1, [2.0**9, 0.5]), (2, 2, [2.0**9, 0.25]), (3, 2, [2.0**9 * 0.9, -7.0]), (4, 1, [-1.0, 2.0**44]), (5, 2, [2.0**9, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(df).collect()) == negatives_brute(rows)


def test_intervals_only_drop_what_cannot_qualify():
    r = np.random.default_rng(5)
    queries, rows = r.integers(-200, 200, (7, 20)), r.integers(-300, 300, (90, 20))
    allowed = r.random((7, 90)) < 0.8
    exact = queries @ rows.T
    for q, left, scores in hard_negatives.narrowed(queries, rows, allowed, lambda q, low, high: high >= 10_000):
        assert left.tolist() == np.flatnonzero(allowed[q] & (exact[q] >= 10_000)).tolist()
        assert scores.tolist() == exact[q, left].tolist()


# Operator 6: ties


def test_chats_with_ties_and_repeats_equal_their_sql(spark):
    import duckdb
    import pandas as pd

    from vocalis.llm import chat

    r = random.Random(8)
    rows = []
    for k in range(12):
        rows += [(2 * k, 1, "u", f"b{k}"), (2 * k + 1, 1, "u", f"a{k}"), (2 * k + 1, 1, "u", f"b{k}")]
    for k in range(100, 180):
        rows += [(k, t, r.choice("uv"), r.choice(["x", "y", "", "long " * 2000])) for t in (1, 1, 2, 3)[: r.randrange(1, 5)]]
    rows += [(200, 1, "u", "x"), (200, 1, "u", "x"), (201, 1, "u", "x"), (None, 1, "u", "x"), (202, None, "u", "x")]
    got = sorted(tuple(x) for x in chat.render_chats(spark.createDataFrame([(*x, "h") for x in rows], "conv_id long, turn int, role string, text string, h string")).select("conv_id", "n_turns", "text").collect())
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    want = sorted(duckdb.sql(f"SELECT conv_id, n_turns, text FROM ({registry.OP6_SQL})").fetchall())
    assert [(a, b) for a, b in zip(got, want) if a != b][:1] == [] and len(got) == len(want)
