"""The ten corpus operators against brute force, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vocalis.llm import boosting, chat, common, components, decontaminate, jaccard_join, language, line_dedup, merkle, packing, pii, registry, secrets, shingles, url_filter

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, h string, s string, n string, row string, c string, kind string, label string, th string"


def frame(spark, rows):
    """Documents with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "en", src, *["x"] * 8) for i, t, src in rows], SCHEMA)


def awkward():
    same = "one Line that is certainly long enough\nshort\nAND another line long enough as well"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, same), (5, same.upper()), (6, same), (6, same), (7, same), (None, same), (8, "word " * 20_000), (9, "né à l'été"), (10, "a b")]
    return [(i, t, f"src{k % 2}") for k, (i, t) in enumerate(rows)]


def similar(seed, n=120):
    """Texts in groups of near copies of differing closeness."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.7:
            words = list(out[r.randrange(len(out))])
            for _ in range(r.choice((0, 1, 1, 2, 3, 5))):
                words[r.randrange(len(words))] = r.choice(WORDS)
        else:
            words = [r.choice(WORDS) for _ in range(r.choice((4, 30, 60, 120)))]
        out.append(words)
    return [(i, " ".join(w), "src0") for i, w in enumerate(out)]


def shingle_brute(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups_brute(rows):
    sets = [shingle_brute(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[top(i)] = top(j)
    best = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        best[top(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in best.items()}
    return sorted(((d, len(sets[i]), least[top(i)] if sets[i] else d) for i, (d, *_) in enumerate(rows)), key=str)


@pytest.mark.parametrize("pivots", [0, 20, 256])
@pytest.mark.parametrize("rows", [similar(1), awkward(), []], ids=["similar", "awkward", "empty"])
def test_jaccard_join(spark, monkeypatch, rows, pivots):
    """No sets covered by pivots, some, or nearly all."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    got = jaccard_join.similar_groups(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == groups_brute(rows)


@pytest.mark.parametrize("pivots", [0, 6, 256])
def test_jaccard_join_of_a_frequent_group(spark, monkeypatch, pivots):
    """Many loose copies of one text with every threshold low, so regions recurse and split into chunks."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard_join, "FREQUENT", (2, 4, 8, 16))
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    r = random.Random(5)
    base = [r.choice(WORDS) for _ in range(100)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.choice((1, 2, 3, 4, 6, 9))):
            words[r.randrange(100)] = r.choice(WORDS)
        rows.append((i, " ".join(words), "src0"))
    got = jaccard_join.similar_groups(frame(spark, rows)).collect()
    assert sorted((tuple(x) for x in got), key=str) == groups_brute(rows)


def test_voronoi_regions_hold_all_links_of_their_sets():
    """Every link of a covered set lies in its nearest pivot's region, with boundary sets replicated."""
    texts = [t for _, t, _ in similar(7, 200)]
    sets = list(shingles.shingle_sets(texts))
    cells = jaccard_join.Cells([x.tobytes() for x in sets[::9] if len(x)], 80)
    entered = [cells.enter(x) for x in sets]
    seen = 0
    for i, x in enumerate(sets):
        covered, into, same = entered[i]
        for p, n in zip(into, same):
            pivot = next(y for y in sets if len(y) and shingles.set_id(y) == cells.ids[p])
            assert n == len(np.intersect1d(x, pivot))
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            if covered and i != j and len(y) and 5 * both >= 4 * (len(x) + len(y) - both):
                nearest = into[np.argmin([1 - n / (len(x) + cells.sizes[p] - n) for p, n in zip(into, same)])]
                assert nearest in entered[j][1]
                seen += 1
    assert seen > 50


def test_sketch_bounds_the_difference():
    r = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(r.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[: r.integers(0, 300)], r.integers(0, 2**63, 50).astype(np.uint64)]))
        x, y = (np.frombuffer(jaccard_join.sketch(v), np.uint64) for v in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_shingle_sets_cut_long_texts_at_spaces(monkeypatch):
    texts = ["A  b\tC d e f", None, "", "x y", "ü " * 50, "q" * 500 + " r s t u v"]
    whole = [x.tolist() for x in shingles.shingle_sets(texts)]
    monkeypatch.setattr(shingles, "STEP", 16)
    assert [x.tolist() for x in shingles.shingle_sets(texts)] == whole
    assert [len(x) for x in whole] == [len(shingle_brute(t)) for t in texts]


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (3, 2), (20, 20)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(4, 10), 4), 2: 2, 3: 2}


def test_components_of_a_long_path(spark):
    ids = random.Random(11).sample(range(10**6), 1000)
    got = {r.v: r.label for r in components.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()}
    assert got == dict.fromkeys(ids, min(ids))


def test_jaccard_join_of_a_drifting_chain(spark):
    """1000 documents of which each is similar to the next only."""
    texts = [" ".join(f"v{k}" for k in range(20 * i, 20 * i + 200)) for i in range(1000)]
    got = jaccard_join.similar_groups(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    assert len(got) == 1000 and {r.component_id for r in got} == {0}


def lines_brute(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(d)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= 3}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [awkward(), []], ids=["awkward", "empty"])
def test_line_dedup(spark, rows):
    out = line_dedup.dedup_lines(frame(spark, rows))
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == lines_brute(rows)
    clash = frame(spark, rows).withColumns({"_d": F.lit(1), "_h": F.lit(1), "_m": F.lit(1), "n_lines": F.lit("x"), "keep_words": F.lit("x")})
    again = line_dedup.dedup_lines(clash)
    assert sorted(again.columns) == sorted([*clash.columns, "n_dropped"])
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped) for r in again.collect()) == sorted((r.doc_id or -1, r.n_lines, r.n_dropped) for r in out.collect())


def test_lines_of_one_repeated_document(spark):
    """A null doc_id and one doc_id with many different texts that share a line; lines beyond a bitmap's word."""
    line = "a common line of more than twenty characters"
    rows = [(None, f"{k}\n{line}", "a") for k in range(50)] + [(7, f"{k}\n{line}\n{line}", "a") for k in range(50)] + [(i, "\n".join([str(i), *["x"] * 70, line, *["y"] * 70, line]), "a") for i in range(3)]
    out = line_dedup.dedup_lines(frame(spark, rows))
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == lines_brute(rows)


def test_caseless_is_injective_up_to_case(spark):
    texts = ["É", "é", "ã©", "Ã©", "AbC", "abc", "ÿ", "ß", "ДД", "дд", "\u00c3\u00a9x", "\U0001f600"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(common.caseless(F.col("t"))).collect()]
    lower = [t.translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    assert all((got[i] == got[j]) == (lower[i] == lower[j]) for i in range(len(texts)) for j in range(len(texts)))


def contamination_brute(rows, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for d, t, *_ in rows:
        w = words(t)
        hit, ids = set(), set()
        for name, text in items:
            v = words(text)
            k = min(10, len(v))
            for i in range(len(v) - k + 1) if v else ():
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == v[i : i + k]:
                        hit.update(range(j, j + k))
                        ids.add(str(name))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark):
    r = random.Random(2)
    items = [(10, " ".join(r.choice(WORDS) for _ in range(25))), (9, "Two words"), (8, None), (7, "..."), (9, "Two words")]
    rows = [(1, None, "a"), (2, "", "a"), (3, "two, WORDS! two words", "a"), (4, "x " + items[0][1].upper() + " y", "a"), (5, " ".join(items[0][1].split()[3:14]), "a"), (5, " ".join(items[0][1].split()[3:12]), "a"), (None, "x" * 5000, "a")]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    one = decontaminate.contamination(docs, bench, keep=["doc_id"])
    assert sorted((tuple(x) for x in one.select(columns).collect()), key=str) == contamination_brute(rows, items)
    many = decontaminate.contamination(docs.withColumn("_hits", F.lit(1)).withColumn("_h", F.lit(1)).withColumn("n_hit", F.lit("x")), bench, block_words=12)
    assert sorted((tuple(x) for x in many.select(columns).collect()), key=str) == contamination_brute(rows, items)
    assert "_hits" in many.columns and many.columns.count("n_hit") == 1
    key = lambda df: sorted((str(x.doc_id), x.items_sha256, [tuple(v) for v in x.spans]) for x in df.collect())
    assert key(many) == key(one)
    spans = {x.doc_id: [tuple(s) for s in x.spans] for x in one.collect()}
    assert spans[3] == [(0, 10), (12, 21)] or spans[3] == [(0, 21)]
    assert spans[4] == [(2, 2 + len(items[0][1]))]
    none = decontaminate.contamination(docs, bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_long_items_are_cut_into_segments(spark):
    """One item of more words than a block, in blocks of every size, against one block."""
    r = random.Random(8)
    item = [r.choice(WORDS) for _ in range(90)]
    rows = [(i, " ".join(["x", *item[a : a + 14], "y"]), "a") for i, a in enumerate(range(0, 80, 3))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[5:16]))], "item_id long, text string")
    for block_words in (10, 13, 40):
        got = decontaminate.contamination(frame(spark, rows), bench, block_words=block_words, keep=["doc_id"])
        assert sorted((tuple(x)[:4] + tuple(x)[5:7] for x in got.collect()), key=str) == sorted(((d, n, h, k, s, c) for d, n, h, k, s, c in contamination_brute(rows, [(1, " ".join(item)), (2, " ".join(item[5:16]))])), key=str)


def secrets_brute(t):
    out = []
    word = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    out += [(m.start(), 0, "assign", m.end()) for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


SECRETS = ["password = 'abc' token:abcdefgh", "é PassWd=zzzzzzz APIKEY: \"q1w2e3r4\"", "AKIA" + "A" * 16 + "aAKIA" + "Z9" * 10, "x" + "0123456789abcdef" * 3 + "G" + "f" * 24, "token==" + "y" * 9 + " secret" + " " * 3000 + "=" + "k" * 8, "f" * 100_000, "tokentoken=abcdef.api_key=token=abcdef", None, ""]


def test_secrets_keep_the_base_spans(spark):
    rows = [(i, t, f"src{i % 3}") for i, t in enumerate(SECRETS)] + [(0, SECRETS[0], "src0")]
    found = secrets.secret_digest(secrets.scan_secrets(frame(spark, rows))).collect()
    assert sorted((r.doc_id, r.base_sha256) for r in found) == sorted((i, hashlib.sha256(secrets_brute(t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert secrets.scan_secrets(frame(spark, [])).count() == 0


def test_secrets_of_one_owner_are_live_and_shared_ones_are_copies(spark):
    live, shared = "Zx9Kq2Lm7Pv4Rt8Wy3Bn5", "Aa1Bb2Cc3Dd4Ee5Ff6Gg7"
    rows = [(1, f"use {live} here", "a"), (2, f"use {shared} here", "a"), (3, f"and {shared} there", "b"), (4, "password=hunter22", "a"), (5, "password=hunter22", "b")]
    got = {r.doc_id: r for r in secrets.secret_digest(secrets.scan_secrets(frame(spark, rows))).collect()}
    assert got[1].spans == "live:4:25" and got[1].n_live == 1
    assert got[2].spans == "" and got[3].n_live == 0
    assert (got[4].n_copied, got[4].n_owned) == (1, 0)


def test_secrets_of_one_owner_are_live_in_many_repositories(spark):
    live, shared = "Zx9Kq2Lm7Pv4Rt8Wy3Bn5", "550e8400-e29b-41d4-a716-446655440000"
    rows = [(i, f"use {live} here", f"src{i % 2}") for i in range(50)] + [(100 + i, f"copy {i} of {shared}", "a") for i in range(60)]
    got = {r.doc_id: r for r in secrets.secret_digest(secrets.scan_secrets(frame(spark, rows))).collect()}
    assert all(got[i].spans == "live:4:25" for i in range(50)) and all(got[100 + i].n_live == 1 for i in range(60))


def live_brute(rows):
    """(doc_id, live spans, values) by counting over the whole corpus in memory."""
    taken, wide = {}, {}
    for k, (_, t, _) in enumerate(rows):
        t = t or ""
        found = [x.split(":") for x in secrets_brute(t).split(",") if x]
        value = lambda kind, a, b: re.search(r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)\Z", t[a:b])[1] if kind == "assign" else t[a:b]
        taken[k] = [(int(a), int(b), value(kind, int(a), int(b))) for kind, a, b in found]
        ok = lambda w: len(re.findall("[0-9][A-Za-z]", w)) >= 3 and len(set(w)) >= 10
        wide[k] = [(m.start(), m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t) if ok(m[0]) and not any(a < m.end() and m.start() < b for a, b, _ in taken[k])]
    holders, by_text = defaultdict(set), defaultdict(dict)
    for k, (d, t, owner) in enumerate(rows):
        for _, _, v in taken[k] + wide[k]:
            holders[v].add((owner, d))
            by_text[v][t] = min(by_text[v].get(t, (owner, str(d))), (owner, str(d)))
    out = []
    for k, (d, _, _) in enumerate(rows):
        live = [(a, b) for a, b, v in wide[k] if len({o for o, _ in by_text[v].values()}) <= 1]
        values = [(a, b, len({o for o, _ in holders[v]}), len(holders[v]), len({o for o, _ in holders[v]}) > 1) for a, b, v in taken[k]]
        values += [(a, b, len({o for o, _ in holders[v]}), len(holders[v]), False) for a, b, v in wide[k] if (a, b) in live]
        out.append((d, sorted(live), sorted(values)))
    return sorted(out, key=str)


def test_secrets_against_brute_force(spark):
    r = random.Random(6)
    tokens = ["".join(r.choice("abcdef0123456789XY-") for _ in range(r.randrange(18, 30))) for _ in range(12)] + ["release-2020-01-01-final-notes", "a" * 30, "AKIA" + "Q2" * 9]
    rows = [(i, " ".join(r.choice(("x", "token = ", "password:")) + r.choice(tokens) for _ in range(r.randrange(4))) if r.random() > 0.1 else None, f"s{r.randrange(3)}") for i in range(80)]
    rows += rows[:9] + [(None, rows[3][1], "s9")]
    got = [(x.doc_id, sorted((s.begin, s.end) for s in x.live), sorted((v.begin, v.end, v.n_owners, v.n_repos, v.copied) for v in x["values"])) for x in secrets.scan_secrets(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == live_brute(rows)


def pii_brute(t):
    def luhn(x):
        return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(x)) for v in [int(c) * (1 + i % 2)]) % 10 == 0

    only = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(only(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


CARD = "4111111111111111"
PII = ["ü a.b@c.d_e@f.gh x@y z@1-2.3.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", f"{CARD} 4111 1111-1111 1111 4111111111111112 {CARD}{CARD}", "+1 (555) 123-4567 +12 +1 234 ", f"+1 (555) 123-4567 {CARD}", "7" * 60_000, "a" * 60_000, "1." * 20_000, None, ""]


def test_pii_keeps_the_base_spans(spark):
    rows = [(i, t, "a") for i, t in enumerate(PII)] + [(0, PII[0], "a")]
    found = pii.pii_digest(pii.find_pii(frame(spark, rows))).collect()
    assert sorted((r.doc_id, r.base_sha256) for r in found) == sorted((i, hashlib.sha256(pii_brute(t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_pii_finds_what_a_greedy_pattern_swallowed(spark):
    rows = [(i, f"card {CARD} end", "a") for i in range(30)] + [(100, f"call +1 (555) 123-4567 {CARD} now", "a"), (101, "number 4111111111111112 only", "a")]
    got = {r.doc_id: r.spans for r in pii.pii_digest(pii.find_pii(frame(spark, rows))).collect()}
    assert "card:23:39" in got[100].split(",")
    assert got[101] == ""


def test_pii_adds_what_no_base_pattern_takes(spark):
    rows = [(1, "call (555) 123-4567 today", "a"), (2, "mail joe.doe [at] mail7.org please", "a"), (3, "order 555-123-4567 is late", "a"), (4, "version 1.2.3.400 is out", "a"), (5, None, "a"), (6, "tel 555-123-4567, fax 555-123-4568", "a"), (6, "tel 555-123-4567, fax 555-123-4568", "a"), (None, "", "a")]
    got = sorted((str(r.doc_id), r.spans, r.n_added, r.n_spans) for r in pii.pii_digest(pii.find_pii(frame(spark, rows))).collect())
    six = ("6", "phone:4:16,phone:22:34", 2, 2)
    assert got == [("1", "phone:5:19", 1, 1), ("2", "email:5:27", 1, 1), ("3", "", 0, 0), ("4", "", 0, 0), ("5", "", 0, 0), six, six, ("None", "", 0, 0)]


def test_pii_meets_its_precision_on_held_out_examples(spark):
    seen = pii.examples(spark)
    score, test = pii.learned(seen, pii.PRECISION)
    held = seen.where("held").withColumn("score", F.expr(score)).withColumn("hit", F.expr(test))
    got = held.groupBy("kind").agg(F.sum("y").alias("pos"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & (F.col("y") == 1)).alias("right")).collect()
    assert len(got) == 4 and all(r.pos > 50 and r.right >= pii.PRECISION * r.hits and r.right >= 0.9 * r.pos for r in got)


def test_boosting_learns_and_calibrates():
    x = np.array([[a, b] for a in range(4) for b in range(4)])
    n = np.full(16, 50.0)
    pos = np.where((x[:, 0] > 1) & (x[:, 1] <= 1), 49.0, 1.0)
    trees, margin = boosting.fit(x, n, pos)
    cut = boosting.calibrated(margin, n, pos, 0.9)
    assert ((margin >= cut) == (pos == 49)).all()
    assert np.isinf(boosting.calibrated(margin, n, np.zeros(16), 0.9))
    assert "if(" in trees[0].sql(["a", "b"])


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/x", "http://www.example.com/en/", "http://m.www.example.com/en/1?q=/", "https://x.net/es/", "https://x.net/de/", "https://x.netx/es/", "http://com", "http://com/", "no scheme", None, "x://h?://b/c", "http://q.org#/en/"]
    rows = [(i, u, "<a href='http://x.net/'>") for i, u in enumerate(urls)]
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("m.www.example.com", "/en/1", "www.example.com/en/"), ("x.net", "/es/", "net/es/"), ("x.net", "/de/", None),
        ("x.netx", "/es/", None), ("com", "", None), ("com", "/", "com/"), ("", "", None), ("", "", None), ("h", "", None), ("q.org", "", None),
    ]


def test_distrust_flows_backwards(spark):
    bad = [(i, "http://bad.net/es/1", "") for i in range(9)]
    far = [(30 + k, f"http://c{k}.org/", f"<a href='//C{k + 1}.org/'>") for k in range(12)] + [(42, "http://c12.org/", "<A HREF = http://bad.net/es/>")]
    rows = [*bad, (20, "http://bad.net/x", ""), (21, "http://farm.org/", "<a HREF=\"HTTP://Bad.NET/x\">"), (22, "http://fine.org/", "see bad.net <a href='https://good.com?q'>"), (23, "http://good.com/", None), (24, "http://lone.org/", "<a href='//gone.org'><a href='//bad.net'><a href='//good.com'>"), *far]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[20], got[21], got[22], got[23], got[42], got[30]) == ("block", "block", "allow", "allow", "block", "allow")
    scores = {r.host: (r.trust, r.distrust) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    edges = {("farm.org", "bad.net"), ("fine.org", "good.com"), ("lone.org", "gone.org"), ("lone.org", "bad.net"), ("lone.org", "good.com"), ("c12.org", "bad.net"), *((f"c{k}.org", f"c{k + 1}.org") for k in range(12))}
    seeds = {"good.com": (100_000, 0), "bad.net": (0, 90_000)}
    want = {}
    for way, links in ((0, edges), (1, {(b, a) for a, b in edges})):
        now = {h: seeds.get(h, (0, 0))[way] // 2 for e in edges for h in e}
        for _ in range(200):
            out = {h: sum(1 for a, _ in links if a == h) for h in now}
            now = {h: (15 * seeds.get(h, (0, 0))[way] + 85 * sum(now[a] * (1_000_000 // out[a]) // 1_000_000 for a, b in links if b == h)) // 100 for h in now}
        want[way] = now
    assert all(v == (want[0][h], want[1][h]) for h, v in scores.items())
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chats_collapse_to_maximal_ones(spark):
    say = lambda c, *turns: [(c, i, "user" if i % 2 == 0 else "bot", t, "x") for i, t in enumerate(turns)]
    rows = say(1, "hi", "yo") + say(2, "hi", "yo", "so") + say(3, "hi") + say(4, "hi", "yo", "so") + say(5, "hi", "no") + say(6, "") + [(None, 0, "user", "hi", "x"), (7, None, "user", "hi", "x"), (8, 0, None, None, "x")]
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.render_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h string")).collect()}
    assert set(got) == {2, 5, 6, 8}
    assert got[5] == (2, "<|user|>\nhi<|end|>\n<|bot|>\nno<|end|>\n") and got[8] == (1, "<|" + "|>\n<|end|>\n")
    assert chat.render_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_language_of_held_out_rows(spark, small):
    got = registry.op7_language_id(spark, small).join(common.table(spark, small, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()


def test_language_without_letters_or_model(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 !? 456", "a"), (4, "été", "a"), (5, "²½①Ⅷ", "a")]
    assert {r.lang_pred for r in language.identify(frame(spark, rows), None).collect()} == {"und"}
    model = language.learn(frame(spark, [(1, "the cat", "a"), (2, "der hund", "a")]).withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("de")))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark, rows), model).collect()}
    assert got[1] == got[2] == got[3] == got[5] == ("und", 0.0) and got[4][0] in ("en", "de")
    clash = frame(spark, rows).withColumns({"score": F.lit("x"), "Lang_Pred": F.lit(1)})
    assert sorted(map(str, language.identify(clash, model).columns[-2:])) == ["lang_pred", "score"]
    assert language.identify(frame(spark, []), model).count() == 0
    assert language.learn(frame(spark, [])) is None


def labelled(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


def test_language_of_many_copies_is_learned(spark):
    rows = [(f"the cat and the dog {w}", "en") for w in "abcd" for _ in range(50)] + [(f"der hund und die katze {w}", "de") for w in "efghijklmnop"]
    model = language.learn(labelled(spark, rows), sample_rows=8)
    assert model.families == {"germanic": ["de", "en"]}
    assert model.predict("the dog and the cat")[0] == "en"


def test_language_learns_every_label(spark):
    r = random.Random(3)
    rows = [("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)), f"x{i}") for i in range(205)]
    model = language.learn(labelled(spark, rows))
    assert sum(len(v) for v in model.families.values()) == 205


def pieces_brute(line):
    out, at = [], 0
    while at < len(line):
        n = next((k for k in range(1, 65) if at + k == len(line) and k <= 63 or k > 1 and line[at + k - 1] in ".!?,;:|" and line[at + k : at + k + 1] == " "), 64)
        out.append(line[at : at + n])
        at += n
    return out or [""]


def tree_brute(text):
    """Sections of (hash, [(hash, pieces)])."""
    short = lambda x: hashlib.sha256(x.encode()).hexdigest()[:32]
    body, out = [], []
    for line in text.split("\n"):
        body.append((short(line), [f"{xxhash.xxh64_intdigest(p.encode(), 42):016X}" if p else "" for p in pieces_brute(line)]))
        if body[-1][0][31] in "08":
            out.append(body)
            body = []
    return [(short("".join(h for h, _ in s)), s) for s in ([*out, body] if body else out)]


def print_brute(text):
    tree = tree_brute(text)
    return hashlib.sha256("".join(h for h, _ in tree).encode()).hexdigest() + "/" + ";".join(f"{h}=" + ",".join(f"{p}:{'.'.join(x)}" for p, x in s) for h, s in tree)


def likeness_brute(a, b):
    if a == b:
        return 1.0
    x, y = tree_brute(a), tree_brute(b)
    total = sum(len(p) for t in (x, y) for _, s in t for _, p in s)
    key = repr
    for _ in range(2):
        cx, cy = Counter(map(key, x)), Counter(map(key, y))
        x, y = ([eval(k) for k, n in (c - d).items() for _ in range(n)] for c, d in ((cx, cy), (cy, cx)))
        x, y = [z for _, kids in x for z in kids], [z for _, kids in y for z in kids]
    cx, cy = Counter(x), Counter(y)
    return 1.0 - max(1e-9, (sum((cx - cy).values()) + sum((cy - cx).values())) / total)


def edited_brute(a, b):
    x, y = tree_brute(a), tree_brute(b)
    hx, hy = {h for h, _ in x}, {h for h, _ in y}
    there = {p for h, s in y if h not in hx for p, _ in s}
    flat = [(h, p) for h, s in x for p, _ in s]
    return [i for i, (h, p) in enumerate(flat) if h not in hy and p not in there]


def fingerprint_rows():
    r = random.Random(4)
    line = lambda: r.choice(("", " ", "same, same. same", "x" * r.randrange(200), " ".join(r.choice(WORDS) + r.choice(("", ",", ".", "  ")) for _ in range(r.randrange(30)))))
    rows = [(i * 7 % 41, "\n".join(line() for _ in range(r.randrange(40))), "a") for i in range(41)]
    rows += [(50, None, "a"), (51, "é" * 7, "a"), (52, "same\ntext.", "a"), (53, "same\ntext.", "a"), (54, "a. b", "a"), (55, "a.  b", "a"), (56, "a, c\n\n", "a"), (57, "a,   c\n", "a"), (58, "\U0001f600" * 130, "a")]
    return rows


@pytest.mark.parametrize("quantiles", [1000, 4])
def test_fingerprints(spark, monkeypatch, quantiles):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 3)
    monkeypatch.setattr(merkle, "QUANTILES", quantiles)
    rows = fingerprint_rows()
    order = sorted(((d, t or "") for d, t, _ in rows), reverse=True)
    got = {r.doc_id: r for r in merkle.fingerprints(frame(spark, rows)).collect()}
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (print_brute(t), print_brute(new))
        assert got[d].near_edited == pytest.approx(likeness_brute(t, new), abs=1e-12) and got[d].near_next == pytest.approx(likeness_brute(t, after), abs=1e-12)
        assert list(got[d].edited_lines) == edited_brute(t, new)
    assert got[52].fingerprint == got[53].fingerprint and got[53].near_next == 1.0
    assert len({r.fingerprint.split("/")[0] for r in got.values()}) == len({t for _, t in order})
    assert merkle.fingerprints(frame(spark, [])).count() == 0
    alone = merkle.fingerprints(frame(spark, [(1, "ab", "a")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"aa").hexdigest()


def test_successors_of_repeated_and_null_ids(spark, monkeypatch):
    """A third of the rows share an id, others have none; ranges cut them by the texts' hashes."""
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 4)
    rows = [(7, f"t{i}", "a") for i in range(60)] + [(i, f"u{i}", "a") for i in range(60)] + [(None, f"n{i}", "a") for i in range(40)] + [(3, "u3", "a")] * 5 + [(2**63 - 1, "top", "a"), (-(2**63), "low", "a")]
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (2**64 if h >= 2**63 else 0)
    order = sorted(((d is not None, d or 0, signed(t), t) for d, t, _ in rows), reverse=True)
    want = sorted((a[3], b[3]) for a, b in zip(order, order[1:] + order[:1]))
    slim = frame(spark, rows).select("doc_id", "text")
    assert sorted((r.text, r.next_text) for r in merkle.with_next(slim).collect()) == want
    assert merkle._bucketed(slim.withColumn("t", F.xxhash64("text"))).groupBy("bucket", "part").count().agg(F.max("count")).first()[0] <= 16


def test_branches_name_the_edited_paragraphs(spark):
    a, b = "one.\ntwo, three.\nfour.", "one.\ntwo, 3.\nfour."
    df = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.sections(F.col("a")).alias("a"), merkle.sections(F.col("b")).alias("b")).select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    assert list(merkle.branches(df, "a", "b", "n").first().n) == [1]


@pytest.mark.parametrize("groups", [200_000, 40])
def test_packing(spark, small, groups):
    from tokenizers import Tokenizer

    docs = common.table(spark, small, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "hello " * 5000), (None, "x")], "doc_id long, text string"))
    docs = docs.union(docs.limit(1))
    out = packing.pack_documents(docs, registry.tokenizer_path(), group_pieces=groups).collect()
    whole = Tokenizer.from_file(registry.tokenizer_path())
    want = []
    for d, t in docs.collect():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len({r.certified for r in out}) >= 1 and (groups < 1000 or all(r.certified for r in out))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    counts = np.bincount([r.length for r in out], minlength=2049)
    assert packing.lower_bound(counts, 2048) <= len(bins) <= packing.lower_bound(counts, 2048) * (1.02 if groups > 1000 else 1.1) + 1


def test_packing_spreads_one_document_and_takes_no_rows(spark):
    """Pieces of one doc_id in many partitions, exchanged until nothing more is certified."""
    r = random.Random(9)
    rows = [(7 if i % 2 else None, 0, 0, r.randrange(300, 1500), i) for i in range(400)] + [(1, 0, 0, 2048, 1)] * 3
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row string, g string, done string"
    out = packing.pack(spark.createDataFrame([(*x, "x", "x", "x") for x in rows], schema), group_pieces=50).collect()
    assert sorted((r.ids_crc32, r.length) for r in out) == sorted((x[4], x[3]) for x in rows)
    bins = defaultdict(list)
    for x in out:
        bins[x.sequence_id].append((x.offset, x.length))
    assert all(sum(n for _, n in parts) <= 2048 and sorted(a for a, _ in parts) == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] for parts in bins.values())
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    assert packing.pack_documents(frame(spark, []), registry.tokenizer_path()).count() == 0


def test_bounds_hold_on_random_bins():
    r = np.random.default_rng(1)
    for _ in range(20):
        sizes = r.integers(1, 101, r.integers(1, 60))
        _, _, room = packing.best_fit(sizes, 100)
        assert packing.lower_bound(np.bincount(sizes, minlength=101), 100) <= len(room)
    assert packing.lower_bound(np.bincount([51] * 7, minlength=101), 100) == 7
    assert packing.pack.__doc__


def test_pipeline_against_its_parts(spark, small):
    import corpus_pipeline as p

    docs = common.table(spark, small, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    after = {d: t for d, t in rows.items() if t and re.search(r"[^\W\d_]", t)}
    dropped = lines_brute([(d, t) for d, t in after.items()])
    cut = {d: n - k for d, n, k, _ in dropped}
    held = p.lines(spark, p.language(spark, docs, small), small)
    kept = {r.doc_id: r.text for r in held.collect()}
    assert set(kept) == {d for d in after if cut[d]} and held.columns == p.COLUMNS
    assert all(hashlib.sha256(kept[d].encode()).hexdigest() == h for d, _, _, h in dropped if d in kept)
    least = {d: c for d, _, c in groups_brute([(d, t) for d, t in kept.items()])}
    single = {d: t for d, t in kept.items() if least[d] == d}
    bench = [(r.item_id, r.text) for r in common.table(spark, small, "benchmark").collect()]
    clean = {d for d, _, hit, *_ in contamination_brute(list(single.items()), bench) if not hit}
    out = p.run(spark, small).collect()
    assert {r.doc_id for r in out} == clean
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(registry.tokenizer_path())
    want = []
    for d in clean:
        ids = [*whole.encode(kept[d], add_special_tokens=False).ids, 0]
        want += [(d, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    filled = defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 2048 and all(a == sum(n for _, n in sorted(v)[:k]) for k, (a, _) in enumerate(sorted(v))) for v in filled.values())


def test_pipeline_stages_take_awkward_rows(spark, small):
    import corpus_pipeline as p

    rows = [(1, None, "a"), (None, "", "a"), (None, "the cat sat on the mat", "a"), (2, "the cat sat on the mat", "a"), (2, "the cat sat on the mat", "a"), (3, "123 456", "a"), (4, "x " * 3000, "a")]
    docs = frame(spark, rows).withColumn("n_chars", F.lit(1).cast("long"))
    known = p.language(spark, docs, small)
    assert sorted(str(r.doc_id) for r in known.collect()) == ["2", "2", "4", "None"] and known.columns == p.COLUMNS
    assert sorted(str(r.doc_id) for r in p.lines(spark, docs, small).collect()) == ["1", "2", "2", "3", "4", "None", "None"]
    assert sorted(str((r.doc_id, r.text)) for r in p.near_duplicates(spark, docs, small).collect()) == sorted(map(str, [(1, None), (None, ""), (2, rows[3][1]), (3, "123 456"), (4, "x " * 3000)]))
    assert p.benchmark(spark, docs, small).count() == 7 and p.packing(spark, docs, small).agg(F.countDistinct("doc_id")).first()[0] == 4
    assert p.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), small).count() == 0
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0


def test_pipeline_keeps_one_row_of_a_group(spark, small):
    import corpus_pipeline as p

    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(3, one, "a"), (3, one, "b"), (3, one, "a"), (4, one, "a"), (5, two, "a"), (5, three, "a"), (2, three, "a"), (None, two, "a"), (None, None, "a"), (7, None, "a"), (7, None, "a")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    got = p.near_duplicates(spark, docs, small)
    assert got.columns == p.COLUMNS
    kept = sorted(((r.doc_id, r.text, r.source) for r in got.collect()), key=str)
    assert kept == sorted([(3, one, "a"), (5, two, "a"), (2, three, "a"), (None, None, "a"), (7, None, "a"), (7, None, "a")], key=str)
