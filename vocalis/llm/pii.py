"""Operator 4: personal data by proposed spans and gradient boosting. DataFrame functions only.

Generators of high recall propose overlapping spans, also inside of runs where the base patterns take too much and fail
(a card right after a telephone number). Features are small integers of a span's format and context. The examples are
planted: PLANTED texts made from templates, whose labels are known by construction and owe nothing to the base patterns
(addresses written out, numbers without a country code, versions and order numbers that look alike). Trees learn from
counts by feature row of three quarters of them; on the rest, for each kind, a threshold is calibrated to a precision.
Trees and thresholds select the spans to add, evaluated as one SQL expression over the whole corpus.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm.boosting import calibrated, fit
from vocalis.llm.common import need, written
from vocalis.llm.spans import joined, overlaps, spans, tagged

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
#: Example texts, and of how many one is held out for calibration.
PLANTED, HELD = 6_000, 4

# fixed patterns: possessive where backing off cannot help, so long runs neither recurse nor go back
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
PROPOSED = (
    (0, "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\\x20?[\\[(]at[\\])]\\x20?)[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)*+", "@|[\\[(]at[\\])]"),
    (1, "(?<![0-9.])[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?![0-9])", "[0-9]\\.[0-9]"),
    (2, "(?<![0-9])[0-9]{14,19}(?![0-9])", "[0-9]{14}"),
    (2, "(?<![0-9])[0-9]{4}([\\x20-])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}(?![0-9])", "[0-9]{4}[\\x20-][0-9]{4}"),
    (3, "(?<![0-9+])(?:\\+[0-9]{1,3}[\\x20.-]?)?(?:\\([0-9]{3}\\)|[0-9]{3})[\\x20.-]?[0-9]{3}[\\x20.-][0-9]{4}(?![0-9])", "[0-9]{3}[\\x20.-][0-9]{4}"),
)
CONTEXT = "(?is)(?:mail|contact|phone|tel\\b|call|fax|mobile|card|visa|credit|address|host|server|\\bip\\b)"
#: What such numbers are of other things; of both, the nearer one counts.
AGAINST = "(?i)order|invoice|ticket|version|section|chapter|figure|part|item|serial|isbn|total|release|build|table"
FEATURES = ("kind", "digits", "luhn", "octets", "plus", "paren", "dots", "context", "before", "after", "tld")
#: Templates of examples: (kind or -1 of none, what stands before, the span, what stands after). {u} user, {h} host, {t}
#: ending, {o} part to 255, {b} part above, {d} digit, {c} card number, {n} 16 digits that are no card number.
TEMPLATES = (
    (0, "mail ", "{u}@{h}.{t}", " please"), (0, "", "{u}@{h}.{t}", ", thanks"), (0, "contact ", "{u} [at] {h}.{t}", " now"), (0, "e-mail: ", "{u}(at){h}.{t}", ""), (0, "write to ", "{u} (at) {h}.{t}", "."),
    (-1, "sold ", "{d}@{d}{d}", " each"), (-1, "use ", "{u}@{h}", " in the code"), (-1, "seen ", "{d} (at) {d}", " today"),
    (1, "host ", "{o}.{o}.{o}.{o}", " is up"), (1, "", "{o}.{o}.{o}.{o}", " asked"), (1, "the server at ", "{o}.{o}.{o}.{o}", "\n"),
    (-1, "host ", "{b}.{o}.{o}.{o}", " is up"), (-1, "version ", "{d}.{d}.{d}.{d}", " is out"), (-1, "section ", "{d}.{d}.{d}{d}.{d}", " says"), (-1, "", "{o}.{o}.{b}.{o}", " asked"),
    (2, "card ", "{c}", " end"), (2, "", "{c}", " then"), (2, "visa ", "{c4}", " end"), (2, "paid by ", "{c4}", "."), (2, "+{d} (555) 123-4567 ", "{c}", " now"),
    (-1, "order ", "{n}", " end"), (-1, "", "{n}", " then"), (-1, "serial ", "{n4}", "."), (-1, "card ", "{n}", " end"), (-1, "invoice ", "{n4}", " end"),
    (3, "call ", "+{d} ({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d}", " now"), (3, "phone ", "({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d}", " now"), (3, "tel ", "{d}{d}{d}-{d}{d}{d}-{d}{d}{d}{d}", "."), (3, "", "({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d}", " or"), (3, "mobile: ", "{d}{d}{d}.{d}{d}{d}.{d}{d}{d}{d}", ","),
    (-1, "order ", "{d}{d}{d}-{d}{d}{d}-{d}{d}{d}{d}", " end"), (-1, "item ", "{d}{d}{d}.{d}{d}{d}.{d}{d}{d}{d}", "."), (-1, "", "{d}{d}{d}.{d}{d}{d}.{d}{d}{d}{d}", " gross"), (-1, "part ", "{d}{d}{d} {d}{d}{d} {d}{d}{d}{d}", " fits"), (-1, "", "{d}{d}{d} {d}{d}{d} {d}{d}{d}{d}", " were sold"),
)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """The check digit holds; spans of other than 14 to 19 digits are not looked at."""
    number = F.reverse(digits_of(hit))
    each = F.transform(F.split(number, ""), lambda c, i: c.cast("int") * (1 + i % 2))
    total = F.aggregate(each, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))
    return F.when(F.length(number).between(14, 19), total % 10 == 0).otherwise(False)


def octets(hit: Column) -> Column:
    """Parts between dots are at most 255, leading zeros aside."""
    return F.forall(F.split(hit, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\\z"))


def base_spans(text: Column) -> dict[str, Column]:
    n = lambda s: F.length(digits_of(s["hit"]))
    return {
        "email": spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans(text, IP, text.rlike("[0-9]\\.[0-9]++\\.")), lambda s: octets(s["hit"])),
        "card": F.filter(spans(text, CARD, text.rlike("[0-9](?:[\\x20-]?[0-9]){13}")), lambda s: luhn(s["hit"])),
        "phone": F.filter(spans(text, PHONE, F.contains(text, F.lit("+"))), lambda s: n(s).between(10, 15)),
    }


def _edge(c: Column) -> Column:
    """0 for a gap or punctuation, 1 for a digit, 2 for a letter."""
    return F.when(c.rlike("[0-9]"), 1).when(c.rlike("\\p{L}"), 2).otherwise(0)


def proposals(text: Column) -> Column:
    """Overlapping candidates as struct(begin, end, and the features)."""

    def features(kind: int, s: Column) -> Column:
        hit, n = s["hit"], F.length(digits_of(s["hit"]))
        flag = lambda c: F.when(c, 1).otherwise(0)
        before = F.substring(text, F.greatest(F.lit(1), (s["begin"] - 23).cast("int")), F.least(F.lit(24), s["begin"].cast("int")))
        values = {
            "kind": F.lit(kind),
            "digits": F.when(n == 0, 0).when(n < 10, 1).when(n == 10, 2).when(n == 11, 3).when(n < 14, 4).when(n < 16, 5).when(n == 16, 6).otherwise(7),
            "luhn": flag(luhn(hit)),
            "octets": flag(octets(hit)) if kind == 1 else F.lit(0),
            "plus": flag(hit.startswith("+")),
            "paren": flag(F.contains(hit, F.lit("("))),
            "dots": F.least(F.lit(3), F.length(F.regexp_replace(hit, "[^.]", ""))),
            "context": F.when(before.rlike(f"{CONTEXT}(?!.*(?:{AGAINST[4:]}))"), 2).when(before.rlike(AGAINST), 0).otherwise(1),
            "before": _edge(F.right(before, F.lit(1))),
            "after": _edge(F.substring(text, (s["end"] + 1).cast("int"), F.lit(1))),
            "tld": flag(hit.rlike("(?:@|at[\\])]).*\\.[A-Za-z]{2,}\\z")) if kind == 0 else F.lit(0),
        }
        return F.struct(s["begin"].alias("begin"), s["end"].alias("end"), *[v.cast("int").alias(k) for k, v in values.items()])

    return F.concat(*[F.transform(spans(text, pattern, text.rlike(maybe)), partial(features, kind)) for kind, pattern, maybe in PROPOSED])


def planted(spark: SparkSession, n: int = PLANTED) -> DataFrame:
    """Example texts from the templates: text, begin, end (of the span), kind (-1 of none), held."""
    hashed = lambda m, *of: F.pmod(F.xxhash64("id", *of), F.lit(m)).cast("int")
    some = lambda k, names: F.element_at(F.array(*[F.lit(x) for x in names.split()]), hashed(len(names.split()), F.lit(k)) + 1)
    first = F.concat(F.lit("4"), F.lpad(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10**14)).cast("string"), 14, "0"))
    checked = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(first, d.cast("string")))
    apart = lambda c: F.regexp_replace(c, "([0-9]{4})(?=[0-9])", "$1 ")
    each = spark.range(n).withColumn("k", hashed(len(TEMPLATES), F.lit(0)) + 1)
    each = each.withColumns({"good": F.get(F.filter(checked, luhn), 0), "bad": F.get(F.filter(checked, lambda c: ~luhn(c)), hashed(9, F.lit(8)))})
    words = {"c4": apart(F.col("good")), "n4": apart(F.col("bad")), "c": F.col("good"), "n": F.col("bad"), "u": some(1, "ann joe.doe max_w sam-k"), "h": some(2, "acme mail7 post-office"), "t": some(3, "com net org co.uk")}
    each = each.withColumns({f"w_{name}": value for name, value in words.items()})

    def filled(part: int) -> Column:
        def token(t: Column, i: Column) -> Column:
            out = t
            for name in words:
                out = F.when(t == f"{{{name}}}", F.col(f"w_{name}")).otherwise(out)
            for name, low, high in (("d", 0, 10), ("o", 1, 256), ("b", 256, 999)):
                out = F.when(t == f"{{{name}}}", (hashed(high - low, F.lit(10 + part), i) + low).cast("string")).otherwise(out)
            return out

        template = F.element_at(F.array(*[F.lit(t[part]) for t in TEMPLATES]), F.col("k"))
        return F.array_join(F.transform(F.split(template, "(?=\\{)|(?<=\\})"), token), "")

    made = each.select("id", F.element_at(F.array(*[F.lit(t[0]) for t in TEMPLATES]), F.col("k")).alias("kind"), filled(1).alias("a"), filled(2).alias("b"), filled(3).alias("c"))
    begin = F.char_length("a").cast("bigint")
    return made.select(F.concat("a", "b", "c").alias("text"), begin.alias("begin"), (begin + F.char_length("b")).alias("end"), "kind", (hashed(HELD, F.lit(5)) == 0).alias("held"))


def examples(spark: SparkSession, n: int = PLANTED) -> DataFrame:
    """Proposals in planted texts: the features, y (1 where the span and its kind were planted) and held."""
    each = planted(spark, n).select(F.col("begin").alias("b"), F.col("end").alias("e"), F.col("kind").alias("true"), "held", F.explode(proposals(F.col("text"))).alias("p")).select("b", "e", "true", "held", "p.*")
    own = (F.col("begin") == F.col("b")) & (F.col("end") == F.col("e")) & (F.col("kind") == F.col("true"))
    return each.select(*FEATURES, F.when(own, 1).otherwise(0).alias("y"), "held")


def learned(seen: DataFrame, precision: float) -> tuple[str, str]:
    """SQL of the score, and of the test that a span's score meets its kind's threshold."""
    kept = lambda held: F.when(F.col("held") == held, F.col("y"))
    rows = seen.groupBy(*FEATURES).agg(*[f(kept(h)).alias(a) for h, f, a in ((False, F.count, "n"), (False, F.sum, "pos"), (True, F.count, "hn"), (True, F.sum, "hpos"))]).orderBy(*FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    n, pos, hn, hpos = (np.array([r[k] or 0 for r in rows], float) for k in ("n", "pos", "hn", "hpos"))
    trees, margin = fit(x, n, pos)
    cuts = {k: calibrated(margin[x[:, 0] == k], hn[x[:, 0] == k], hpos[x[:, 0] == k], precision) for k in range(len(KINDS)) if (x[:, 0] == k).any()}
    test = " or ".join(f"(kind = {k} and score >= {cut - 1e-6:.9g}D)" for k, cut in cuts.items() if np.isfinite(cut)) or "false"
    return " + ".join(t.sql(list(FEATURES)) for t in trees), test


def find_pii(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """One row for each row of docs: doc_id, email, ip, card, phone (base spans: arrays of begin, end, hit; code points,
    end exclusive), added (array of begin, end, kind, score, in order, apart from the base spans and each other).

    docs: doc_id, text; extra columns are ignored. A null or empty text has no spans; rows repeated whole each get their
    result, and no rows give none. Of a kind whose threshold cannot keep the precision nothing is added.
    """
    need(docs, "doc_id", "text")
    t = F.col("text")
    base = base_spans(t)
    found = docs.select("doc_id", "text").withColumns(base).withColumn("proposed", proposals(t))
    found = written(found.drop("text").withColumn("row", F.monotonically_increasing_id()), "pii-spans")  # from here on row is fixed
    taken = F.concat(*[F.transform(k, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), F.lit(i).alias("kind"))) for i, k in enumerate(KINDS)])
    each = found.select("row", taken.alias("taken"), "proposed").select("row", "taken", F.explode("proposed").alias("p")).select("row", "taken", "p.*")
    free = each.where(~overlaps(F.col("taken"), F.col("begin"), F.col("end"))).drop("taken")
    score, test = learned(examples(docs.sparkSession), precision)
    chosen = free.withColumn("score", F.expr(score)).where(test)
    picked = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("begin", F.negative("end").alias("last"), "kind", "score"))).alias("c"))
    item = "array<struct<begin: bigint, end: bigint, kind: int, score: double>>"

    def taking(acc: Column, s: Column) -> Column:
        """The next span by begin, the longest first, if it is apart from those taken."""
        span = F.struct(s["begin"].alias("begin"), (-s["last"]).alias("end"), s["kind"].alias("kind"), s["score"].alias("score"))
        return F.when(s["begin"] < acc["at"], acc).otherwise(F.struct((-s["last"]).alias("at"), F.concat(acc["out"], F.array(span)).cast(item).alias("out")))

    apart = F.aggregate("c", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(item).alias("out")), taking, lambda acc: acc["out"])
    added = picked.select("row", apart.alias("added"))
    return found.drop("proposed").join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(item))).drop("row")


def pii_digest(found: DataFrame) -> DataFrame:
    """find_pii's rows as counts, digest and joined spans."""
    base = F.concat(*[tagged(k, F.col(k), i) for i, k in enumerate(KINDS)])
    name = F.array(*[F.lit(k) for k in KINDS])
    added = F.transform("added", lambda s: F.struct(s["begin"].alias("begin"), s["kind"].alias("rank"), s["end"].alias("end"), F.get(name, s["kind"]).alias("kind")))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, added)).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(F.concat(base, added)).cast("long").alias("n_spans"))
