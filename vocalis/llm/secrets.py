"""Operator 1: secret scan with corpus-wide ownership of candidate values. DataFrame functions only.

Every text is searched once for the base patterns and for a wider candidate (long tokens of any case in which letters
and digits alternate). Candidate values are hashed; for each hash the distinct repositories and owners are counted over
the whole corpus. A value that many owners hold is a copied example, however few repositories each has; one that stays
with few owners, in however many of their repositories, and is varied enough to be a live credential, adds a span.
Counting folds by (hash, owner, repository) before it shuffles, so a value in a third of all rows is as
cheap as any; the few hashes that can be that frequent are joined back by broadcast (their number is bounded by the
inverse of the share), all others by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import need, written
from vocalis.llm.spans import joined, overlaps, spans, tagged

KINDS = ("assign", "access", "hex")
#: A value is owner-specific up to this many owners.
MAX_OWNERS = 1
HOT_SHARE = 1 / 1000

# fixed patterns: possessive where backing off cannot help, so long runs neither recurse nor go back
ASSIGN = """(?i)(?:password|passwd|secret|token|api_?key)["']?\\x20*+[:=]\\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = "AKIA[A-Z0-9]++"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
WIDE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Letters and digits alternate as random text does, which names with a date or a number don't.
VARIED, TIMES, DISTINCT = "[0-9][A-Za-z]", 3, 10


def _value(hit: Column) -> Column:
    return F.regexp_extract(hit, ASSIGN, 1)


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with assign, access, hex (base spans) and wide (candidates outside them)."""
    t = F.col(text)
    assign = F.filter(spans(t, ASSIGN, t.rlike("(?i)passw|secret|token|api_?key")), lambda s: F.char_length(_value(s["hit"])) >= 6)
    access = F.filter(spans(t, ACCESS, F.contains(t, F.lit("AKIA"))), lambda s: F.char_length(s["hit"]) >= 20)
    wide = spans(t, WIDE, t.rlike("[A-Za-z0-9+/_=-]{20}"))
    out = docs.withColumns({"assign": assign, "access": access, "hex": spans(t, HEX, t.rlike("[0-9a-f]{24}")), "_wide": wide})
    base = F.concat(*[F.transform(k, lambda s: s.dropFields("hit")) for k in KINDS])
    varied = lambda s: (F.regexp_count(s["hit"], F.lit(VARIED)) >= TIMES) & (F.size(F.array_distinct(F.split(s["hit"], ""))) >= DISTINCT)
    return out.withColumn("_base", base).withColumn("wide", F.filter("_wide", lambda s: varied(s) & ~overlaps(F.col("_base"), s["begin"], s["end"]))).drop("_wide", "_base")


def ownership(values: DataFrame) -> DataFrame:
    """(h, owner, repo) rows -> (h, n_owners, n_repos, n_rows). Null owners or repositories are one of their kind."""
    one = values.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
    two = one.groupBy("h", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return two.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_rows"))


def firsts(values: DataFrame) -> DataFrame:
    """(h, t, owner, repo) rows, t a text's hash -> (h, owner, repo) with copies of one text as one, under its least
    owner and repository."""
    return values.groupBy("h", "t").agg(F.min(F.struct("owner", "repo")).alias("m")).select("h", "m.owner", "m.repo")


def scan_secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row for each row of docs: doc_id, assign, access, hex, live (arrays of begin, end, hit, of code points, end
    exclusive), values (array of begin, end, n_owners, n_repos, copied).

    docs: doc_id, text, and the columns named as owner and repo; extra columns are ignored. A null or empty text has no
    spans. Rows repeated whole each get their own result and count as one repository. live: added candidates, whose owners
    are few, copies of one text counted as one document under its least owner. values: of every base and added value how
    many owners and repositories hold it; copied if the owners are more than max_owners. Base spans stay, copied or not.
    """
    need(docs, "doc_id", "text", owner, repo)
    slim = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), "text", F.xxhash64("text").alias("t"))
    found = secret_spans(slim).drop("text").withColumn("row", F.monotonically_increasing_id())
    found = written(found, "secret-spans")  # from here on row is fixed
    hashed = lambda col, f, k: F.transform(col, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), F.xxhash64(f(s["hit"])).alias("h"), F.lit(k).alias("wide")))
    same = lambda x: x
    values = F.concat(hashed(F.col("assign"), _value, False), hashed(F.col("access"), same, False), hashed(F.col("hex"), same, False), hashed(F.col("wide"), same, True))
    each = written(found.where("size(assign) + size(access) + size(hex) + size(wide) > 0").select("row", "owner", "repo", "t", F.inline(values)), "secret-values")
    distinct = ownership(firsts(each)).select(F.col("h").alias("_h"), (F.col("n_owners") <= max_owners).alias("few"))
    owned = ownership(each.select("h", "owner", "repo"))
    known = written(owned.join(distinct, F.col("h") == F.col("_h"), "left").withColumn("few", F.coalesce("few", F.lit(False))).drop("_h"), "secret-owners")
    hot_from = int(each.count() * HOT_SHARE) + 1
    hot = known.where(F.col("n_rows") >= hot_from).select("h", F.struct("n_owners", "n_repos", "few").alias("hot"))
    cold = known.where(F.col("n_rows") < hot_from).select("h", F.struct("n_owners", "n_repos", "few").alias("held"))
    first = each.join(F.broadcast(hot), "h", "left")
    held = first.where("hot is not null").withColumn("held", F.col("hot")).select("row", "begin", "end", "wide", "held").unionByName(first.where("hot is null").join(cold, "h").select("row", "begin", "end", "wide", "held"))
    copied = F.when(F.col("wide"), ~F.col("held.few")).otherwise(F.col("held.n_owners") > max_owners)
    rows = held.select("row", F.struct("begin", "end", "held.n_owners", "held.n_repos", copied.alias("copied"), "wide").alias("v")).groupBy("row").agg(F.sort_array(F.collect_list("v")).alias("values"))
    out = found.join(rows, "row", "left").withColumn("values", F.coalesce("values", F.array().cast("array<struct<begin: bigint, end: bigint, n_owners: bigint, n_repos: bigint, copied: boolean, wide: boolean>>")))
    alive = F.filter("values", lambda v: v["wide"] & ~v["copied"])
    live = F.filter("wide", lambda s: F.exists(alive, lambda v: v["begin"] == s["begin"]))
    return out.select("doc_id", "assign", "access", "hex", live.alias("live"), F.transform(F.filter("values", lambda v: ~v["wide"] | ~v["copied"]), lambda v: v.dropFields("wide")).alias("values"))


def secret_digest(found: DataFrame) -> DataFrame:
    """scan_secrets' rows as counts, digest and joined spans."""
    base = F.concat(*[tagged(k, F.col(k), i) for i, k in enumerate(KINDS)])
    added = tagged("live", F.col("live"), len(KINDS))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, added)).alias("spans"),
        F.size("live").cast("long").alias("n_live"), F.size(F.filter("values", lambda v: v["copied"])).cast("long").alias("n_copied"), F.size(F.filter("values", lambda v: ~v["copied"])).cast("long").alias("n_owned"),
    )
