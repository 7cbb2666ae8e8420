"""Operator 3: URL filter with trust and distrust spread over the host graph. DataFrame functions only.

A rule decides where one fits. Elsewhere the host does: trust starts at hosts whose pages rules allow and follows links
(personalised PageRank), distrust starts at hosts with blocked pages and follows them backwards. Edges lead from a
page's host to the hosts of its HTML's href attributes, with pages or without, folded by host pair before they shuffle.
Scores are integers (fixed point), so sums do not depend on their order. They begin at the seeds' share and only rise,
so they come to rest, and are iterated until they do; joins are equi-joins that adaptive execution may split at a hub.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import discard, need, written

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with its own.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Score of a host all of whose pages are seeds; per cent kept by seeds each step; parts of a host's outgoing weight.
SEED, RESTART, PARTS = 100_000, 15, 1_000_000
#: A host is blocked if its distrust exceeds its trust and reaches a tenth of what a host of blocked pages starts with.
LEAST_DISTRUST = SEED * RESTART // 1000
#: The host of a link with an address or none but a host, in quotes or bare.
HREF = "(?i)\\bhref\\s*+=\\s*+[\"']?+\\s*+(?:[a-z][a-z0-9+.-]*+:)?//([^/?#\"'<>\\s]++)"


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.regexp_extract(url, "(?s)://(.*)", 1), "/", 1)
    raw = F.regexp_extract(rest, "(?s)^[^?#]*+", 0)
    return F.coalesce(_lower(raw), F.lit(""))


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as written (host and path), and its verdict; both null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> (src, dst, weight): pages of src that link to dst, another host."""
    linked = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), _lower))
    named = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(linked).alias("dst")).where("src <> dst")
    return named.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """edges (src, dst, weight), seeds (host, trust, distrust: long) -> (host, trust, distrust) at rest.

    All changes of a step together are at most 100 less RESTART per cent of those of the step before, and scores are whole
    numbers, so steps grow with the logarithm of the seeds' number.
    """
    both = edges.select(F.lit("t").alias("way"), "src", "dst", "weight").union(edges.select(F.lit("d"), F.col("dst"), F.col("src"), "weight"))
    total = both.groupBy("way", "src").agg(F.sum("weight").alias("total"))
    shares = written(both.join(total, ["way", "src"]).select("way", "src", "dst", F.expr(f"weight * {PARTS} div total").alias("share")), "host-shares")
    start = seeds.select("host", F.lit("t").alias("way"), F.col("trust").alias("seed")).union(seeds.select("host", F.lit("d"), F.col("distrust")))
    now = written(start.withColumn("score", F.expr(f"{RESTART} * seed div 100")), "host-scores")
    while True:
        given = now.select("way", F.col("host").alias("src"), "score").where("score > 0").join(shares, ["way", "src"]).groupBy("way", F.col("dst").alias("host")).agg(F.sum(F.expr(f"score * share div {PARTS}")).alias("given"))
        step = now.select("host", "way", "seed", F.col("score").alias("old")).join(given, ["way", "host"], "left").select("host", "way", "seed", "old", F.expr(f"({RESTART} * seed + {100 - RESTART} * coalesce(given, 0L)) div 100").alias("score"))
        last, now = now, written(step, "host-scores")
        discard(last)
        if not now.where("score <> old").limit(1).count():
            break
    return now.groupBy("host").agg(F.sum(F.when(F.col("way") == "t", F.col("score"))).alias("trust"), F.sum(F.when(F.col("way") == "d", F.col("score"))).alias("distrust"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, trust, distrust (of the host).

    pages: page_id, url, html; extra columns are ignored. A null url or one without :// has an empty host and path and,
    as no rule fits and no host speaks against it, is allowed. Null html links to no host. Rows repeated whole each count
    and get their result; a null page_id is as any. No rows give no rows.
    """
    need(pages, "page_id", "url", "html")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": name, "ruled": verdict})
    edges = written(host_edges(judged), "host-edges")
    counts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    seeds = counts.select("host", F.expr(f"good * {SEED} div n").alias("trust"), F.expr(f"bad * {SEED} div n").alias("distrust"))
    bare = edges.select(F.col("dst").alias("host")).distinct().join(counts, "host", "left_anti").select("host", F.lit(0).cast("long").alias("trust"), F.lit(0).cast("long").alias("distrust"))
    scores = spread(edges, seeds.union(bare))
    out = judged.drop("html").join(scores, "host", "left")
    held = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= LEAST_DISTRUST)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(held, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
