"""Queries of subwords and of rules by context."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalis.functions import text as T
from vocalis.operators import contexts, subwords
from vocalis.plans.library import _TOKEN_SQL, ORACLE_SQL, QUERIES, _table

#: Pieces of up to so many letters, found so often in the benchmark, make up the vocabulary of the query.
LONGEST, OFTEN = 4, 5


def _vocabulary(benchmark):
    word = benchmark.select(F.explode(T.tokens(F.col("text"))).alias("w"))
    at = word.select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i"))
    grams = at.select("i", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("w") - F.col("i") + 1)), lambda n: F.substring("w", F.col("i"), n))).alias("g"))
    named = grams.select(F.concat(F.when(F.col("i") > 1, subwords.INSIDE).otherwise(""), "g").alias("piece"))
    return named.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


def longest_word_pieces(spark, sf_dir):
    """Words of conversations in the longest pieces of a vocabulary that the benchmark's words give."""
    words = _table(spark, sf_dir, "conversations").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    found = subwords.longest_pieces(words, _vocabulary(_table(spark, sf_dir, "benchmark")))
    return found.select("word", F.array_join("pieces", " ").alias("pieces"))


QUERIES["longest_word_pieces"] = longest_word_pieces
ORACLE_SQL["longest_word_pieces"] = f"""WITH RECURSIVE b AS (SELECT unnest(regexp_extract_all(text, '{_TOKEN_SQL}')) AS w FROM benchmark),
 i AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM b),
 v AS (SELECT piece FROM (SELECT CASE WHEN i > 1 THEN '##' ELSE '' END || substring(w, i, n) AS piece FROM (SELECT w, i, unnest(range(1, least({LONGEST}, length(w) - i + 1) + 1)) AS n FROM i)) GROUP BY 1 HAVING count(*) >= {OFTEN}),
 d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_TOKEN_SQL}')) AS word FROM conversations),
 p AS (SELECT word, 1 AS spot, '' AS pieces FROM d UNION ALL
   SELECT word, spot + n, trim(pieces || ' ' || piece) FROM (SELECT p.word, p.spot, p.pieces, c.n, v.piece, row_number() OVER (PARTITION BY p.word, p.spot ORDER BY c.n DESC) AS k FROM p, (SELECT unnest(range(1, {LONGEST} + 1)) AS n) c
     JOIN v ON v.piece = CASE WHEN p.spot > 1 THEN '##' ELSE '' END || substring(p.word, p.spot, c.n) WHERE c.n <= length(p.word) - p.spot + 1) WHERE k = 1)
 SELECT d.word, coalesce(p.pieces, '[UNK]') AS pieces FROM d LEFT JOIN p ON p.word = d.word AND p.spot = length(d.word) + 1"""

_DIMS = 16


def ngram_bag_vectors(spark, sf_dir):
    """Words of conversations as means of their n-grams' vectors: grams of 3 to 5 letters, with the vectors of embeddings
    dealt to them by their length and last letters."""
    words = _table(spark, sf_dir, "conversations").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    given = _table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 97).alias("k"), "vec_id", F.slice("embedding", 1, _DIMS).alias("vector"))
    first = given.groupBy("k").agg(F.min_by("vector", "vec_id").alias("vector"))
    known = _table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct().select(F.explode(T.ngrams(F.col("w"), 3, 5)).alias("gram")).distinct()
    dealt = known.withColumn("k", ((F.ascii(F.substring("gram", -1, 1)) * 7 + F.ascii(F.substring("gram", -2, 1)) * 31 + F.length("gram")) % 97).cast("long"))
    out = subwords.bag_vectors(words, dealt.join(first, "k").select("gram", "vector"), _DIMS, least=3, most=5)
    return out.select("word", "n_known", *[F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in (0, 7, 15)])


QUERIES["ngram_bag_vectors"] = ngram_bag_vectors
_GRAMS = "flatten(list_transform(range(3, 6), lambda k: list_transform(range(1, greatest(length(w) - k + 2, 1)), lambda i: substring(w, i, k))))"
ORACLE_SQL["ngram_bag_vectors"] = f"""WITH b AS (SELECT DISTINCT '<' || unnest(regexp_extract_all(text, '{_TOKEN_SQL}')) || '>' AS w FROM benchmark),
 g AS (SELECT DISTINCT unnest({_GRAMS}) AS gram FROM b), k AS (SELECT gram, (ord(gram[-1:]) * 7 + ord(gram[-2:-2]) * 31 + length(gram)) % 97 AS k FROM g),
 f AS (SELECT vec_id % 97 AS k, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY 1),
 d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_TOKEN_SQL}')) AS word FROM conversations),
 h AS (SELECT word, unnest({_GRAMS}) AS gram FROM (SELECT word, '<' || word || '>' AS w FROM d)),
 m AS (SELECT word, count(*) AS n, avg(v[1]::DOUBLE) AS a, avg(v[8]::DOUBLE) AS b, avg(v[16]::DOUBLE) AS c FROM h JOIN k USING (gram) JOIN f USING (k) GROUP BY word)
 SELECT word, coalesce(n, 0)::BIGINT AS n_known, round(coalesce(a, 0), 6) AS v0, round(coalesce(b, 0), 6) AS v7, round(coalesce(c, 0), 6) AS v15 FROM d LEFT JOIN m USING (word)"""

#: ord, token, left, right, said: common words of the conversations, read by what stands beside them.
RULES = [(0, "le", None, None, "luh"), (1, "le", "de", None, "luh after de"), (2, "le", None, "la", "luh before la"), (3, "le", "de", "la", "luh between"), (4, "the", None, None, "thuh"), (5, "the", "of", None, "thee"), (6, "the", "of", None, "never"), (7, "der", None, "und", "dair"), (8, "de", "la", None, "day"), (9, "of", None, "the", "uv"), (10, "und", "der", None, "oont")]
_RULE_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in RULES)


def context_readings(spark, sf_dir):
    """Tokens of conversations that a rule of its context reads."""
    talk = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    rules = spark.createDataFrame(RULES, "ord int, token string, left string, right string, said string")
    return contexts.apply_rules(talk, rules, "conv_id", "turn", "pos").where("said is not null")


QUERIES["context_readings"] = context_readings
ORACLE_SQL["context_readings"] = f"""WITH r AS (SELECT * FROM (VALUES {_RULE_ROWS}) AS r(ord, tok, l, r, said)),
 t AS (SELECT conv_id, turn, unnest(ts) AS token, unnest(range(len(ts)))::INT AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text, '{_TOKEN_SQL}') AS ts FROM conversations)),
 n AS (SELECT *, lag(token) OVER o AS before, lead(token) OVER o AS after FROM t WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos))
 SELECT conv_id, turn, pos, token, said, ord::INT AS rule FROM n JOIN r ON tok = token AND (l IS NULL OR l = before) AND (r.r IS NULL OR r.r = after)
 QUALIFY row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY (l IS NULL)::INT + (r.r IS NULL)::INT, l IS NULL, ord) = 1"""
