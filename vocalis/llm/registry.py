"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm.common import table

A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalis.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    bitmap = F.array_join(F.transform("keep_words", lambda w: F.concat_ws(":", w["word"].cast("string"), w["bits"].cast("string"))), ",")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.coalesce(bitmap, F.lit("")).alias("keep_bitmap"))


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {A_Z}) AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.r, k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keep AS gone FROM k LEFT JOIN c USING (key)),
w AS (SELECT r, pos // 64 AS word, 18446744073709551615 - sum(CASE WHEN gone THEN 1::HUGEINT << (pos % 64)::INT ELSE 0 END) AS kept FROM m GROUP BY 1, 2 HAVING bool_or(gone)),
b AS (SELECT r, string_agg(word || ':' || (CASE WHEN kept >= 9223372036854775808 THEN kept - 18446744073709551616 ELSE kept END), ',' ORDER BY word) AS bitmap FROM w GROUP BY r)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256, coalesce(any_value(bitmap), '') AS keep_bitmap
FROM m LEFT JOIN b USING (r) GROUP BY r
"""

def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalis.llm.secrets import scan_secrets, secret_digest

    return secret_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalis.llm.decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    runs = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", runs.alias("spans"))


OP2_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws, regexp_split_to_array(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS gs
  FROM (SELECT doc_id, translate(coalesce(text, ''), {A_Z}) AS t FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {A_Z}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bk AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM g),
dg AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT r, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k)),
m AS (SELECT r, dg.k, i, item_id FROM dg JOIN g ON dg.k = g.k AND dg.gram = g.gram),
hp AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m)),
h AS (SELECT r, count(*) AS n_hit FROM hp GROUP BY r),
ru AS (SELECT r, min(p) AS a, max(p) AS z FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS g FROM hp) GROUP BY r, g),
pl AS (SELECT r, p, sum(g + l) OVER (PARTITION BY r ORDER BY p) AS past, past - l AS start FROM (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(list_transform(gs[1:len(ws)], lambda x: length(x))) AS g, unnest(list_transform(ws, lambda x: length(x))) AS l FROM w WHERE r IN (SELECT r FROM hp))),
sp AS (SELECT ru.r, string_agg(x.start || ':' || y.past, ',' ORDER BY a) AS spans FROM ru JOIN pl x ON x.r = ru.r AND x.p = a JOIN pl y ON y.r = ru.r AND y.p = z GROUP BY ru.r),
t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM w LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN sp USING (r)
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalis.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _op3_sql() -> str:
    """Scores only rise and have come to rest long before 100 steps at the size that the SQL is run at."""
    step = """s{k} AS (SELECT z.way, z.host, z.seed, (15 * z.seed + 85 * coalesce(g.given, 0)) // 100 AS score FROM z LEFT JOIN
  (SELECT s.way, e.dst AS host, sum(s.score * e.share // 1000000)::BIGINT AS given FROM s{j} s JOIN e ON s.way = e.way AND s.host = e.src GROUP BY 1, 2) g ON z.way = g.way AND z.host = g.host)"""
    steps = ",\n".join(step.format(k=k, j=k - 1) for k in range(1, 101))
    return f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html,
  translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), {A_Z}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN host LIKE '%.net' AND path LIKE '/es/%' OR host = 'net' AND path LIKE '/es/%' THEN 'net/es/'
  WHEN host LIKE '%.net' AND path LIKE '/fr/%' OR host = 'net' AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p),
j AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM q),
named AS (SELECT DISTINCT r, host AS src, translate(unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''<>\\s]+)', 1)), {A_Z}) AS dst FROM j WHERE host <> ''),
w AS (SELECT src, dst, count(*) AS weight FROM named WHERE src <> dst GROUP BY 1, 2),
known AS (SELECT host FROM j WHERE host <> '' UNION SELECT dst FROM w),
b AS (SELECT 't' AS way, src, dst, weight FROM w UNION ALL SELECT 'd', dst, src, weight FROM w),
e AS (SELECT way, src, dst, (weight * 1000000 // sum(weight) OVER (PARTITION BY way, src))::BIGINT AS share FROM b),
c AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM j WHERE host <> '' GROUP BY 1),
v AS (SELECT k.host, coalesce(good * 100000 // n, 0)::BIGINT AS trust, coalesce(bad * 100000 // n, 0)::BIGINT AS distrust FROM known k LEFT JOIN c USING (host)),
z AS (SELECT host, 't' AS way, trust AS seed FROM v UNION ALL SELECT host, 'd', distrust FROM v),
s0 AS (SELECT way, host, seed, 15 * seed // 100 AS score FROM z),
{steps},
f AS (SELECT host, sum(score) FILTER (way = 't') AS t, sum(score) FILTER (way = 'd') AS d FROM s100 GROUP BY 1)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN d > t AND d >= 1500 THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN f ON j.host = f.host
"""


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalis.llm.pii import find_pii, pii_digest

    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalis.llm.jaccard_join import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_Z}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
s AS (SELECT r, count(*) AS n, sha256(string_agg(sh, chr(10) ORDER BY sh)) AS k FROM g GROUP BY r),
c AS (SELECT k, min(r) AS r, any_value(n) AS n, min(doc_id) AS least FROM s JOIN w USING (r) GROUP BY k),
f AS (SELECT g.r, sh FROM g JOIN c USING (r)),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS same FROM f a JOIN f b ON a.sh = b.sh AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c cx ON cx.r = x JOIN c cy ON cy.r = y WHERE 100 * same >= 80 * (cx.n + cy.n - same)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
t AS (SELECT r AS x, r AS y FROM c UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x),
m AS (SELECT c.k, min(o.least) AS least FROM t JOIN c ON c.r = t.x JOIN c o ON o.r = t.y GROUP BY c.k)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id FROM w LEFT JOIN s USING (r) LEFT JOIN m USING (k)
"""


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalis.llm.chat import render_chats

    return render_chats(table(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, max(k)::BIGINT AS n_turns, list({'r': role, 't': text} ORDER BY k) AS ts FROM t GROUP BY 1),
p AS (SELECT DISTINCT ts[1:i] AS ts FROM (SELECT ts, unnest(range(1, n_turns)) AS i FROM c)),
m AS (SELECT min(conv_id) AS conv_id FROM c WHERE ts NOT IN (SELECT ts FROM p) GROUP BY ts)
SELECT conv_id, n_turns, array_to_string(list_transform(ts, lambda x: '<|' || x.r || '|>' || chr(10) || x.t || '<|end|>' || chr(10)), '') AS text FROM c JOIN m USING (conv_id)
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalis.llm.language import identify, learn

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.expr("crc32(cast(doc_id as string)) % 3 = 1"))
    model = learn(docs.where("not coalesce(held_out, false)").select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalis.llm.merkle import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalis.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vocalis.llm.byte_bpe import encode

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], data="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalis.llm.common import written
    from vocalis.llm.spelling import document_words, misspelt, variants, vocabulary

    words = document_words(table(spark, sf_dir, "documents")).select(misspelt(F.col("word"), F.col("doc_id")).alias("word"))
    return variants(written(vocabulary(words), "vocabulary")).select("word", "n", "n_near", "form", "form_n", "root")


OP12_SQL = f"""
WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS tab),
d AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), {A_Z}) AS run FROM documents) GROUP BY 1, 2),
b AS (SELECT run, times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END)) AS bytes FROM d),
h AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, bytes::BIGINT[]), lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1]))) AS h FROM b, poly),
v AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, sum(times)::BIGINT AS n FROM h GROUP BY 1),
w AS (SELECT word, n FROM v WHERE length(word) >= 5 AND n >= 3),
k AS (SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS word, b.word AS near, b.n AS m FROM k a JOIN k b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.key UNION SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = k.key),
f AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM p GROUP BY word),
t AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN f USING (word)),
r AS (SELECT word, word AS at FROM t UNION ALL SELECT r.word, t.form FROM r JOIN t ON t.word = r.at WHERE t.form IS NOT NULL),
e AS (SELECT r.word, r.at AS root FROM r JOIN t ON t.word = r.at WHERE t.form IS NULL)
SELECT word, n, n_near, form, form_n::BIGINT AS form_n, root FROM t JOIN e USING (word)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalis.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))


OP13_SQL = """
WITH s AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) = 1),
a AS (SELECT * FROM e WHERE vec_id % 100 = 0),
p AS (SELECT a.vec_id AS anchor_id, a.label, a.q, e.vec_id AS positive_id, list_inner_product(a.q, e.q)::BIGINT AS positive_score FROM a JOIN e ON a.label = e.label AND a.vec_id <> e.vec_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY positive_score DESC, positive_id) <= 5),
n AS (SELECT a.vec_id AS anchor_id, e.vec_id AS negative_id, list_inner_product(a.q, e.q)::BIGINT AS negative_score FROM a JOIN e ON a.label <> e.label)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INT AS rank, negative_id, positive_score, negative_score
FROM p JOIN n USING (anchor_id) WHERE 80 * positive_score <= 100 * negative_score AND negative_score <= positive_score QUALIFY rank <= 5
"""

QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_decontaminate": op2_decontaminate, "op3_url_filter": op3_url_filter, "op4_pii_boosting": op4_pii_boosting, "op5_jaccard_join": op5_jaccard_join, "op6_chat_snapshots": op6_chat_snapshots, "op7_language_id": op7_language_id, "op8_merkle_fingerprint": op8_merkle_fingerprint, "op9_best_fit_packing": op9_best_fit_packing, "op10_line_dedup": op10_line_dedup, "op11_byte_bpe": op11_byte_bpe, "op12_spelling_variants": op12_spelling_variants, "op13_hard_negatives": op13_hard_negatives}
ORACLE_SQL = {"op2_decontaminate": OP2_SQL, "op3_url_filter": _op3_sql(), "op5_jaccard_join": OP5_SQL, "op6_chat_snapshots": OP6_SQL, "op10_line_dedup": OP10_SQL, "op12_spelling_variants": OP12_SQL, "op13_hard_negatives": OP13_SQL}
