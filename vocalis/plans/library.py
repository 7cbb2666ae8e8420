"""The library's queries over the standard tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.functions import text as T
from vocalis.functions import words as N
from vocalis.kernel import russian, technical
from vocalis.kernel.frontend import Entry, Options
from vocalis.operators import audit, dictionary, spans
from vocalis.plans import sql_words as S
from vocalis.sources import dictionary as files
from vocalis.udf import normalize, normalize_text

FLAGSHIP = "normalize_documents"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(source: str, sql: str | None = None):
    """Registers a function of one table's frame under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(_table(spark, sf_dir, source))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Number words on numeric columns

_CENTS = "cast({c} as decimal(12,2))"


def _sql_of(column: str) -> tuple[str, str]:
    cents = f"round({column}::DECIMAL(12,2) * 100)::BIGINT"
    return f"({cents} // 100)", f"({cents} % 100)"


def _token(column: str, mark: str) -> F.Column:
    return F.replace(F.expr(_CENTS.format(c=column)).cast("string"), F.lit("."), F.lit(mark))


_PRICE, _RETAIL = _sql_of("o_totalprice"), _sql_of("p_retailprice")


@query("orders", f"SELECT o_orderkey, {S.en('o_orderkey')} AS spoken FROM orders")
def en_cardinal(df):
    return df.select("o_orderkey", N.en_cardinal(F.col("o_orderkey")).alias("spoken"))


@query("orders", f"SELECT o_orderkey, {S.ru('o_orderkey')} AS spoken, {S.ru('-o_orderkey', True)} AS feminine FROM orders")
def ru_cardinal(df):
    return df.select("o_orderkey", N.ru_cardinal(F.col("o_orderkey")).alias("spoken"), N.ru_cardinal(-F.col("o_orderkey"), True).alias("feminine"))


@query("orders", f"SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 0 THEN CASE WHEN o_orderkey = 0 THEN 'zeroth' ELSE {S.en('o_orderkey')} || 'th' END WHEN o_orderkey % 100 = 0 THEN {S.en('o_orderkey')} || 'th' ELSE concat_ws(' ', CASE WHEN o_orderkey >= 100 THEN {S.en('(o_orderkey - o_orderkey % 100)')} END, {S.en_ordinal_below_100('o_orderkey % 100')}) END AS spoken, CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th' ELSE ['th','st','nd','rd','th','th','th','th','th','th'][o_orderkey % 10 + 1] END AS ending FROM orders")
def en_ordinal(df):
    return df.select("o_orderkey", N.en_ordinal(F.col("o_orderkey")).alias("spoken"), N.en_suffix(F.col("o_orderkey")).alias("ending"))


@query("orders", f"SELECT o_orderkey, {S.en_counted(_PRICE[0], 'dollar')} || ' ' || {S.en_counted(_PRICE[1], 'cent')} AS spoken FROM orders")
def en_currency(df):
    return df.select("o_orderkey", N.en_dollars(_token("o_totalprice", ".")).alias("spoken"))


@query("orders", f"SELECT o_orderkey, concat_ws(' ', {S.ru_counted(_PRICE[0], russian.ROUBLE)}, CASE WHEN {_PRICE[1]} > 0 THEN {S.ru_counted(_PRICE[1], russian.KOPECK, True)} END) AS spoken FROM orders")
def ru_currency(df):
    return df.select("o_orderkey", N.ru_roubles(_token("o_totalprice", ",")).alias("spoken"))


@query("lineitem", f"SELECT l_orderkey, l_linenumber, {S.en('round(l_discount * 100)::BIGINT')} || ' percent' AS spoken FROM lineitem")
def en_percent(df):
    return df.select("l_orderkey", "l_linenumber", N.en_percent(F.round(F.col("l_discount") * 100).cast("bigint").cast("string")).alias("spoken"))


@query("lineitem", f"SELECT l_orderkey, l_linenumber, {S.ru_counted('round(l_discount * 100)::BIGINT', russian.PERCENT)} AS spoken FROM lineitem")
def ru_percent(df):
    return df.select("l_orderkey", "l_linenumber", N.ru_percent(F.round(F.col("l_discount") * 100).cast("bigint").cast("string")).alias("spoken"))


@query("part", f"SELECT p_partkey, {S.en_counted('p_size', 'kilogram')} AS kg, {S.en(_RETAIL[0])} || ' point ' || {S.en_digits(f'lpad({_RETAIL[1]}::VARCHAR, 2, ' + chr(39) + '0' + chr(39) + ')')} || ' centimeters' AS cm FROM part")
def en_measure(df):
    return df.select("p_partkey", N.en_measure(F.col("p_size").cast("string"), F.lit("kg")).alias("kg"), N.en_measure(_token("p_retailprice", "."), F.lit("cm")).alias("cm"))


@query("part", f"SELECT p_partkey, {S.ru_counted('p_size', ('километр', 'километра', 'километров'))} AS km, {S.ru_decimal2(*_RETAIL)} || ' миллиметра' AS mm FROM part")
def ru_measure(df):
    return df.select("p_partkey", N.ru_measure(F.col("p_size").cast("string"), "км").alias("km"), N.ru_measure(_token("p_retailprice", ","), "мм").alias("mm"))


@query("orders", f"SELECT o_orderkey, monthname(o_orderdate) || ' ' || {S.en_ordinal_below_100('day(o_orderdate)')} || ', ' || {S.en('year(o_orderdate)')} AS spoken FROM orders")
def en_date(df):
    return df.select("o_orderkey", N.en_date(F.col("o_orderdate")).alias("spoken"))


@query("orders", f"SELECT o_orderkey, concat_ws(' ', CASE WHEN day(o_orderdate) = 4 THEN 'четвертое' ELSE {S.ru_ordinal_below_100('day(o_orderdate)', 'neuter')} END, {S.words(russian.MONTHS)}[month(o_orderdate)], {S.ru_year('year(o_orderdate)', 'genitive')}, 'года') AS spoken FROM orders")
def ru_date(df):
    return df.select("o_orderkey", N.ru_date(F.col("o_orderdate")).alias("spoken"))


@query("orders", f"SELECT o_orderkey, {S.en_year('1000 + o_orderkey % 1100')} AS spoken FROM orders")
def en_year(df):
    return df.select("o_orderkey", N.en_year(F.lit(1000) + F.col("o_orderkey") % 1100).alias("spoken"))


@query("orders", "SELECT o_orderkey, " + ", ".join(f"{S.ru_year('(1000 + o_orderkey % 9000)', c)} AS {c}" for c in ("nominative", "genitive", "locative")) + " FROM orders")
def ru_year_cases(df):
    return df.select("o_orderkey", *[N.ru_year(F.lit(1000) + F.col("o_orderkey") % 9000, c).alias(c) for c in ("nominative", "genitive", "locative")])


@query("events", f"SELECT event_id, {S.en_counted('hour(ts)', 'hour')} || ' ' || {S.en_counted('minute(ts)', 'minute')} AS spoken FROM events")
def en_time(df):
    return df.select("event_id", N.en_clock(F.hour("ts"), F.minute("ts")).alias("spoken"))


@query("events", f"SELECT event_id, {S.ru_counted('hour(ts)', russian.HOUR)} || ' ' || {S.ru_counted('minute(ts)', russian.MINUTE, True)} AS spoken FROM events")
def ru_time(df):
    return df.select("event_id", N.ru_clock(F.hour("ts"), F.minute("ts")).alias("spoken"))


@query("part", f"SELECT p_partkey, {S.en(_RETAIL[0])} || ' point ' || {S.en_digits(f'lpad({_RETAIL[1]}::VARCHAR, 2, ' + chr(39) + '0' + chr(39) + ')')} AS spoken FROM part")
def en_decimal(df):
    return df.select("p_partkey", N.en_decimal(_token("p_retailprice", ".")).alias("spoken"))


@query("part", f"SELECT p_partkey, {S.ru_decimal2(*_RETAIL)} AS spoken FROM part")
def ru_decimal(df):
    return df.select("p_partkey", N.ru_decimal(_token("p_retailprice", ",")).alias("spoken"))


@query("part", f"""SELECT p_partkey, concat_ws(' ', CASE WHEN p_partkey % 1000 >= 100 THEN {S.words(russian.GENITIVE_HUNDREDS)}[p_partkey % 1000 // 100 + 1] END,
  CASE WHEN p_partkey % 100 >= 20 THEN {S.words(russian.GENITIVE_TENS)}[p_partkey % 100 // 10 + 1] END,
  CASE WHEN p_partkey % 100 >= 20 AND p_partkey % 10 > 0 THEN {S.words(russian.GENITIVE_UNITS)}[p_partkey % 10 + 1] WHEN p_partkey % 100 < 20 AND (p_partkey % 100 > 0 OR p_partkey % 1000 = 0) THEN {S.words(russian.GENITIVE_UNITS)}[p_partkey % 100 + 1] END) AS spoken FROM part""")
def ru_genitive(df):
    return df.select("p_partkey", N.ru_genitive(F.col("p_partkey") % 1000).alias("spoken"))


@query("lineitem", f"SELECT l_orderkey, l_linenumber, {S.ru_counted('l_quantity::BIGINT', ('ошибка', 'ошибки', 'ошибок'), True)} AS spoken FROM lineitem")
def ru_plural_forms(df):
    return df.select("l_orderkey", "l_linenumber", N.ru_noun(F.col("l_quantity").cast("bigint"), ("ошибка", "ошибки", "ошибок")).alias("spoken"))


# Text primitives

_SP = "[ \\t\\n\\r\\x0B\\f\\x{00A0}\\x{202F}]"


@query("documents", f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^{_SP}+|{_SP}+$', '', 'g'), '{_SP}+([,.;:!?])', '\\1', 'g'), '{_SP}+', ' ', 'g') AS cleaned FROM documents")
def clean_spacing(df):
    return df.select("doc_id", T.clean_spacing(F.col("text")).alias("cleaned"))


@query("conversations", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\\x{0400}-\\x{052F}]') THEN 'russian' ELSE 'english' END AS language FROM conversations")
def detect_language(df):
    return df.select("conv_id", "turn", T.detect_language(F.col("text")).alias("language"))


@query("documents", "SELECT doc_id, length(regexp_replace(text, '[^\\x{0400}-\\x{052F}]', '', 'g'))::INT AS cyrillic, length(regexp_replace(text, '[^A-Za-z\\x{00C0}-\\x{024F}]', '', 'g'))::INT AS latin FROM documents")
def script_counts(df):
    cyrillic, latin = T.script_counts(F.col("text"))
    return df.select("doc_id", cyrillic.alias("cyrillic"), latin.alias("latin"))


@query("orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'english' ELSE 'russian' END AS dominant FROM orders")
def dominant_language(df):
    text = F.when(F.col("o_orderkey") % 3 == 0, "Order заказ v1.2.3 is ready").otherwise(F.concat(F.lit("Заказ order "), F.lit("https://example.com/long-latin-path-"), F.col("o_orderkey"), F.lit(" готов")))
    return df.select("o_orderkey", T.dominant_language(text).alias("dominant"))


_TOKEN_SQL = "(?:[\\x{0400}-\\x{052F}A-Za-z\\x{00C0}-\\x{024F}+#_]|[0-9]+(?:\\.[0-9]+)*)+"


_BOTH = "translate(text, 'aeinrstAEINRST', 'аеинрстАЕИНРСТ')"


def _stripped(text: str) -> str:
    for pattern in technical.CLASSES.values():
        text = f"regexp_replace({text}, '{pattern.replace(chr(92) + 'u0080-' + chr(92) + 'uffff', chr(92) + 'x{0080}-' + chr(92) + 'x{FFFF}')}', ' ', 'g')"
    return text


@query("documents", f"""SELECT doc_id, CASE WHEN c > 0 AND c >= l THEN 'russian' ELSE 'english' END AS dominant FROM (SELECT doc_id, length(regexp_replace(t, '[^\\x{{0400}}-\\x{{052F}}]', '', 'g')) AS c,
 length(regexp_replace(t, '[^A-Za-z\\x{{00C0}}-\\x{{024F}}]', '', 'g')) AS l FROM (SELECT doc_id, {_stripped(_BOTH)} AS t FROM documents))""")
def dominant_script(df):
    """Documents with about half of their letters put into Cyrillic, by the script that most letters outside of technical spans have."""
    return df.select("doc_id", T.dominant_language(F.expr(_BOTH)).alias("dominant"))


@query("conversations", f"SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '{_TOKEN_SQL}')) AS token FROM conversations) GROUP BY 1")
def token_frequency(df):
    return df.select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _places(table: str, key: str, pattern: str) -> str:
    """SQL rows (key, pos, b, e, hit) of a pattern's matches, in bytes."""
    return f"""(SELECT {key}, i - 1 AS pos, list_sum(list_transform(gaps[1:i], lambda g: strlen(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: strlen(h))), 0) AS b, b + strlen(hits[i]) AS e, hits[i] AS hit
 FROM (SELECT {key}, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS gaps FROM {table})))"""


@query("benchmark", f"SELECT item_id, pos::INT AS pos, b::BIGINT AS \"begin\", e::BIGINT AS \"end\", hit AS token FROM {_places('benchmark', 'item_id', _TOKEN_SQL)}")
def token_offsets(df):
    return spans.token_spans(df, "item_id")


_CLASS_SQL = {c: p.replace("\\u0080-\\uffff", "\\x{0080}-\\x{FFFF}") for c, p in technical.CLASSES.items()}


@query("documents", "SELECT doc_id, class, surface FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS class, unnest(regexp_extract_all(text, '{p}')) AS surface FROM documents" for c, p in _CLASS_SQL.items()) + ")")
def technical_spans_by_class(df):
    return spans.technical_spans(df, "doc_id").select("doc_id", "class", "surface")


@query("documents", "WITH s AS (" + " UNION ALL ".join(f"SELECT doc_id, b, e FROM {_places('documents', 'doc_id', p)}" for p in _CLASS_SQL.values()) + """),
 m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY b, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s),
 i AS (SELECT *, sum(CASE WHEN last IS NULL OR b > last THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b, e DESC ROWS UNBOUNDED PRECEDING) AS island FROM m)
 SELECT doc_id, min(b)::BIGINT AS \"begin\", max(e)::BIGINT AS \"end\" FROM i GROUP BY doc_id, island""")
def technical_spans_merged(df):
    return spans.merge_spans(spans.technical_spans(df, "doc_id"), "doc_id")


@query("documents", "SELECT doc_id, length(regexp_replace(text, '[^aeiouyAEIOUYаеёиоуыэюяАЕЁИОУЫЭЮЯ]', '', 'g'))::INT AS vowels, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents")
def vowels_and_folding(df):
    return df.select("doc_id", T.vowel_count(F.col("text")).alias("vowels"), T.case_fold(F.col("text")).alias("folded"))


@query("orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN o_orderkey::INT WHEN o_orderkey % 4 = 2 THEN NULL ELSE -o_orderkey::INT END AS n FROM orders")
def bounded_integers(df):
    k = F.col("o_orderkey")
    token = F.when(k % 4 == 0, F.concat(F.lit("1"), F.lpad(k.cast("string"), 9, "0"))).when(k % 4 == 1, F.concat(F.lit("+"), k)).when(k % 4 == 2, F.concat(k, F.lit(" "))).otherwise(F.concat(F.lit("-"), k))
    return df.select("o_orderkey", T.whole_number(token).alias("n"))


@query("orders", "SELECT o_orderkey, try_cast(format('{:04d}-{:02d}-{:02d}', 1900 + o_orderkey % 300, o_orderkey % 14, o_orderkey % 33) AS DATE) IS NOT NULL AS valid FROM orders")
def calendar_validity(df):
    k = F.col("o_orderkey")
    return df.select("o_orderkey", T.valid_date(k % 33, k % 14, 1900 + k % 300).alias("valid"))


@query("documents", "SELECT doc_id, true AS valid, sha256(text) AS sha256, strlen(text)::INT AS bytes FROM documents")
def text_assets(df):
    return df.select("doc_id", T.utf8_valid(F.col("text").cast("binary")).alias("valid"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))


@query("conversations", "SELECT gram, count(*)::BIGINT AS n FROM (SELECT unnest(flatten(list_transform(range(3, 7), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: substring(w, i, k))))) AS gram FROM (SELECT '<' || unnest(regexp_extract_all(text, '" + _TOKEN_SQL + "')) || '>' AS w FROM conversations)) GROUP BY 1")
def character_ngrams(df):
    word = df.select(F.explode(T.tokens(F.col("text"))).alias("w"))
    return word.select(F.explode(T.ngrams(F.col("w"), 3, 6)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("embeddings", "WITH e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) SELECT (vec_id % 7)::BIGINT AS bag, dim::INT AS dim, round(avg(x::DOUBLE), 6) AS mean FROM e GROUP BY 1, 2")
def ngram_mean_embedding(df):
    each = df.select((F.col("vec_id") % 7).alias("bag"), F.posexplode("embedding").alias("dim", "x"))
    return each.groupBy("bag", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("embeddings", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best, round(exp(0) / list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS top FROM embeddings")
def class_choice(df):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return df.select("vec_id", T.argmax(F.col("embedding")).alias("best"), F.round(F.array_max(T.softmax(x)), 6).alias("top"))


@query("events", "SELECT event_type, min(value) AS least, avg(value) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY 1")
def latency_percentiles(df):
    return audit.latency(df, "value", "event_type")


# Dictionary and ownership

ENTRIES = (
    Entry("The", "thuh", "exact", 1),
    Entry("the", "thee", "folded"),
    Entry("DE", "day", "folded", 1),
    Entry("la", "lah", "exact"),
    Entry("und", "oont", "exact", 0),
    Entry("of the", "uv thuh", "phrase"),
    Entry("the of the", "thee uv thuh", "phrase"),
    Entry("de la", "duh lah", "phrase"),
    Entry("in der", "in dair", "phrase"),
)
_VALUES = ", ".join(f"({i}, '{e.pattern}', '{e.pronunciation}', '{e.match}', {'NULL' if e.stressed_vowel is None else e.stressed_vowel})" for i, e in enumerate(ENTRIES))
_DICT = f"(VALUES {_VALUES}) AS d(ord, pattern, pronunciation, match, vowel)"


@query("conversations", f"""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{_TOKEN_SQL}')) AS token FROM conversations),
 b AS (SELECT token, min(ord) AS ord FROM (SELECT DISTINCT token FROM t) JOIN {_DICT} ON match = 'exact' AND token = pattern OR match = 'folded' AND translate(token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = lower(pattern) GROUP BY 1)
 SELECT conv_id, turn, token, pronunciation, vowel::INT AS stressed_vowel FROM t JOIN b USING (token) JOIN {_DICT} USING (ord)""")
def dictionary_token_join(df):
    toks = df.select("conv_id", "turn", F.explode(T.tokens(F.col("text"))).alias("token"))
    found = dictionary.lookup_tokens(toks, files.frame(df.sparkSession, ENTRIES))
    return found.where("entry is not null").select("conv_id", "turn", "token", "pronunciation", "stressed_vowel")


_PHRASES = [e for e in ENTRIES if e.match == "phrase"]
_GRAMS = " UNION ALL ".join(f"SELECT a.doc_id, a.b, t{n - 1}.e, '{e.pattern}' AS phrase, '{e.pronunciation}' AS pronunciation FROM k a " + " ".join(f"JOIN k t{j} ON t{j}.doc_id = a.doc_id AND t{j}.pos = a.pos + {j} AND t{j}.hit = '{w}' AND t{j}.gap = ' '" for j, w in enumerate(e.pattern.split()) if j) + f" WHERE a.hit = '{e.pattern.split()[0]}'" for e in _PHRASES for n in [len(e.pattern.split())])


_PHRASE_SQL = f"""WITH RECURSIVE k AS (SELECT doc_id, pos, b, e, hit, gap FROM (SELECT doc_id, pos, b, e, hit, gaps[pos + 1] AS gap FROM {_places('documents', 'doc_id', _TOKEN_SQL).replace('hits[i] AS hit', 'hits[i] AS hit, gaps')})),
 h AS (SELECT doc_id, b, max(e) AS e, arg_max(phrase, e) AS phrase, arg_max(pronunciation, e) AS pronunciation FROM ({_GRAMS}) GROUP BY 1, 2),
 c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS i FROM h),
 g AS (SELECT c.*, true AS taken, c.e AS reach FROM c WHERE i = 1 UNION ALL
   SELECT c.*, c.b >= g.reach, CASE WHEN c.b >= g.reach THEN c.e ELSE g.reach END FROM g JOIN c ON c.doc_id = g.doc_id AND c.i = g.i + 1)"""


@query("documents", _PHRASE_SQL + """ SELECT doc_id, b::BIGINT AS "begin", e::BIGINT AS "end", phrase, pronunciation FROM g WHERE taken""")
def dictionary_phrase_join(df):
    return dictionary.match_phrases(df, files.frame(df.sparkSession, ENTRIES), "doc_id")


_TURNS = "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE text IS NOT NULL)"


@query("conversations", _PHRASE_SQL.replace("FROM documents", f"FROM {_TURNS}") + f""", z AS (SELECT doc_id, pos, gap, hit, b, e FROM k),
 c2 AS (SELECT z.doc_id, z.pos, z.gap, z.hit, h.b AS hb, h.pronunciation FROM z LEFT JOIN (SELECT * FROM g WHERE taken) h ON h.doc_id = z.doc_id AND h.b <= z.b AND z.e <= h.e),
 o AS (SELECT token, min(ord) AS ord FROM (SELECT DISTINCT hit AS token FROM z) JOIN {_DICT} ON match = 'exact' AND token = pattern OR match = 'folded' AND translate(token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = lower(pattern) GROUP BY 1),
 w AS (SELECT doc_id, pos, CASE WHEN hb IS NOT NULL AND lag(hb) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT DISTINCT FROM hb THEN '' WHEN hb IS NOT NULL THEN gap || c2.pronunciation ELSE gap || coalesce(q.pronunciation, hit) END AS said FROM c2 LEFT JOIN o ON o.token = hit LEFT JOIN {_DICT.replace(' AS d(', ' AS q(')} USING (ord)),
 r AS (SELECT doc_id, regexp_split_to_array(text, '{_TOKEN_SQL}')[-1] AS tail FROM {_TURNS} x)
 SELECT (doc_id // 1000)::BIGINT AS conv_id, (doc_id % 1000)::INT AS turn, coalesce(string_agg(said, '' ORDER BY pos), '') || any_value(tail) AS pronunciation_text FROM r LEFT JOIN w USING (doc_id) GROUP BY doc_id""")
def pronounced_conversations(df):
    """Turns with what a dictionary of words and phrases says in place of theirs."""
    from vocalis.operators.pronounce import pronounce

    keyed = df.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    out = pronounce(keyed, files.frame(df.sparkSession, ENTRIES), "k")
    return out.select(F.expr("k div 1000").alias("conv_id"), (F.col("k") % 1000).cast("int").alias("turn"), "pronunciation_text")


@query("orders", "SELECT o_orderkey, [" + ",".join(f"'{k}'" for k in russian.INITIALISMS) + ",'ЦБ'][o_orderkey % 8 + 1] AS token, [" + ",".join(f"'{v}'" for v in russian.INITIALISMS.values()) + ", NULL][o_orderkey % 8 + 1] AS spoken, ['C plus plus', NULL][o_orderkey % 2 + 1] AS reading FROM orders")
def readings(df):
    k = F.col("o_orderkey")
    token = F.element_at(F.array(*[F.lit(x) for x in (*russian.INITIALISMS, "ЦБ")]), (k % 8 + 1).cast("int"))
    from vocalis.kernel.english import INITIAL_READINGS

    return df.select("o_orderkey", token.alias("token"), T.initialism(token).alias("spoken"), T.initial_reading(F.when(k % 2 == 0, "C++").otherwise("C#"), INITIAL_READINGS).alias("reading"))


@query("orders", "SELECT o_orderkey, number, owner FROM (SELECT o_orderkey, unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, '7']) AS number, unnest(['russian', 'english', NULL]) AS owner FROM orders)")
def owner_asof(df):
    text = F.concat(F.lit("Заказ "), F.col("o_orderkey"), F.lit(" for number "), F.col("o_custkey"), F.lit(" клиент. 7."))
    return spans.owners(df.select("o_orderkey", text.alias("text")), "o_orderkey").select("o_orderkey", "number", "owner")


@query("lineitem", "SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(l_linenumber * 10 + l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS last FROM lineitem) WHERE last > l_linenumber * 10")
def colliding_spans(df):
    """Spans made of line numbers and quantities that begin inside the span before."""
    s = df.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10).cast("bigint").alias("begin"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("bigint")).alias("end"))
    return spans.colliding(s, "l_orderkey").select("l_orderkey", "l_linenumber")


_LINES = "(SELECT l_orderkey AS k, l_linenumber::BIGINT * 10 AS b, l_linenumber::BIGINT * 10 + l_quantity::BIGINT AS e, l_partkey % 3 = 0 AS side FROM lineitem)"


def _two_sides(df):
    s = df.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10).cast("bigint").alias("begin"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("bigint")).alias("end"), (F.col("l_partkey") % 3 == 0).alias("side"))
    return s.where("side").drop("side"), s.where("not side").drop("side")


@query("lineitem", f'SELECT k, b AS "begin", e AS "end" FROM {_LINES} x WHERE side AND EXISTS (SELECT 1 FROM {_LINES} y WHERE NOT y.side AND y.k = x.k AND y.b < x.e AND x.b < y.e)')
def spans_overlapping(df):
    return spans.overlapping(*_two_sides(df), "k")


@query("lineitem", f'SELECT k, b AS "begin", e AS "end" FROM {_LINES} x WHERE side AND NOT EXISTS (SELECT 1 FROM {_LINES} y WHERE NOT y.side AND y.k = x.k AND y.b < x.e AND x.b < y.e)')
def spans_apart(df):
    return spans.apart(*_two_sides(df), "k")


@query("lineitem", f'SELECT k, "begin", "end", range_begin, range_end FROM (SELECT x.k, x.b AS "begin", x.e AS "end", y.b AS range_begin, y.e AS range_end, row_number() OVER (PARTITION BY x.k, x.b, x.e ORDER BY y.b, y.e) AS n FROM (SELECT DISTINCT k, b, e FROM {_LINES} WHERE side) x LEFT JOIN {_LINES} y ON NOT y.side AND y.k = x.k AND y.b <= x.b AND x.e <= y.e) WHERE n = 1')
def spans_containing(df):
    words, ranges = _two_sides(df)
    return spans.containing(words.distinct(), ranges, "k")


_TECHNICAL_SQL = " UNION ALL ".join(f"SELECT doc_id, b, e FROM {_places('documents', 'doc_id', p)}" for p in _CLASS_SQL.values())


@query("documents", f"""WITH s AS ({_TECHNICAL_SQL}), w AS (SELECT doc_id, pos, b, e, hit FROM {_places('documents', 'doc_id', _TOKEN_SQL)} WHERE doc_id IN (SELECT doc_id FROM s))
 SELECT w.doc_id, w.pos::INT AS pos, w.b::BIGINT AS "begin", w.e::BIGINT AS "end", hit AS token, min(s.b)::BIGINT AS range_begin, arg_min(s.e, (s.b, s.e))::BIGINT AS range_end
 FROM w JOIN s ON s.doc_id = w.doc_id AND s.b <= w.b AND w.e <= s.e GROUP BY ALL""")
def tokens_in_technical(df):
    """Word tokens that lie inside of a technical span, with the first span that holds them."""
    technical = spans.technical_spans(df, "doc_id").select("doc_id", "begin", "end")
    tokens = spans.token_spans(df.join(technical.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    return spans.containing(tokens, technical, "doc_id", held=True)


@query("lineitem", f'SELECT k, min(b) AS "begin", max(e) AS "end" FROM (SELECT *, sum(CASE WHEN last IS NULL OR b >= last THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY b, e DESC ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(e) OVER (PARTITION BY k ORDER BY b, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM {_LINES})) GROUP BY k, island')
def spans_united(df):
    """Two streams of spans as one, merged where they overlap."""
    return spans.merge_spans(spans.union_all(list(_two_sides(df))), "k", touching=False)


@query("orders", "SELECT o_orderkey, 'Order ' || o_custkey || ' of ' || upper(o_orderstatus) || '!' AS text FROM orders")
def source_edits(df):
    at = lambda a, b, said: F.struct(F.lit(a).cast("bigint").alias("begin"), F.lit(b).cast("bigint").alias("end"), said.alias("said"))
    edits = F.array(at(9, 10, F.concat(F.lit(" "), F.upper("o_orderstatus"))), at(6, 7, F.concat(F.col("o_custkey"), F.lit(" "))))
    return df.select("o_orderkey", spans.splice(F.lit("Order ?of?!"), edits).alias("text"))


# Audit

_SIZE = f"SELECT p_partkey AS row_no, p_partkey % 4 AS kind, p_size AS n, {S.en('p_size')} AS en, {S.ru_counted('p_size', ('килограмм', 'килограмма', 'килограммов'))} AS kg FROM part"
_AUDIT = f"""WITH p AS ({_SIZE}),
q AS (SELECT row_no, 'c-' || row_no AS id, ['english', 'english', 'russian', 'english'][kind + 1] AS language, ['percent', 'clock', 'measure', 'dozen'][kind + 1] AS category, ['normalize', 'preserve', 'normalize', 'normalize'][kind + 1] AS exp,
 [n || '% off', 'at 25:' || (n + 9), n || ' кг муки', n || ' boxes'][kind + 1] AS text, [en || ' percent off', 'at 25:' || (n + 9), kg || ' муки', CASE WHEN n = 12 THEN 'a dozen' ELSE en END || ' boxes'][kind + 1] AS want,
 [en || ' percent off', 'at 25:' || (n + 9), kg || ' муки', en || ' boxes'][kind + 1] AS seen FROM p),
c AS (SELECT *, CASE WHEN seen = want AND exp = 'preserve' THEN 'justified_preservation' WHEN seen = want THEN 'correct_transformation' WHEN seen = text THEN 'unnecessary_refusal' ELSE 'incorrect_or_partial' END AS outcome FROM q)"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of one case for each part: written and expected forms of its size, judged by what the normaliser says."""
    n = F.col("p_size")
    en, of = N.en_cardinal(n), lambda *forms: F.element_at(F.array(*forms), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = of(F.concat(n, F.lit("% off")), F.concat(F.lit("at 25:"), n + 9), F.concat(n, F.lit(" кг муки")), F.concat(n, F.lit(" boxes")))
    kilos = N.ru_counted(n, ("килограмм", "килограмма", "килограммов"))
    want = of(F.concat(en, F.lit(" percent off")), text, F.concat(kilos, F.lit(" муки")), F.concat(F.when(n == 12, "a dozen").otherwise(en), F.lit(" boxes")))
    named = lambda names: of(*[F.lit(x) for x in names.split()])
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_no"), F.concat(F.lit("c-"), "p_partkey").alias("id"), named("english english russian english").alias("language"), named("percent clock measure dozen").alias("category"), named("normalize preserve normalize normalize").alias("expectation"), text.alias("input"), want.alias("expected"))
    seen = F.when(F.col("language") == "russian", normalize_text(F.when(F.col("language") == "russian", F.col("input")), Options(language="russian"))).otherwise(normalize_text(F.when(F.col("language") == "english", F.col("input")), Options(language="english")))
    return rows.withColumn("observed", seen).withColumn("outcome", audit.outcome(F.col("expectation"), F.col("input"), F.col("expected"), F.col("observed")))


def _audit_query(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(_audited(spark, sf_dir))
    ORACLE_SQL[name] = _AUDIT + sql


_audit_query("quality_outcomes", lambda c: c.select("id", "observed", "outcome"), " SELECT id, seen AS observed, outcome FROM c")
_audit_query("quality_grouping_sets", audit.counts, " SELECT CASE grouping_id(language, category, outcome) WHEN 6 THEN 'all' WHEN 2 THEN 'language' ELSE 'category' END AS level, coalesce(language, category, '') AS name, outcome, count(*)::BIGINT AS n FROM c GROUP BY GROUPING SETS ((outcome), (language, outcome), (category, outcome))")
_audit_query("quality_diversity", audit.diversity, " SELECT count(DISTINCT id)::BIGINT AS ids, count(DISTINCT category)::BIGINT AS categories, count(DISTINCT language)::BIGINT AS languages FROM c")
_audit_query("first_mismatches", lambda c: audit.first_mismatches(c).select("id", "outcome"), " SELECT id, outcome FROM c WHERE outcome IN ('unnecessary_refusal', 'incorrect_or_partial') ORDER BY row_no LIMIT 100")


def _snap(cases: str) -> str:
    return f"""SELECT 'cases' AS tag, '' AS key, count(*)::VARCHAR AS value FROM {cases} UNION ALL SELECT 'outcome', outcome, count(*)::VARCHAR FROM {cases} GROUP BY outcome
 UNION ALL SELECT 'mismatch', id, category || ':' || outcome FROM {cases} WHERE outcome IN ('unnecessary_refusal', 'incorrect_or_partial')"""


def _snapshot_diff(cases: DataFrame) -> DataFrame:
    """Against the snapshot of the corpus without its last category; mismatches of cases before the 100th are approved."""
    old = audit.snapshot(cases.where("category <> 'dozen'"))
    approved = cases.where("row_no < 100").select(F.lit("mismatch").alias("tag"), F.col("id").alias("key"))
    return audit.unapproved(audit.difference(old, audit.snapshot(cases)), approved)


_audit_query("quality_snapshot", audit.snapshot, " " + _snap("c"))
_audit_query("snapshot_diff", _snapshot_diff, f""", s AS ({_snap("c")}), d AS (SELECT * FROM c WHERE category <> 'dozen'), o AS (SELECT tag, key, value AS old FROM ({_snap("d")}))
 SELECT coalesce(o.tag, s.tag) AS tag, coalesce(o.key, s.key) AS key, old, s.value AS new, CASE WHEN old IS NULL THEN 'added' WHEN s.value IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM o FULL JOIN s ON o.tag = s.tag AND o.key = s.key WHERE old IS DISTINCT FROM s.value AND NOT (coalesce(o.tag, s.tag) = 'mismatch' AND coalesce(o.key, s.key) IN (SELECT id FROM c WHERE row_no < 100))""")


# The whole normaliser


@query("documents")
def normalize_documents(df):
    r = normalize(F.col("text"), fields=("normalized_text", "pronunciation_text", "n_words", "n_warnings"))
    counts = [F.coalesce(f"r.{c}", F.size(F.lit(None).cast("array<int>"))).alias(c) for c in ("n_words", "n_warnings")]
    return df.select("doc_id", r.alias("r")).select("doc_id", "r.normalized_text", "r.pronunciation_text", *counts)


@query("conversations")
def normalize_conversations(df):
    return df.select("conv_id", "turn", normalize_text(F.col("text")).alias("normalized_text"))


@query("documents")
def document_warnings(df):
    """Every diagnostic as a row; each range is reported once a code."""
    each = df.select("doc_id", normalize(F.col("text"), fields=("warnings",)).alias("r")).select("doc_id", F.explode("r.warnings").alias("w"))
    return each.select("doc_id", "w.code", F.col("w.offset").alias("offset"), F.col("w.length").alias("length")).dropDuplicates()


@query("pages")
def normalize_pages(df):
    """Visible text of pages, then the normaliser."""
    visible = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->", " "), "(?s)<[^>]*>", " ")
    return df.select("page_id", normalize_text(visible).alias("normalized_text"))


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """These columns, rows dealt evenly over all cores: a file of short rows is few tasks, whatever a row costs."""
    spark = df.sparkSession
    return df.select(*columns).repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


@query("part", f"SELECT p_partkey, 'Size ' || {S.en_counted('p_size', 'kilometer')} || ', price ' || {S.en_counted(_RETAIL[0], 'dollar')} || ' ' || {S.en_counted(_RETAIL[1], 'cent')} || '.' AS spoken FROM part")
def normalize_synthetic_en(df):
    text = F.concat(F.lit("Size "), F.col("p_size"), F.lit(" km , price $"), _token("p_retailprice", "."), F.lit("."))
    return _dealt(df, "p_partkey", "p_size", "p_retailprice").select("p_partkey", normalize_text(text, Options(language="english")).alias("spoken"))


@query("part", f"SELECT p_partkey, 'Вес ' || {S.ru_counted('p_size', ('килограмм', 'килограмма', 'килограммов'))} || ', цена ' || concat_ws(' ', {S.ru_counted(_RETAIL[0], russian.ROUBLE)}, CASE WHEN {_RETAIL[1]} > 0 THEN {S.ru_counted(_RETAIL[1], russian.KOPECK, True)} END) || '.' AS spoken FROM part")
def normalize_synthetic_ru(df):
    text = F.concat(F.lit("Вес "), F.col("p_size"), F.lit(" кг , цена "), _token("p_retailprice", ","), F.lit(" руб."))
    return _dealt(df, "p_partkey", "p_size", "p_retailprice").select("p_partkey", normalize_text(text, Options(language="russian")).alias("spoken"))


@query("documents", "SELECT doc_id, run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM documents) WHERE length(run) > 9")
def long_numbers(df):
    """Runs of more than nine digits, which are never numbers."""
    return df.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("run")).where(F.length("run") > 9)


@query("nation", f"SELECT 'count' AS category, 'There are ' || n_nationkey || ' items' AS input, 'There are ' || {S.en('n_nationkey')} || ' items' AS expected FROM nation UNION ALL SELECT 'share', n_nationkey || '%', {S.en('n_nationkey')} || ' percent' FROM nation")
def generated_corpus(df):
    from vocalis.sources.corpora import generate

    templates = df.sparkSession.createDataFrame([("count", "There are %s items", "There are %s items"), ("share", "%s%", "%s percent")], "category string, template string, spoken_template string")
    numbers = df.select(F.col("n_nationkey").cast("string").alias("written"), N.en_cardinal(F.col("n_nationkey")).alias("spoken"))
    return generate(templates, numbers)
