"""Queries of the verbalising plan, and SQL that reads the same texts by its own windows over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalis.kernel import english, readers, russian
from vocalis.operators import lexemes as L
from vocalis.operators import verbalise as V
from vocalis.plans import sql_words as S
from vocalis.plans.library import _SP, _dealt, query


def _re2(pattern: str) -> str:
    return pattern.replace("\u0080-￿", "\\x{0080}-\\x{FFFF}").replace("'", "''")


def _clean(text: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({text}, '^{_SP}+|{_SP}+$', '', 'g'), '{_SP}+([,.;:!?])', '\\1', 'g'), '{_SP}+', ' ', 'g')"


def _among(column: str, values) -> str:
    return f"coalesce({column} IN ({', '.join(repr(v) for v in values)}), false)"


_KIND = "CASE WHEN regexp_full_match(lex, '[0-9]{1,3}(\\.[0-9]{1,3}){3}') THEN 't' " + " ".join(f"WHEN regexp_matches(lex, '{_re2(p)}') THEN '{k}'" for k, p in L.KINDS.items()) + " ELSE 'o' END"
_MONTHS = "[" + ", ".join(f"'{m}'" for m in english.MONTHS) + "]"
_UNITS = "CASE r1 " + " ".join(f"WHEN '{w}' THEN '{spoken}'" for spoken, written in english.MEASURES.items() for w in written.split()) + " END"
_STEMS = f"regexp_matches(r1, '^(?:{'|'.join(readers.ENGLISH_STEMS)})') AND r1k IN ('w', 't') AND r1 NOT IN ({', '.join(repr(w) for w in readers.ENGLISH_SURFACES)})"
_ALOUD = f"({S.en('n')} || CASE WHEN fraction <> '' THEN ' point ' || {S.en_digits('fraction')} ELSE '' END)"
_MINUS = "CASE WHEN sign = '-' THEN 'minus ' ELSE '' END"
_CENTS = "rpad(fraction, 2, '0')::BIGINT"
_ORDINAL = f"CASE WHEN n % 1000 = 0 THEN CASE WHEN n = 0 THEN 'zeroth' ELSE {S.en('n')} || 'th' END WHEN n % 100 = 0 THEN {S.en('n')} || 'th' ELSE concat_ws(' ', CASE WHEN n >= 100 THEN {S.en('(n - n % 100)')} END, {S.en_ordinal_below_100('n % 100')}) END"
_DAY = S.en_ordinal_below_100("n")


def _links() -> dict[str, str]:
    """How far surfaces go on, as SQL conditions on a lexeme (k, lex, g) and those after it (k1, x1, g1; k2, g2)."""
    connector = lambda c: f"coalesce({c} IN ('p', 'c', 's'), false)"
    glued = f"NOT g1 AND (k1 IN ('n', 'w', 't', 'h') OR {connector('k1')} AND past.k IN ('n', 'w', 't', 'h') AND past.gs = gs)"
    number = "(k2 = 'n' OR k2 = 'w' AND NOT g2)"
    out = {}
    for name, signs in L.MATRIX.items():
        some = ", ".join(f"'{s}'" for s in signs) or "''"
        near = "beyond.gs <= gs + CASE WHEN k = 'p' AND (x0 LIKE '%.' OR k1 = 'p') OR k <> 'p' AND (lex LIKE '%.' OR k2 = 'p') THEN 1 ELSE 0 END"
        spaced = f"OR x1 IN ({some}) AND NOT {connector('k')} AND {number} OR lex IN ({some}) AND k1 = 'n' OR k1 = 'h' AND k NOT IN ('o', 'e') OR (k1 = 'p' AND NOT g1 OR k = 'p') AND beyond.lex IN ({some}) AND {near} AND beyond.bears"
        out[name] = f"coalesce(({glued} {spaced if signs else ''}) AND k <> 'e', false)"
    return out


def english_sql(table: str, key: str, text: str = "text") -> str:
    """SQL common tables that end in spoken (r, key, said) for English texts: whole texts as lexemes, no islands."""
    ends = ", ".join(f"first_value(CASE WHEN NOT ({cond}) THEN pos END IGNORE NULLS) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e_{name}" for name, cond in _links().items())
    ahead = ", ".join(f"lead({c}, {j}) OVER o AS r{j}{s}" for j in (1, 2, 3) for c, s in (("lex", ""), ("k", "k"), ("g", "g"), ("e_plain", "p"), ("e_typed", "t")))
    past = "first_value(CASE WHEN k NOT IN ({}) THEN {{'k': k, 'lex': lex, 'gs': gs, 'bears': coalesce(k IN ('p', 'c', 's') AND (k1 = 'n' OR k1 = 'w' AND NOT g1), false)}} END IGNORE NULLS) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    four, unsigned = "(bare AND length(lex) = 4 AND sign = '')", "sign = ''"
    real = f"(try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', r2::BIGINT, list_position({_MONTHS}, l1), n) AS DATE) IS NOT NULL)"
    dollar = "(NOT g AND l1 = '$' AND sign = '')"
    before_dollar = "(coalesce(NOT l1g, false) AND coalesce(l2 IN ('-', '+', '−'), false))"
    money = lambda c: f"coalesce(regexp_full_match({c}, '[$€£¥₽]'), false)"
    forms = [
        ("kept", f"{four} AND lower(l1) = 'from' AND lower(r1) = 'to' AND regexp_full_match(r2, '[0-9]{{4}}')", "pos - 1", "pos + 2", "r2p"),
        ("date", f"bare AND length(lex) <= 2 AND {unsigned} AND g AND list_contains({_MONTHS}, l1) AND r1 = ',' AND NOT r1g AND r2g AND regexp_full_match(r2, '[0-9]{{4}}')", f"CASE WHEN {real} THEN pos ELSE pos - 1 END", "pos + 2", "r2p"),
        ("dollars", f"{dollar} AND NOT {before_dollar} AND valued AND NOT coalesce(r1 = '%', false)", "pos - 1", "pos", "e_money"),
        ("kept", f"{money('l1')} OR sign <> '' AND {money('l2')}", f"CASE WHEN {dollar} AND {before_dollar} OR sign <> '' AND {money('l2')} THEN pos - 2 ELSE pos - 1 END", "CASE WHEN r1 = '%' THEN pos + 1 ELSE pos END", "e_typed"),
        ("ordinal", "bare AND sign IN ('', '-') AND NOT r1g AND r1 IN ('st', 'nd', 'rd', 'th')", "front", "pos + 1", "r1p"),
        ("percent", "r1 = '%' AND valued", "front", "pos + 1", "r1p"),
        ("kept", "r1 = '%'", "front", "pos + 1", "r1p"),
        ("clock", "regexp_full_match(lex, '[0-9]{1,2}:[0-9]{2}')", "front", "pos", "e_plain"),
        ("measure", f"{_UNITS} IS NOT NULL AND valued", "front", "pos + 1", "r1t"),
        ("number", "fraction <> '' AND valued", "front", "pos", "e_plain"),
        ("year", f"{four} AND g AND lower(l1) IN ('in', 'from') AND n BETWEEN 1000 AND 2099", "pos", "pos", "e_plain"),
        ("kept", _STEMS, "front", "pos + 1", "r1t"),
        ("kept", money("r1"), "front", "pos + 1", "r1p"),
        ("number", "valued", "front", "pos", "e_plain"),
        ("kept", "true", "front", "pos", "e_plain"),
    ]
    rank = "CASE " + " ".join(f"WHEN coalesce({c}, false) THEN {i}" for i, (_, c, *_) in enumerate(forms)) + " END"
    of = lambda k: "CASE form " + " ".join(f"WHEN {i} THEN {f[k]}" for i, f in enumerate(forms)) + " END"
    name = "CASE form " + " ".join(f"WHEN {i} THEN '{f[0]}'" for i, f in enumerate(forms)) + " END"
    known = "valued AND n BETWEEN 0 AND 999999999 AND sign IN ('', '-')"
    said = f"""CASE WHEN stop > finish THEN NULL
  WHEN name = 'date' AND {real} THEN {_DAY} || ', ' || {S.en('r2::BIGINT')}
  WHEN name = 'dollars' AND {known} AND length(fraction) <= 2 THEN {S.en_counted('n', 'dollar')} || CASE WHEN fraction <> '' THEN ' ' || {S.en_counted(_CENTS, 'cent')} ELSE '' END
  WHEN name = 'ordinal' AND {known} AND r1 = CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' ELSE ['th','st','nd','rd','th','th','th','th','th','th'][n % 10 + 1] END THEN {_MINUS} || {_ORDINAL}
  WHEN name = 'clock' AND sign = '' AND split_part(lex, ':', 1)::INT <= 23 AND split_part(lex, ':', 2)::INT <= 59 THEN {S.en_counted("split_part(lex, ':', 1)::BIGINT", 'hour')} || ' ' || {S.en_counted("split_part(lex, ':', 2)::BIGINT", 'minute')}
  WHEN name = 'year' THEN {S.en_year('n')}
  WHEN name IN ('percent', 'measure', 'number') AND {known} THEN {_MINUS} || {_ALOUD} || CASE name WHEN 'percent' THEN ' percent' WHEN 'measure' THEN ' ' || {_UNITS} || CASE WHEN n = 1 AND fraction = '' THEN '' ELSE 's' END ELSE '' END END"""
    value = V.EN_VALUE.strip("^$")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, {key}, {_clean(text)} || chr(10) AS c FROM {table}),
 x AS (SELECT r, unnest(raws) AS raw, unnest(range(len(raws))) AS pos FROM (SELECT r, regexp_extract_all(c, '{_re2(L.LEXER)}') AS raws FROM d WHERE regexp_matches(c, '[0-9]'))),
 y AS (SELECT *, raw[1] = ' ' AS g, CASE WHEN raw[1] = ' ' THEN raw[2:] ELSE raw END AS lex FROM x),
 z AS (SELECT *, {_KIND} AS k FROM y),
 a AS (SELECT *, sum(g::INT) OVER o AS gs, lag(lex) OVER o AS x0, lead(k) OVER o AS k1, lead(lex) OVER o AS x1, lead(g) OVER o AS g1, lead(k, 2) OVER o AS k2, lead(g, 2) OVER o AS g2 FROM z WINDOW o AS (PARTITION BY r ORDER BY pos)),
 b AS (SELECT *, {past.format("'p', 'c', 's'")} AS past, {past.format("'p'")} AS beyond FROM a),
 e AS (SELECT r, pos, raw, lex, g, k, {ends} FROM b),
 l AS (SELECT *, lag(lex) OVER o AS l1, lag(k) OVER o AS l1k, lag(g) OVER o AS l1g, lag(lex, 2) OVER o AS l2, lag(k, 2) OVER o AS l2k, {ahead} FROM e WINDOW o AS (PARTITION BY r ORDER BY pos)),
 v AS (SELECT *, CASE WHEN NOT g AND l1 IN ('-', '+', '−') AND (coalesce(l1g, true) OR NOT {_among('l2k', 'wtnh')}) THEN l1 ELSE '' END AS sign, coalesce(regexp_full_match(lex, '{value}'), false) AS valued,
   regexp_replace(regexp_extract(lex, '^(?:{value})$', 1), '[, ]', '', 'g') AS whole, regexp_extract(lex, '^(?:{value})$', 2) AS fraction, regexp_full_match(lex, '[0-9]+') AS bare
   FROM l WHERE k = 'n' AND NOT (NOT g AND {_among('l1k', 'wtnh')}) AND NOT (NOT g AND {_among('l1k', 'pcs')} AND NOT l1g AND coalesce(l2k = 'n', false))),
 f AS (SELECT *, {rank} AS form FROM (SELECT *, coalesce(try_cast(whole AS BIGINT), -1) AS n, CASE WHEN sign = '' THEN pos ELSE pos - 1 END AS front FROM v)),
 s AS (SELECT *, {of(2)} AS start, {of(3)} AS finish, coalesce({of(4)}, {of(3)}) AS stop, {name} AS name FROM f),
 c AS (SELECT *, greatest(finish, stop) AS fin, max(greatest(finish, stop)) OVER (PARTITION BY r ORDER BY start, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
 q AS (SELECT r, start, fin, {said} AS said FROM c WHERE reach IS NULL OR reach < start),
 p AS (SELECT x.r, x.pos, x.raw, q.start, q.said, max(CASE WHEN q.said IS NOT NULL THEN q.fin END) OVER (PARTITION BY x.r ORDER BY x.pos ROWS UNBOUNDED PRECEDING) AS cover FROM x LEFT JOIN q ON q.r = x.r AND q.start = x.pos),
 spoken AS (SELECT r, string_agg(CASE WHEN said IS NOT NULL THEN CASE WHEN raw[1] = ' ' THEN ' ' ELSE '' END || said WHEN coalesce(cover >= pos, false) THEN '' ELSE raw END, '' ORDER BY pos) AS said FROM p GROUP BY r)
"""


_LAST = _clean("coalesce(spoken.said, d.c)")


@query("documents", english_sql("documents", "doc_id") + f"SELECT doc_id, {_LAST} AS normalized_text FROM d LEFT JOIN spoken USING (r)")
def verbalized_documents(df):
    """Documents with their numbers read aloud, without a Python worker."""
    return V.verbalise(df, ["doc_id"])


# Contexts: sentences made of the orders' numbers, each form in its surroundings. The text is one expression that both
# engines read; what is wanted is worked out from the numbers, not from the text.

_K, _BIG = "o_orderkey", "(o_orderkey * 7919 % 900000 + 100000)"
_GROUP = f"cast({_BIG} // 1000 as string) || '{{}}' || lpad(cast({_BIG} % 1000 as string), 3, '0')"


def _cases(rows: list[tuple[str, str]], which: int) -> str:
    return f"CASE {_K} % {len(rows)} " + " ".join(f"WHEN {i} THEN {r[which]}" for i, r in enumerate(rows)) + " END"


def _spark(sql: str) -> str:
    return sql.replace(" // ", " div ")


_N, _Y, _Q = "(o_orderkey % 97)", "(1000 + o_orderkey % 1100)", "(1000 + o_orderkey % 9000)"
_EN_ORDINAL = f"CASE WHEN {_N} % 100 = 0 THEN 'zeroth' ELSE {S.en_ordinal_below_100(_N)} END"
_EN_CONTEXTS = [
    (f"'Seen in ' || cast({_Y} as string) || ' again'", f"'Seen in ' || {S.en_year(_Y)} || ' again'"),
    (f"'From ' || cast({_Y} as string) || ' to ' || cast({_Y} + 1 as string) || ' it stays'", f"'From ' || {_Y} || ' to ' || {_Y} + 1 || ' it stays'"),
    (f"'May ' || cast({_N} as string) || ', ' || cast({_Y} as string) || ' was'", f"'May ' || CASE WHEN {_N} BETWEEN 1 AND 31 THEN {S.en_ordinal_below_100(_N)} || ', ' || {S.en(_Y)} ELSE {_N} || ', ' || {_Y} END || ' was'"),
    (f"'Sum ' || {_GROUP.format(',')} || ' in all'", f"'Sum ' || {S.en(_BIG)} || ' in all'"),
    (f"'Sum ' || {_GROUP.format(' ')} || '.'", f"'Sum ' || {S.en(_BIG)} || '.'"),
    (f"'Paid $' || {_GROUP.format(',')} || '.05, then'", f"'Paid ' || {S.en_counted(_BIG, 'dollar')} || ' five cents, then'"),
    (f"'Weighs ' || cast({_N} as string) || ' kg /' || cast({_Y} as string) || ' now'", f"'Weighs ' || {_N} || ' kg /' || {_Y} || ' now'"),
    (f"'Weighs ' || cast({_N} as string) || ' kg ' || cast({_Y} as string) || ' now'", f"'Weighs ' || {S.en_counted(_N, 'kilogram')} || ' ' || {S.en(_Y)} || ' now'"),
    (f"'The ' || cast({_N} as string) || 'th of ' || cast({_N} as string) || '%.'", f"'The ' || CASE WHEN {_N} % 10 NOT IN (1, 2, 3) OR {_N} % 100 BETWEEN 11 AND 13 THEN {_EN_ORDINAL} ELSE {_N} || 'th' END || ' of ' || {S.en(_N)} || ' percent.'"),
    (f"'At ' || cast({_N} % 30 as string) || ':' || lpad(cast({_N} as string), 2, '0') || ' or -' || cast({_N} as string) || '.50 x'", f"'At ' || CASE WHEN {_N} % 30 < 24 AND {_N} < 60 THEN {S.en_counted(f'({_N} % 30)', 'hour')} || ' ' || {S.en_counted(_N, 'minute')} ELSE {_N} % 30 || ':' || lpad({_N}::VARCHAR, 2, '0') END || ' or minus ' || {S.en(_N)} || ' point five zero x'"),
]
_RU_GENITIVE = f"concat_ws(' ', CASE WHEN {_N} >= 20 THEN {S.words(russian.GENITIVE_TENS)}[{_N} // 10 + 1] END, CASE WHEN {_N} >= 20 AND {_N} % 10 > 0 THEN {S.words(russian.GENITIVE_UNITS)}[{_N} % 10 + 1] WHEN {_N} < 20 THEN {S.words(russian.GENITIVE_UNITS)}[{_N} + 1] END)"
_RU_ONE = f"({_N} % 10 = 1 AND {_N} <> 11)"
_RU_FEMININE = f"regexp_replace({_RU_GENITIVE}, 'одного$', 'одной')"
_RU_CONTEXTS = [
    (f"'Был в ' || cast({_Q} as string) || ' году там'", f"'Был в ' || {S.ru_year(_Q, 'locative')} || ' году там'"),
    (f"'План за ' || cast({_Q} as string) || ' год там'", f"'План за ' || {S.ru_year(_Q, 'nominative')} || ' год там'"),
    (f"cast({_Q} as string) || ' г. был'", f"{S.ru_year(_Q, 'locative')} || ' году был'"),
    (f"'Ушёл после ' || cast({_N} as string) || ' дней'", f"'Ушёл после ' || CASE WHEN {_RU_ONE} THEN {S.ru(_N)} ELSE {_RU_GENITIVE} END || ' дней'"),
    (f"'Рост до ' || cast({_N} as string) || ',' || cast({_N} % 10 as string) || ' раз'", f"'Рост до ' || {_RU_FEMININE} || CASE WHEN {_RU_ONE} THEN ' целой ' ELSE ' целых ' END || regexp_replace({S.words(russian.GENITIVE_UNITS)}[{_N} % 10 + 1], 'одного$', 'одной') || CASE WHEN {_N} % 10 = 1 THEN ' десятой' ELSE ' десятых' END || ' раз'"),
    (f"'Цена ' || cast({_N} as string) || ',05 руб., да'", f"'Цена ' || {S.ru_counted(_N, russian.ROUBLE)} || ' пять копеек, да'"),
    (f"'Ушёл после ' || cast({_N} as string) || ' / ' || cast({_Q} as string) || ' дней'", f"'Ушёл после ' || {_N} || ' / ' || {_Q} || ' дней'"),
    (f"'Вес ' || cast({_N} as string) || ' кг #' || cast({_Q} as string) || ' там'", f"'Вес ' || {_N} || ' кг #' || {_Q} || ' там'"),
    (f"'Вес ' || cast({_N} as string) || ' кг ' || cast({_Q} as string) || ' там'", f"'Вес ' || {S.ru_counted(_N, ('килограмм', 'килограмма', 'килограммов'))} || ' ' || {S.ru(_Q)} || ' там'"),
    (f"'Тут ' || cast({_N} as string) || ' ошибка и ' || cast({_N} as string) || '% т.д.'", f"'Тут ' || {S.ru_counted(_N, ('ошибка', 'ошибки', 'ошибок'), True)} || ' и ' || {S.ru_counted(_N, russian.PERCENT)} || ' так далее'"),
]


@query("orders", f"SELECT o_orderkey, {_cases(_EN_CONTEXTS, 0)} AS written, {_cases(_EN_CONTEXTS, 1)} AS normalized_text FROM orders")
def verbalized_contexts_en(df):
    """English years, spans of years, dates, groups, money, tails, ordinals, shares, clocks and decimals in sentences."""
    return V.verbalise(_dealt(df, "o_orderkey").select("o_orderkey", F.expr(_spark(_cases(_EN_CONTEXTS, 0))).alias("written")), ["o_orderkey", "written"], "written", "english")


@query("orders", f"SELECT o_orderkey, {_cases(_RU_CONTEXTS, 0)} AS written, {_cases(_RU_CONTEXTS, 1)} AS normalized_text FROM orders")
def verbalized_contexts_ru(df):
    """Russian years in three cases, genitives, money, tails, counted nouns, shares and abbreviations in sentences."""
    return V.verbalise(_dealt(df, "o_orderkey").select("o_orderkey", F.expr(_spark(_cases(_RU_CONTEXTS, 0))).alias("written")), ["o_orderkey", "written"], "written", "russian")


# Diagnostics

_WHITE = "[ \\t\\n\\r\\x0B\\f\\x{00A0}\\x{202F}]"
_PLACES = f"""
, m AS (SELECT r, sum(n) FILTER (pos < start) AS skip, sum(n) FILTER (pos <= fin) AS upto, start FROM (SELECT y.r, y.pos, length(replace(lex, ' ', '')) AS n, q.start, q.fin FROM y JOIN q ON q.r = y.r WHERE q.said IS NULL) GROUP BY r, start, fin),
 h AS (SELECT r, strlen(ch) AS w, i, NOT regexp_matches(ch, '{_WHITE}') AS solid FROM (SELECT row_number() OVER () AS r, text, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM {{table}}) WHERE r IN (SELECT r FROM m)),
 j AS (SELECT r, w, sum(w) OVER o AS past, sum(solid::INT) OVER o AS k, solid FROM h WINDOW o AS (PARTITION BY r ORDER BY i)),
 places AS (SELECT m.r, (a.past - a.w)::BIGINT AS "offset", (z.past - a.past + a.w)::BIGINT AS "length" FROM m JOIN j a ON a.r = m.r AND a.solid AND a.k = coalesce(skip, 0) + 1 JOIN j z ON z.r = m.r AND z.solid AND z.k = upto)
"""


@query("documents", english_sql("documents", "doc_id") + _PLACES.replace("{table}", "documents") + """SELECT doc_id, 'unresolved_number' AS code, "offset", "length" FROM places JOIN d USING (r)
 UNION ALL SELECT doc_id, 'ambiguous_normalization', 0, strlen(text) FROM documents WHERE regexp_matches(text, '[\\x{0400}-\\x{052F}]') AND regexp_matches(text, '[A-Za-z\\x{00C0}-\\x{024F}]')""")
def diagnostics_documents(df):
    """Numbers of documents that stay, as bytes of the text as given."""
    from vocalis.operators.diagnostics import diagnostics

    return diagnostics(df, ["doc_id"]).select("doc_id", "code", "offset", "length")


_MIXED = [
    (f"'Use ' || cast({_N} as string) || ' кг и ' || cast({_Q} as string) || ' boxes now'", f"'Use ' || {S.ru_counted(_N, ('килограмм', 'килограмма', 'килограммов'))} || ' и ' || {S.en(_Q)} || ' boxes now'"),
    (f"'Цена $' || cast({_N} as string) || ' за ' || cast({_N} as string) || ' km там'", f"'Цена ' || {S.en_counted(_N, 'dollar')} || ' за ' || {S.en_counted(_N, 'kilometer')} || ' там'"),
    (f"'Привет ' || cast({_N} as string) || ' kg /' || cast({_Q} as string)", f"'Привет ' || {_N} || ' kg /' || {_Q}"),
    (f"'Отчёт report ' || cast({_N} as string) || '% и ' || cast({_N} as string) || '. Да'", f"'Отчёт report ' || {S.ru_counted(_N, russian.PERCENT)} || ' и ' || {S.ru(_N)} || '. Да'"),
]


@query("orders", f"SELECT o_orderkey, {_cases(_MIXED, 0)} AS written, {_cases(_MIXED, 1)} AS normalized_text FROM orders")
def verbalized_contexts_mixed(df):
    """Sentences in both scripts, each number in the language of the word after it."""
    return V.verbalise(_dealt(df, "o_orderkey").select("o_orderkey", F.expr(_spark(_cases(_MIXED, 0))).alias("written")), ["o_orderkey", "written"], "written", "segment")
