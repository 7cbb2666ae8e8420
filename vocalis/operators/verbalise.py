"""Numbers read aloud as a Spark plan: forms as candidate spans over lexeme rows, priority by windows, spoken, put back.

Each number proposes every written form it could be, with a rank, a span and words from functions/words.py. A window takes
the first form in rank, another drops what an earlier span covers. A form whose surface goes on (see lexemes.linked), and
one whose value it does not allow, keeps its whole surface and is a diagnostic. Nothing leaves the JVM.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalis.functions import words as N
from vocalis.functions.text import abbreviations, clean_spacing, detect_language, valid_date
from vocalis.kernel import english, readers, russian
from vocalis.kernel.text import CYRILLIC, LATIN
from vocalis.operators.lexemes import MATRIX, island_id, lexemes, linked, parts

LIMIT = 999_999_999
CURRENCY = "^[$€£¥₽]$"
CLOCK = "^[0-9]{1,2}:[0-9]{2}$"
DOTTED = "^[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}$"
EN_VALUE = "^([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,3}(?: [0-9]{3})+|[0-9]+)(?:\\.([0-9]+))?$"
RU_VALUE = "^([0-9]{1,3}(?: [0-9]{3})+|[0-9]+)(?:,([0-9]+))?$"
EN_UNITS = [w for written in english.MEASURES.values() for w in written.split()]
RU_UNITS = {w: forms for forms, written in russian.MEASURES.items() for w in written.split()}
ROUBLES = ("рублей", "рубля", "рубль", "руб", "руб.")
NOUNS = {w: (forms, free) for forms, free in russian.NOUNS.items() for w in forms}


def _c(name: str) -> Column:
    return F.col(name)


def _is(name: str, *values: str) -> Column:
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def _like(name: str, pattern: str) -> Column:
    return F.coalesce(F.col(name).rlike(pattern), F.lit(False))


def _no(name: str) -> Column:
    """No space before that lexeme, which is there."""
    return F.coalesce(~F.col(name), F.lit(False))


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _tongue(mode: str) -> Column:
    """The language a number is read in: the text's; by segments, that of the word right after it, if that is of one
    script. Dollars are English, dotted dates Russian, and shares the text's."""
    if mode != "segment":
        return _c("language")
    cyrillic, latin = _like("lex_r1", f"[{CYRILLIC}]"), _like("lex_r1", f"[{LATIN}]")
    beside = F.when(_is("kind_r1", "w", "t") & (cyrillic != latin), F.when(cyrillic, "russian").otherwise("english")).otherwise(_c("language"))
    dollar = _no("gap") & _is("lex_l1", "$")
    return F.when(_c("kind") != "n", _c("language")).when(dollar, "english").when(_c("lex").rlike(DOTTED), "russian").when(_is("lex_r1", "%"), _c("language")).otherwise(beside)


def numbers(links: DataFrame, mode: str) -> DataFrame:
    """Lexemes with their neighbours (l1, l2 before; r1, r2, r3 behind), and of numbers the sign, value and whether they
    are candidates: not what is glued to a word, or follows another number's connector."""
    order = W.partitionBy("id").orderBy("pos")
    ends = [f"{name}_end" for name in MATRIX]
    around = {f"{c}_l{n}": F.lag(c, n).over(order) for n in (1, 2) for c in ("kind", "lex", "gap")}
    around |= {f"{c}_r{n}": F.lead(c, n).over(order) for n in (1, 2, 3) for c in ("kind", "lex", "gap", *ends)}
    rows = links.withColumns(around)
    rows = rows.withColumn("tongue", _tongue(mode))
    glued = _no("gap") & _is("kind_l1", "w", "t", "n", "h")
    behind = _no("gap") & _is("kind_l1", "p", "c", "s") & _no("gap_l1") & _is("kind_l2", "n")
    alone = F.coalesce(_c("gap_l1"), F.lit(True)) | ~_is("kind_l2", "w", "t", "n", "h")
    sign = F.when(_no("gap") & _is("lex_l1", "-", "+", "−") & alone, _c("lex_l1")).otherwise("")
    of = lambda f: F.when(_c("tongue") == "russian", f(RU_VALUE)).otherwise(f(EN_VALUE))
    whole = F.regexp_replace(of(lambda p: F.regexp_extract("lex", p, 1)), "[, ]", "")
    rows = rows.withColumns({"candidate": (_c("kind") == "n") & ~glued & ~behind, "sign": sign, "whole": whole, "fraction": of(lambda p: F.regexp_extract("lex", p, 2)), "valued": of(lambda p: _c("lex").rlike(p))})
    n = F.coalesce(_c("whole").try_cast("bigint"), F.lit(-1))
    return rows.withColumns({"n": n, "small": n.between(0, LIMIT), "bare": _c("lex").rlike("^[0-9]+$"), "whole_only": _c("fraction") == "", "before": _c("pos") - F.when(sign == "", 0).otherwise(1)})


def worded(rows: DataFrame, language: str) -> DataFrame:
    """What the words of several forms are made of: the signed number, its token, the parts of a clock."""
    mark = "," if language == "russian" else "."
    token = F.concat(F.when(_c("sign") == "-", "-").otherwise(""), _c("whole"), F.when(_c("fraction") != "", F.concat(F.lit(mark), _c("fraction"))).otherwise(""))
    clock = F.split("lex", ":")
    of = lambda i: F.when(_like("lex", CLOCK) & (_c("sign") == ""), F.try_element_at(clock, F.lit(i)).cast("int"))
    made = rows.withColumns({"signed": F.when(_c("sign") == "-", -_c("n")).otherwise(_c("n")), "known": _c("valued") & _c("small") & _is("sign", "", "-"), "token": token, "hour": of(1), "minute": of(2)})
    if language == "english":
        return made
    # the number's words in both genders, and the digits behind the comma
    minus = F.when(_c("sign") == "-", "минус ").otherwise("")
    made = made.withColumns({"cardinal": F.when(_c("known"), N.ru_cardinal(_c("n"))), "part": F.when((_c("fraction") != "") & (F.length("fraction") <= 3), _c("fraction").cast("int"))})
    feminine = F.regexp_replace(F.regexp_replace("cardinal", "один$", "одна"), "два$", "две")
    return made.withColumns({"cardinal": F.concat(minus, "cardinal"), "feminine": F.concat(minus, feminine)})


def _form(name: str, when: Column, begin: Column, end: Column, closure: str, at: str = "") -> Column:
    """A candidate: end is the pos it would take; where the closure of a kind, seen from the lexeme called at ('' for the
    number, r1 to r3 behind it), ends later, the surface goes on and stays."""
    past = F.coalesce(F.col(f"{closure}_end{at and '_' + at}"), end)
    return F.when(when, F.struct(F.lit(name).alias("name"), begin.alias("first"), F.greatest(end, past).alias("last"), (past > end).alias("goes_on")))


@lru_cache(maxsize=1)
def english_forms() -> Column:
    """The first written form that fits an English number; kept ones are never spoken."""
    here, before, unsigned = _c("pos"), _c("before"), _c("sign") == ""
    four = _c("bare") & (F.length("lex") == 4) & unsigned
    month = F.array_position(F.array(*map(F.lit, english.MONTHS)), _c("lex_l1"))
    real = valid_date(_c("n"), month, _c("lex_r2").try_cast("bigint"))
    stem = _like("lex_r1", f"^(?:{'|'.join(readers.ENGLISH_STEMS)})") & _is("kind_r1", "w", "t") & ~_is("lex_r1", *readers.ENGLISH_SURFACES)
    dollar = _no("gap") & _is("lex_l1", "$") & unsigned
    before_dollar = _no("gap_l1") & _is("lex_l2", "-", "+", "−")
    prefixed = _like("lex_l1", CURRENCY) | (~unsigned & _like("lex_l2", CURRENCY))
    prefix_at = F.when(dollar & before_dollar | ~unsigned & _like("lex_l2", CURRENCY), here - 2).otherwise(here - 1)
    share = _is("lex_r1", "%")
    return F.coalesce(
        _form("kept", four & _like("lex_l1", "(?i)^from$") & _like("lex_r1", "(?i)^to$") & _like("lex_r2", "^[0-9]{4}$"), here - 1, here + 2, "plain", "r2"),
        _form("date", _c("bare") & (F.length("lex") <= 2) & unsigned & _yes("gap") & (month > 0) & _is("lex_r1", ",") & _no("gap_r1") & _yes("gap_r2") & _like("lex_r2", "^[0-9]{4}$"), F.when(real, here).otherwise(here - 1), here + 2, "plain", "r2"),
        _form("dollars", dollar & ~before_dollar & _c("valued") & ~share, here - 1, here, "money"),
        _form("kept", prefixed, prefix_at, F.when(share, here + 1).otherwise(here), "typed"),
        _form("ordinal", _c("bare") & _is("sign", "", "-") & _no("gap_r1") & _is("lex_r1", "st", "nd", "rd", "th"), before, here + 1, "plain", "r1"),
        _form("percent", share & _c("valued"), before, here + 1, "plain", "r1"),
        _form("kept", share, before, here + 1, "plain", "r1"),
        _form("clock", _like("lex", CLOCK), before, here, "plain"),
        _form("measure", _is("lex_r1", *EN_UNITS) & _c("valued"), before, here + 1, "typed", "r1"),
        _form("number", ~_c("whole_only") & _c("valued"), before, here, "plain"),
        _form("year", four & _yes("gap") & _like("lex_l1", "(?i)^(in|from)$") & _c("n").between(1000, 2099), here, here, "plain"),
        _form("kept", stem, before, here + 1, "typed", "r1"),
        _form("kept", _like("lex_r1", CURRENCY), before, here + 1, "plain", "r1"),
        _form("number", _c("valued"), before, here, "plain"),
        _form("kept", F.lit(True), before, here, "plain"),
    )


@lru_cache(maxsize=1)
def english_words() -> dict[str, Column]:
    """What is said of each form; null where its value is not allowed."""
    aloud = F.when(_c("known"), N.en_decimal(_c("token")))
    names = F.create_map(*[F.lit(x) for spoken, written in english.MEASURES.items() for w in written.split() for x in (w, spoken)])
    plural = F.when((_c("n") == 1) & _c("whole_only"), "").otherwise("s")
    day, year = _c("n"), _c("lex_r2").try_cast("bigint")
    real = valid_date(day, F.array_position(F.array(*map(F.lit, english.MONTHS)), _c("lex_l1")), year)
    behind = F.concat(F.lit(" "), F.try_element_at(names, _c("lex_r1")), plural)
    return {
        "date": F.when(real, F.concat(N._pick([english.ordinal(i) for i in range(32)], day), F.lit(", "), N.en_cardinal(year))),
        "dollars": F.when(_c("known") & (F.length("fraction") <= 2), N.en_dollars(_c("token"))),
        "ordinal": F.when(_c("known") & (N.en_suffix(_c("signed")) == _c("lex_r1")), N.en_ordinal(_c("signed"))),
        "clock": N.en_clock(_c("hour"), _c("minute")),
        "year": N.en_year(_c("n")),
        "percent measure number": F.concat(aloud, F.when(_c("name") == "percent", " percent").when(_c("name") == "measure", behind).otherwise("")),
    }


def _by(column: str, table: dict, say) -> Column:
    """say(value) of the first table entry whose keys hold the column."""
    groups: dict = {}
    for key, value in table.items():
        groups.setdefault(value, []).append(key)
    return reduce(lambda rest, g: F.when(F.col(column).isin(*g[1]), say(g[0])).otherwise(rest), reversed(groups.items()), F.lit(None).cast("string"))


def _after(words: str) -> Column:
    """One of these words stands before the number, or before its sign."""
    unsigned = _c("sign") == ""
    return _yes("gap") & unsigned & _like("lex_l1", f"^(?:{words})$") | (~unsigned & _yes("gap_l1") & _like("lex_l2", f"^(?:{words})$"))


@lru_cache(maxsize=1)
def russian_forms() -> Column:
    """The first written form that fits a Russian number; kept ones are never spoken."""
    here, before, unsigned = _c("pos"), _c("before"), _c("sign") == ""
    thirds = F.length("fraction") <= 3
    four = _c("bare") & (F.length("lex") == 4) & unsigned
    late = four & (_c("n") >= 1000)
    prefixed = (_like("lex_l1", CURRENCY) & (_yes("gap") | ~_is("lex_l1", "$"))) | (~unsigned & _like("lex_l2", CURRENCY))
    prefix_at = F.when(~unsigned & _like("lex_l2", CURRENCY), here - 2).otherwise(here - 1)
    marked = _is("kind_r1", "w") & _no("gap_r1") & _like("lex_r1", f"^[{readers._MARK}]")
    share, minus, valued = _is("lex_r1", "%"), _is("sign", "", "-"), _c("valued")
    noun = _by("lex_r1", NOUNS, lambda v: F.when(F.lit(v[1]) | (N.ru_plural(_c("n"), v[0]) == _c("lex_r1")), F.lit("fits"))).isNotNull()
    return F.coalesce(
        _form("kept", four & _like("lex_l1", "^[Сс]$") & _is("lex_r1", "по") & _like("lex_r2", "^[0-9]{4}$") & _like("lex_r3", "^год"), here - 1, here + 3, "plain", "r3"),
        _form("kept", four & _like("lex", "^0") & ~share, here, here, "plain"),
        _form("kept", marked & _is("kind_r2", "w") & _yes("gap_r2"), before, here + 2, "counted", "r2"),
        _form("kept", marked, before, here + 1, "counted", "r1"),
        _form("date", _like("lex", DOTTED), before, here, "plain"),
        _form("kept", prefixed, prefix_at, here, "typed"),
        _form("locative", late & _is("lex_r1", "г."), here, here + 1, "plain", "r1"),
        _form("locative", late & _after("[Вв]") & _is("lex_r1", "году"), here, here + 1, "plain", "r1"),
        _form("accusative", late & _after("[Зз]а") & _is("lex_r1", "год"), here, here + 1, "plain", "r1"),
        _form("percent", share & valued & minus & (_c("whole_only") | thirds), before, here + 1, "plain", "r1"),
        _form("kept", share & _like("lex", "^[0-9]+\\.[0-9]+$") & _is("kind_r2", "n") & _yes("gap_r2"), before, here + 2, "typed", "r2"),
        _form("kept", share, before, here + 1, "typed", "r1"),
        _form("roubles", _is("lex_r1", *ROUBLES), before, here + 1, "typed", "r1"),
        _form("clock", _like("lex", CLOCK), before, here, "plain"),
        _form("measure", _is("lex_r1", *RU_UNITS) & valued & (_c("whole_only") | thirds), before, here + 1, "typed", "r1"),
        _form("kept", _is("lex_r1", *EN_UNITS) & valued & (_c("typed_end_r1") > here + 1), before, here + 1, "typed", "r1"),
        _form("until", ~_c("whole_only") & thirds & _after("до"), before, here, "plain"),
        _form("decimal", ~_c("whole_only") & thirds, before, here, "plain"),
        _form("kept", _c("bare") & _after("[Пп]осле|[Ии]з") & (_c("counted_end") > here), before, here, "counted"),
        _form("genitive", _c("bare") & _after("[Пп]осле|[Ии]з") & minus & (_c("n") <= 999) & (N.ru_form(_c("n")) != 0), before, here, "counted"),
        _form("noun", noun & _yes("gap_r1") & _c("whole_only") & valued & minus, before, here + 1, "typed", "r1"),
        _form("kept", _like("lex_r1", CURRENCY) | (_yes("gap_r1") & _like("lex_r1", f"^(?:{'|'.join(NOUNS)}).") & ~_is("lex_r1", *NOUNS)), before, here + 1, "plain", "r1"),
        _form("number", _c("whole_only") & valued & minus, before, here, "plain"),
        _form("kept", ~unsigned & _is("kind_r1", "w") & _yes("gap_r1"), before, here + 1, "plain", "r1"),
        _form("kept", F.lit(True), before, here, "plain"),
    )


def _numbered(column: Column, feminine: bool = False) -> Column:
    """Words of 0 to 999."""
    return N._pick([" ".join(russian.below_thousand(i, feminine)) for i in range(1000)], column)


@lru_cache(maxsize=1)
def russian_words() -> dict[str, Column]:
    """What is said of each form; null where its value is not allowed."""
    n, form, part = _c("n"), N.ru_form(_c("n")), _c("part")
    whole, fraction, one = _c("whole_only"), _c("fraction"), N.ru_form(part) == 0
    nouned = lambda column, table, pick: _by(column, table, lambda v: N._pick(list(pick(v)), form))
    # the point of the abbreviation goes before anything that follows, but for more points, and stays at the end of a text
    pointed = _is("lex_r1", "руб.") & (_is("kind_r2", "e") | _c("kind_r2").isNull() | (_is("lex_r2", ".") & _no("gap_r2")))
    kopecks = F.when(~whole & (F.length("fraction") <= 2), F.rpad("fraction", 2, "0").cast("int")).otherwise(0)
    coins = F.when(kopecks > 0, F.concat(F.lit(" "), _numbered(kopecks, True), F.lit(" "), N.ru_plural(kopecks, russian.KOPECK))).otherwise("")
    unit = F.when(_c("name") == "percent", N._pick(list(russian.PERCENT), form)).when(_c("name") == "roubles", N._pick(list(russian.ROUBLE), form)).otherwise(nouned("lex_r1", RU_UNITS, lambda v: v))
    counted = F.concat("cardinal", F.when(_c("name") == "number", "").otherwise(F.concat(F.lit(" "), unit)), F.when(_c("name") == "roubles", F.concat(coins, F.when(pointed, ".").otherwise(""))).otherwise(""))
    name = lambda pick: F.element_at(F.array(*[F.when(one, pick(x)).otherwise(many) for x, many in russian.FRACTIONS.values()]), F.length(fraction))
    parts = F.when(part.isNotNull(), F.concat("feminine", F.when(form == 0, " целая ").otherwise(" целых "), _numbered(part, True), F.lit(" "), name(lambda x: x)))
    behind = F.when(_c("name") == "percent", " процента").when(_c("name") == "measure", F.concat(F.lit(" "), _by("lex_r1", RU_UNITS, lambda v: F.lit(v[1])))).otherwise("")
    genitive = lambda k, f: N._pick([russian.genitive(i)[: -len("одного")] + "одной" if f and russian.genitive(i).endswith("одного") else russian.genitive(i) for i in range(1000)], k)
    minus = F.when(_c("sign") == "-", "минус ").otherwise("")
    until = F.concat(F.when(n < 1000, F.concat(minus, genitive(n, True))).otherwise(_c("cardinal")), F.when(form == 0, " целой ").otherwise(" целых "), genitive(part, True), F.lit(" "), name(lambda x: x[:-2] + "ой"))
    split = F.when(_like("lex", DOTTED), F.split("lex", "\\."))
    day, month, year = (F.try_element_at(split, F.lit(i)).cast("int") for i in (1, 2, 3))
    days = lambda case: N._pick(["", *[russian.day(i, case) for i in range(1, 32)]], day)
    years = F.coalesce(N.ru_year_ordinal(year, "genitive"), _numbered(year))
    named = F.concat(F.when(_after("[Пп]осле|[Дд]о"), days("genitive")).otherwise(days("neuter")), F.lit(" "), N._pick(russian.MONTHS, month - 1), F.lit(" "), years, F.lit(" года"))
    hour, minute = _c("hour"), _c("minute")
    clock = F.concat(_numbered(hour), F.lit(" "), N.ru_plural(hour, russian.HOUR), F.lit(" "), _numbered(minute, True), F.lit(" "), N.ru_plural(minute, russian.MINUTE))
    return {
        "date": F.when((_c("sign") == "") & valid_date(day, month, year), named),
        "locative": F.concat(N.ru_year_ordinal(n, "locative"), F.lit(" году")),
        "accusative": F.concat(N.ru_year_ordinal(n, "nominative"), F.lit(" год")),
        "clock": F.when(hour.between(0, 23) & minute.between(0, 59), clock),
        "until": until,
        "genitive": F.concat(minus, genitive(n, False)),
        "noun": F.concat("feminine", F.lit(" "), nouned("lex_r1", NOUNS, lambda v: v[0])),
        "decimal percent measure roubles number": F.when(_c("name") == "roubles", F.when(F.length(fraction) <= 2, counted)).when(whole, counted).otherwise(F.concat(parts, behind)),
    }


FORMS = {"english": (english_forms, english_words), "russian": (russian_forms, russian_words)}


def chosen_forms(islands: DataFrame, mode: str) -> DataFrame:
    """(id, language, island), ids distinct -> lexeme rows with first, last (the span of the form chosen there, as pos) and
    said (null: the surface stays); nulls where no span begins with a number. mode: a language, whose islands alone are
    read, or segment: each number in its own.

    Every number proposes its first form in rank; a span that begins inside of an earlier one is dropped.
    """
    some = islands if mode == "segment" else islands.where(F.col("language") == mode)
    rows = numbers(linked(lexemes(some)), mode)
    form = F.when(_c("tongue") == "russian", russian_forms()).otherwise(english_forms()) if mode == "segment" else FORMS[mode][0]()
    proposed = rows.withColumn("_form", F.when(_c("candidate"), form))
    order = W.partitionBy("id").orderBy("_form.first", "pos")
    reach = F.max("_form.last").over(order.rowsBetween(W.unboundedPreceding, -1))
    free = F.coalesce(reach < _c("_form.first"), _c("_form").isNotNull())
    one = proposed.withColumn("_free", free).withColumn("_form", F.when(_c("_free"), _c("_form"))).withColumns({"name": _c("_form.name"), "first": _c("_form.first"), "last": _c("_form.last")})
    out = []
    for language in FORMS if mode == "segment" else (mode,):
        said = F.lit(None).cast("string")
        for names, column in FORMS[language][1]().items():
            said = F.when(_c("name").isin(*names.split()), column).otherwise(said)
        spoken = worded(one.where(_c("tongue") == language), language).withColumn("said", F.when(~_c("_form.goes_on"), said))
        early = F.when(_c("candidate") & _c("bare") & (_c("counted_end") > _c("pos")) & _after("[Пп]осле|[Ии]з"), F.struct(_c("before").alias("first"), _c("counted_end").alias("last"))) if language == "russian" else F.lit(None).cast("struct<first: int, last: int>")
        out.append(spoken.select("id", "pos", "lex", "gap", "begin", "end", "name", "first", "last", "said", early.alias("early")))
    return reduce(DataFrame.unionByName, out)


def spoken_islands(islands: DataFrame, modes: tuple[str, ...] = ("english", "russian")) -> DataFrame:
    """(id, language, island), ids distinct -> id, spoken (the island read aloud), kept (begin, end of the surfaces that
    stay, in code points of the island), early (the same of compound numbers after a word that asks for a case, whatever
    is chosen there)."""
    chosen = reduce(DataFrame.unionByName, [chosen_forms(islands, mode) for mode in modes])
    chosen = chosen.withColumn("raw", F.concat(F.when(_c("gap"), " ").otherwise(""), "lex"))
    listed = chosen.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "raw", "gap", "begin", "end"))).alias("lex"), F.sort_array(F.collect_list(F.struct("first", "last", "said"))).alias("all"), F.sort_array(F.collect_list("early")).alias("early"))
    spans = listed.withColumn("spans", F.filter("all", lambda s: s["first"].isNotNull()))
    text = lambda a, b: F.array_join(F.transform(F.slice("lex", a + 1, F.greatest(b - a, F.lit(0))), lambda x: x["raw"]), "")

    def one(s: Column, i: Column) -> Column:
        since = F.when(i > 0, F.try_element_at("spans", i)["last"] + 1).otherwise(0)
        said = F.concat(F.when(F.element_at("lex", s["first"] + 1)["gap"], " ").otherwise(""), s["said"])
        return F.concat(text(since, s["first"]), F.coalesce(said, text(s["first"], s["last"] + 1)))

    rest = text(F.coalesce(F.try_element_at("spans", F.size("spans"))["last"] + 1, F.lit(0)), F.size("lex"))
    place = lambda s: F.struct(F.element_at("lex", s["first"] + 1)["begin"].alias("begin"), F.element_at("lex", s["last"] + 1)["end"].alias("end"))
    kept = F.transform(F.filter("spans", lambda s: s["said"].isNull()), place)
    read = F.concat(F.array_join(F.transform("spans", one), ""), F.when(F.size("spans") > 0, rest).otherwise(text(F.lit(0), F.size("lex"))))
    return spans.select("id", read.alias("spoken"), kept.alias("kept"), F.transform("early", place).alias("early"))


def _read_aloud(text: Column, language: Column) -> Column:
    """Abbreviations outside of addresses, in Russian."""
    words = F.transform(F.split(text, " "), lambda w: F.when(w.contains("://") | w.contains("@"), w).otherwise(abbreviations(w)))
    return F.when((language == "russian") & text.rlike("т\\.[дп]\\."), F.array_join(words, " ")).otherwise(text)


def read_parts(given: DataFrame, language: str) -> DataFrame:
    """(_keep, _text) -> one row for each island of a text with the gap before it: _keep, _text's _row, _language, _pos, gap,
    island, tail (behind the last one), and what spoken_islands() says of the island. Distinct islands are read once,
    whatever the number of texts that hold them."""
    modes = ("english", "russian") if language == "auto" else (language,)
    each = parts(given, ["_keep"], "_text", language)
    # equal islands are told by themselves: texts are no buffers of a hash aggregate, and first() of them would sort all
    known = each.select(_c("_language").alias("language"), _c("clean").alias("island")).where(_c("island").isNotNull()).distinct()
    one = known.select(island_id(_c("language"), _c("island")).alias("id"), "language", "island").repartition("id")
    read = spoken_islands(one, modes)
    met = each.withColumn("id", F.coalesce(island_id(_c("_language"), _c("clean")), F.encode(F.concat(F.lit("row "), _c("_row")), "UTF-8")))
    return met.join(read, "id", "left").drop("id")


def verbalise(df: DataFrame, keep: list[str], text: str = "text", language: str = "auto") -> DataFrame:
    """The columns kept, and normalized_text.

    language: english, russian, auto (Russian where a text has a Cyrillic letter), or segment (in texts with a Cyrillic
    letter, each number in the language of the word after it, else in the more frequent script's). A null text gives null, an empty one
    is empty; repeated rows stay, and any names of columns may be kept but normalized_text. Texts without a digit are a
    projection; only those with one are put together by row.
    """
    if "normalized_text" in keep:
        raise ValueError("normalized_text is a column already")
    given = df.select(F.struct(*keep).alias("_keep"), F.col(text).alias("_text"))
    numbered = F.coalesce(_c("_text").rlike("[0-9]"), F.lit(False))
    tongue = F.lit(language) if language in FORMS else detect_language(_c("_text"))
    plain = clean_spacing(_c("_text"))
    spelled = F.when((tongue == "russian") & plain.rlike("т\\.[дп]\\."), clean_spacing(_read_aloud(plain, tongue))).otherwise(plain)
    whole = given.where(~numbered).select("_keep.*", spelled.alias("normalized_text"))
    read = read_parts(given.where(numbered), language)
    listed = read.groupBy("_row").agg(F.first("_keep").alias("_keep"), F.first("_language").alias("_language"), F.sort_array(F.collect_list(F.struct("_pos", "gap", F.coalesce("spoken", F.lit("")).alias("spoken"), F.coalesce("tail", F.lit("")).alias("tail")))).alias("_all"))
    joined = F.array_join(F.transform("_all", lambda p: F.concat(p["gap"], p["spoken"], p["tail"])), "")
    return whole.unionByName(listed.select("_keep.*", clean_spacing(_read_aloud(joined, _c("_language"))).alias("normalized_text")))
