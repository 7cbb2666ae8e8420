"""Number words as Column functions: array literals, arithmetic and concat, all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocalis.kernel import english, russian

_BILLION = 10**9


def _pick(words: list[str], index: Column) -> Column:
    """The word at an index from 0. The table is one string literal, split once when the plan is folded."""
    return F.element_at(F.split(F.lit("|".join(words)), "\\|"), (index + 1).cast("int"))


def _grouped(n: Column, below, groups, zero: Column) -> Column:
    """Words of a whole number from its groups of three digits."""
    a = F.abs(n.cast("bigint"))
    parts = [F.when(F.floor(a / size) % 1000 > 0, say(F.floor(a / size) % 1000)) for size, say in groups]
    rest = F.when(a % 1000 > 0, below(a % 1000))
    body = F.when(a == 0, zero).otherwise(F.concat_ws(" ", *parts, rest))
    return F.when(a >= _BILLION, n.cast("bigint").cast("string")).otherwise(F.concat(F.when(n < 0, "minus ").otherwise(""), body))


# English


def _en_below(n: Column) -> Column:
    return _pick([" ".join(english.below_thousand(i)) for i in range(1000)], n)


def en_cardinal(n: Column) -> Column:
    """Whole numbers; from a thousand million on the digits stay."""
    return _grouped(n, _en_below, [(10**6, lambda g: F.concat(_en_below(g), F.lit(" million"))), (1000, lambda g: F.concat(_en_below(g), F.lit(" thousand")))], F.lit("zero"))


def en_ordinal(n: Column) -> Column:
    """Ordinals from the last group's table; whole thousands and millions take th."""
    a = F.abs(n.cast("bigint"))
    last = _pick([english.ordinal(i) for i in range(1000)], a % 1000)
    return F.when(a % 1000 == 0, F.when(a == 0, "zeroth").otherwise(F.concat(en_cardinal(n), F.lit("th")))).otherwise(F.concat(F.when(a >= 1000, F.concat(en_cardinal(n - n % 1000), F.lit(" "))).when(n < 0, "minus ").otherwise(""), last))


def en_suffix(n: Column) -> Column:
    a = F.abs(n)
    return F.when((a % 100).between(11, 13), "th").when(a % 10 == 1, "st").when(a % 10 == 2, "nd").when(a % 10 == 3, "rd").otherwise("th")


def en_year(y: Column) -> Column:
    halves = F.concat(_en_below(F.floor(y / 100)), F.lit(" "), F.when(y % 100 == 0, "hundred").otherwise(_en_below(y % 100)))
    return F.when(y.between(1000, 1999), halves).otherwise(en_cardinal(y))


def en_digits(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c: _pick(english.UNITS[:10], c.cast("int"))), " ")


def _signed(token: Column, cardinal, zero: str) -> Column:
    return F.when(token.rlike("^-0+$"), zero).otherwise(cardinal(token.cast("bigint")))


def en_decimal(token: Column) -> Column:
    """A token with a point: the fraction digit by digit, so its zeros are spoken."""
    whole, fraction = F.substring_index(token, ".", 1), F.substring_index(token, ".", -1)
    return F.concat_ws(" point ", _signed(whole, en_cardinal, "minus zero"), F.when(F.contains(token, F.lit(".")), en_digits(fraction)))


def en_counted(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(en_cardinal(n), F.when(F.abs(n) == 1, " " + one).otherwise(" " + (many or one + "s")))


def en_dollars(token: Column) -> Column:
    """12.5 as twelve dollars fifty cents; no cents where no fraction is written."""
    whole, cents = F.substring_index(token, ".", 1).cast("bigint"), F.rpad(F.substring_index(token, ".", -1), 2, "0").cast("int")
    return F.concat_ws(" ", en_counted(whole, "dollar"), F.when(F.contains(token, F.lit(".")), en_counted(cents, "cent")))


def en_percent(token: Column) -> Column:
    return F.concat(en_decimal(token), F.lit(" percent"))


def en_clock(h: Column, m: Column) -> Column:
    """Null outside 0:00 to 23:59."""
    return F.when(h.between(0, 23) & m.between(0, 59), F.concat_ws(" ", en_counted(h, "hour"), en_counted(m, "minute")))


def en_measure(token: Column, unit: Column) -> Column:
    """Null for an unknown unit. Singular only for plus or minus one without a fraction."""
    names = F.create_map(*[F.lit(x) for spoken, written in english.MEASURES.items() for w in written.split() for x in (w, spoken)])
    one = token.rlike("^-?0*1$")
    return F.concat(en_decimal(token), F.lit(" "), F.try_element_at(names, unit), F.when(one, "").otherwise("s"))


def en_date(d: Column) -> Column:
    return F.concat(_pick(english.MONTHS, F.month(d) - 1), F.lit(" "), en_ordinal(F.dayofmonth(d)), F.lit(", "), en_cardinal(F.year(d)))


# Russian


def ru_form(n: Column) -> Column:
    """0, 1 or 2: the form for one, few or many."""
    a = F.abs(n)
    return F.when((a % 100).between(11, 19), 2).when(a % 10 == 1, 0).when((a % 10).between(2, 4), 1).otherwise(2)


def ru_plural(n: Column, forms: tuple[str, str, str]) -> Column:
    return _pick(list(forms), ru_form(n))


def _ru_below(n: Column, feminine: bool = False) -> Column:
    return _pick([" ".join(russian.below_thousand(i, feminine)) for i in range(1000)], n)


def ru_cardinal(n: Column, feminine: bool = False) -> Column:
    groups = [
        (10**6, lambda g: F.concat(_ru_below(g), F.lit(" "), ru_plural(g, russian.MILLION))),
        (1000, lambda g: F.concat(_ru_below(g, True), F.lit(" "), ru_plural(g, russian.THOUSAND))),
    ]
    words = _grouped(F.abs(n.cast("bigint")), lambda r: _ru_below(r, feminine), groups, F.lit("ноль"))
    return F.concat(F.when(n < 0, "минус ").otherwise(""), words)


def ru_counted(n: Column, forms: tuple[str, str, str], feminine: bool = False) -> Column:
    return F.concat(ru_cardinal(n, feminine), F.lit(" "), ru_plural(n, forms))


def ru_genitive(n: Column) -> Column:
    """Genitive below a thousand, else the plain number."""
    return F.when(F.abs(n) < 1000, F.concat(F.when(n < 0, "минус ").otherwise(""), _pick([russian.genitive(i) for i in range(1000)], F.abs(n)))).otherwise(ru_cardinal(n))


def ru_year_ordinal(y: Column, case: str) -> Column:
    """1000 to 9999 as an ordinal in nominative, genitive or locative; null for others."""
    whole = _pick([russian.year(1000 * t, case) if t else "" for t in range(10)], F.floor(y / 1000))
    head = _pick(["", "тысяча", *[russian.cardinal(1000 * t) for t in range(2, 10)]], F.floor(y / 1000))
    tail = _pick(["", *[russian.year(1000 + r, case).removeprefix("тысяча ") for r in range(1, 1000)]], y % 1000)
    return F.when(y.between(1000, 9999), F.when(y % 1000 == 0, whole).otherwise(F.concat(head, F.lit(" "), tail)))


def ru_year(y: Column, case: str) -> Column:
    """1000 to 9999 as an ordinal in nominative, genitive or locative; others as numbers."""
    return F.coalesce(ru_year_ordinal(y, case), ru_cardinal(y))


def ru_decimal(token: Column) -> Column:
    """A token with a comma and up to three digits after it; null with more."""
    whole, fraction = F.substring_index(token, ",", 1), F.substring_index(token, ",", -1)
    top, part, k = whole.cast("bigint"), fraction.cast("bigint"), F.length(fraction)
    names = [F.when(k == i, F.when(ru_form(part) == 0, one).otherwise(many)) for i, (one, many) in russian.FRACTIONS.items()]
    return F.concat(_signed(whole, lambda n: ru_cardinal(n, True), "минус ноль"), F.when(ru_form(top) == 0, " целая ").otherwise(" целых "), ru_cardinal(part, True), F.lit(" "), F.coalesce(*names))


def ru_roubles(token: Column) -> Column:
    """2,5 as two roubles fifty kopecks; zero kopecks are silent."""
    whole = F.substring_index(token, ",", 1).cast("bigint")
    cents = F.when(F.contains(token, F.lit(",")), F.rpad(F.substring_index(token, ",", -1), 2, "0").cast("int")).otherwise(0)
    return F.concat_ws(" ", ru_counted(whole, russian.ROUBLE), F.when(cents > 0, ru_counted(cents, russian.KOPECK, True)))


def ru_percent(token: Column) -> Column:
    fraction = F.contains(token, F.lit(","))
    n = F.substring_index(token, ",", 1).cast("bigint")
    return F.when(fraction, F.concat(ru_decimal(token), F.lit(" процента"))).otherwise(ru_counted(n, russian.PERCENT))


def ru_clock(h: Column, m: Column) -> Column:
    return F.when(h.between(0, 23) & m.between(0, 59), F.concat_ws(" ", ru_counted(h, russian.HOUR), ru_counted(m, russian.MINUTE, True)))


def ru_measure(token: Column, unit: str) -> Column:
    """unit: as written (км, кг, см, мм, м, ГБ, МБ or a long form). A fraction takes the genitive singular."""
    forms = next(f for f, written in russian.MEASURES.items() if unit in written.split())
    n = F.substring_index(token, ",", 1).cast("bigint")
    return F.when(F.contains(token, F.lit(",")), F.concat(ru_decimal(token), F.lit(" " + forms[1]))).otherwise(ru_counted(n, forms))


def ru_date(d: Column, case: str = "neuter") -> Column:
    return F.concat_ws(" ", _pick(["", *[russian.day(i, case) for i in range(1, 32)]], F.dayofmonth(d)), _pick(russian.MONTHS, F.month(d) - 1), ru_year(F.year(d), "genitive"), F.lit("года"))


def ru_noun(n: Column, forms: tuple[str, str, str]) -> Column:
    return ru_counted(n, forms, True)
