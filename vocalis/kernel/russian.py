"""Russian number words with gender and case. Plain functions of integers and digit strings."""

from __future__ import annotations

# fixed values
UNITS = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
TENS = "- - двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
HUNDREDS = "- сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
GENITIVE_UNITS = "ноля одного двух трёх четырёх пяти шести семи восьми девяти десяти одиннадцати двенадцати тринадцати четырнадцати пятнадцати шестнадцати семнадцати восемнадцати девятнадцати".split()
GENITIVE_TENS = "- - двадцати тридцати сорока пятидесяти шестидесяти семидесяти восьмидесяти девяноста".split()
GENITIVE_HUNDREDS = "- ста двухсот трёхсот четырёхсот пятисот шестисот семисот восьмисот девятисот".split()
MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
#: Ordinals without their endings; * marks stems of the soft or stressed kind.
ORDINAL_UNITS = "- перв втор* трет* четвёрт пят шест* седьм* восьм* девят десят одиннадцат двенадцат тринадцат четырнадцат пятнадцат шестнадцат семнадцат восемнадцат девятнадцат".split()
ORDINAL_TENS = "- - двадцат тридцат сороков* пятидесят шестидесят семидесят восьмидесят девяност".split()
ORDINAL_HUNDREDS = "- сот двухсот трехсот четырехсот пятисот шестисот семисот восьмисот девятисот".split()
ORDINAL_THOUSANDS = "- тысячн двухтысячн трехтысячн четырехтысячн пятитысячн шеститысячн семитысячн восьмитысячн девятитысячн".split()
ENDINGS = {"nominative": ("ый", "ой"), "genitive": ("ого", "ого"), "locative": ("ом", "ом"), "neuter": ("ое", "ое")}
THIRD = {"nominative": "третий", "genitive": "третьего", "locative": "третьем", "neuter": "третье"}
FRACTIONS = {1: ("десятая", "десятых"), 2: ("сотая", "сотых"), 3: ("тысячная", "тысячных")}
#: Forms for one, few and many by written unit.
MEASURES = {
    ("километр", "километра", "километров"): "километров километра километр км",
    ("килограмм", "килограмма", "килограммов"): "килограммов килограмма килограмм кг",
    ("сантиметр", "сантиметра", "сантиметров"): "сантиметров сантиметра сантиметр см",
    ("миллиметр", "миллиметра", "миллиметров"): "миллиметров миллиметра миллиметр мм",
    ("метр", "метра", "метров"): "м",
    ("гигабайт", "гигабайта", "гигабайт"): "ГБ GB",
    ("мегабайт", "мегабайта", "мегабайт"): "МБ MB",
}
PERCENT = ("процент", "процента", "процентов")
ROUBLE = ("рубль", "рубля", "рублей")
KOPECK = ("копейка", "копейки", "копеек")
HOUR = ("час", "часа", "часов")
MINUTE = ("минута", "минуты", "минут")
THOUSAND = ("тысяча", "тысячи", "тысяч")
MILLION = ("миллион", "миллиона", "миллионов")
#: Feminine nouns that numbers agree with; True: the noun is put into the number's form.
NOUNS = {("книга", "книги", "книг"): False, ("ошибка", "ошибки", "ошибок"): True}
INITIALISMS = {"ВК": "вэ ка", "ООО": "о о о", "РФ": "эр эф", "МГУ": "эм гэ у", "ФСБ": "эф эс бэ", "МФЦ": "эм эф цэ", "ИП": "и пэ"}
INITIAL_READINGS = {"RTX 4090": "эр ти икс сорок девяносто", "C++": "си плюс плюс", "HTTP/2": "аш ти ти пи два"}


def form(n: int) -> int:
    """0, 1 or 2: the form for one, few or many."""
    n = abs(n)
    if 11 <= n % 100 <= 19:
        return 2
    return 0 if n % 10 == 1 else 1 if n % 10 in (2, 3, 4) else 2


def plural(n: int, forms: tuple[str, str, str]) -> str:
    return forms[form(n)]


def below_thousand(n: int, feminine: bool = False) -> list[str]:
    out = [HUNDREDS[n // 100]] if n >= 100 else []
    n %= 100
    if n >= 20:
        out.append(TENS[n // 10])
        n %= 10
    if n or not out:
        word = UNITS[n]
        out.append({"один": "одна", "два": "две"}.get(word, word) if feminine else word)
    return out


def cardinal(n: int, feminine: bool = False) -> str:
    if n < 0:
        return "минус " + cardinal(-n, feminine)
    if n >= 10**9:
        return str(n)
    out = []
    for size, forms, fem in ((10**6, MILLION, False), (1000, THOUSAND, True)):
        if n >= size:
            out += [*below_thousand(n // size, fem), plural(n // size, forms)]
            n %= size
    return " ".join(out + (below_thousand(n, feminine) if n or not out else []))


def signed(token: str, feminine: bool = False) -> str:
    """A whole number as written: -0 keeps its sign."""
    n = int(token)
    return "минус ноль" if n == 0 and token.startswith("-") else cardinal(n, feminine)


def genitive(n: int) -> str:
    if n < 0:
        return "минус " + genitive(-n)
    if n >= 1000:
        return cardinal(n)
    out = [GENITIVE_HUNDREDS[n // 100]] if n >= 100 else []
    n %= 100
    if n >= 20:
        out.append(GENITIVE_TENS[n // 10])
        n %= 10
    return " ".join(out + ([GENITIVE_UNITS[n]] if n or not out else []))


def _ended(stem: str, case: str) -> str:
    if stem == "трет*":
        return THIRD[case]
    return stem.rstrip("*") + ENDINGS[case][stem.endswith("*")]


def ordinal_below_hundred(n: int, case: str) -> str:
    if n < 20:
        return _ended(ORDINAL_UNITS[n], case)
    if n % 10 == 0:
        return _ended(ORDINAL_TENS[n // 10], case)
    return f"{TENS[n // 10]} {_ended(ORDINAL_UNITS[n % 10], case)}"


def day(n: int, case: str = "neuter") -> str:
    """Day of a month; the plain fourth is written without ё in the neuter."""
    return "четвертое" if (n, case) == (4, "neuter") else ordinal_below_hundred(n, case)


def year(n: int, case: str) -> str:
    """1000 to 9999 as an ordinal, others as a number."""
    if not 1000 <= n <= 9999:
        return cardinal(n)
    thousands, rest = divmod(n, 1000)
    if not rest:
        return _ended(ORDINAL_THOUSANDS[thousands], case)
    out = ["тысяча"] if thousands == 1 else [*below_thousand(thousands, True), plural(thousands, THOUSAND)]
    if rest % 100 == 0:
        return " ".join([*out, _ended(ORDINAL_HUNDREDS[rest // 100], case)])
    if rest >= 100:
        out.append(HUNDREDS[rest // 100])
    return " ".join([*out, ordinal_below_hundred(rest % 100, case)])


def decimal(whole: str, fraction: str) -> str:
    """Up to three digits after the comma."""
    top, part = int(whole), int(fraction)
    names = FRACTIONS[len(fraction)]
    return f"{signed(whole, True)} {'целая' if form(top) == 0 else 'целых'} {cardinal(part, True)} {names[0] if form(part) == 0 else names[1]}"


def decimal_genitive(whole: str, fraction: str) -> str:
    names = FRACTIONS[len(fraction)]
    fem = lambda n: genitive(n)[:-len("одного")] + "одной" if genitive(n).endswith("одного") else genitive(n)
    one = form(int(fraction)) == 0
    return f"{fem(int(whole))} {'целой' if form(int(whole)) == 0 else 'целых'} {fem(int(fraction))} {names[0][:-2] + 'ой' if one else names[1]}"


def counted(n: int, forms: tuple[str, str, str], feminine: bool = False) -> str:
    return f"{cardinal(n, feminine)} {plural(n, forms)}"


def roubles(whole: str, fraction: str | None = None) -> str:
    """Kopecks of zero are silent."""
    n = int(whole)
    out = f"{signed(whole)} {plural(n, ROUBLE)}"
    cents = int(fraction.ljust(2, "0")) if fraction else 0
    return f"{out} {counted(cents, KOPECK, True)}" if cents else out
