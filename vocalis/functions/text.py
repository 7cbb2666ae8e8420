"""Text primitives as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocalis.kernel import russian, technical
from vocalis.kernel.text import CYRILLIC, LATIN

SPACE = "[ \\t\\n\\r\\x0B\\f\\u00A0\\u202F]"
TOKEN = f"(?:[{CYRILLIC}{LATIN}+#_]++|[0-9]++(?:\\.[0-9]++)*+)++"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
LOWER = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё"
VOWELS = "aeiouyAEIOUYаеёиоуыэюяАЕЁИОУЫЭЮЯ"
LIMIT = 999_999_999
# fixed values
IDENTIFIER_PREFIXES = ("RTX", "CUDA", "GPU", "API", "C++")


def clean_spacing(text: Column) -> Column:
    """Runs of space become one; none at the ends or before closing punctuation."""
    tight = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+\\z|{SPACE}+(?=[,.;:!?])", "")
    return F.regexp_replace(tight, f"{SPACE}+", " ")


def detect_language(text: Column) -> Column:
    return F.when(text.rlike(f"[{CYRILLIC}]"), "russian").otherwise("english")


def script_counts(text: Column) -> tuple[Column, Column]:
    """Numbers of Cyrillic and of Latin letters."""
    return tuple(F.length(F.regexp_replace(text, f"[^{s}]+", "")) for s in (CYRILLIC, LATIN))


def technical_marked(text: Column, name: str) -> Column:
    """A text has the characters that a technical class cannot do without."""
    marks = {"url": ("://",), "email": ("@",), "http": ("HTTP/",), "model": ("RTX", "CUDA", "GPU", "API"), "identifier": ("#", "-", "+", "$"), "cpp": ("C++",), "csharp": ("C#",), "version": ("v", "V"), "ipv4": (".",)}
    return reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in marks[name]])


#: Without one of these a text has no technical span of any class: addresses and versions need a point between digits.
MARKED = "[@#$+-]|://|HTTP/|[0-9]\\.[0-9]|RTX|CUDA|GPU|API"


def dominant_language(text: Column) -> Column:
    """The more frequent script outside technical spans decides; ties are Russian."""

    def without(name: str):
        # what is replaced leaves spaces only, so a class that has no marks in the text has none in the rest
        return lambda r: F.when(technical_marked(text, name), F.regexp_replace(r, technical_pattern(name), " ")).otherwise(r)

    rest = text
    for name in technical.CLASSES:
        rest = let(rest, without(name))
    rest = F.when(text.rlike(MARKED), rest).otherwise(text)
    count = lambda r: F.struct(*[n.alias(s) for n, s in zip(script_counts(r), ("cyrillic", "latin"), strict=True)])
    return let(let(rest, count), lambda n: F.when((n["cyrillic"] > 0) & (n["cyrillic"] >= n["latin"]), "russian").otherwise("english"))


def technical_pattern(name: str) -> str:
    """A class of technical spans for Java: word borders are ASCII, as in the kernel."""
    border = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return technical.CLASSES[name].replace("\\b", border).replace("\\s", "[ \\t\\n\\x0B\\f\\r]").replace("\\u0080-\\uffff", "\\u0080-\\uFFFF")


def known_prefix(token: Column) -> Column:
    """A token begins as a known identifier."""
    return reduce(Column.__or__, [token.startswith(p) for p in IDENTIFIER_PREFIXES])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def case_fold(text: Column) -> Column:
    """ASCII and Russian letters only, unlike lower()."""
    return F.translate(text, UPPER, LOWER)


def vowel_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{VOWELS}]", ""))


def whole_number(token: Column) -> Column:
    """The token as a whole number of at most nine digits, else null."""
    n = token.try_cast("bigint")
    return F.when(token.rlike("^[+-]?[0-9]+$") & n.between(-LIMIT, LIMIT), n.cast("int"))


def valid_date(d: Column, m: Column, y: Column) -> Column:
    """A day that the proleptic Gregorian calendar has."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return m.between(1, 12) & (d >= 1) & (d <= last)


def abbreviations(text: Column) -> Column:
    out = text
    for word, spoken in (("т\\.д\\.", "так далее"), ("т\\.п\\.", "тому подобное")):
        out = F.regexp_replace(out, f"(?<![{LATIN}{CYRILLIC}]){word}", spoken)
    return out


def initialism(token: Column) -> Column:
    """The reading of an initialism, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in russian.INITIALISMS.items() for x in kv]), token)


def initial_reading(surface: Column, readings: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in readings.items() for x in kv]), surface)


def utf8_valid(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def byte_offset(text: Column, index: Column) -> Column:
    """Bytes before code point index (from 0)."""
    return F.octet_length(F.substring(text, F.lit(1), index))


def ngrams(word: Column, least: int | Column, most: int | Column) -> Column:
    """All substrings of the word between < and >, of each length."""
    framed = F.concat(F.lit("<"), word, F.lit(">"))
    bound = lambda n: F.lit(n) if isinstance(n, int) else n
    return F.flatten(F.transform(F.sequence(bound(least), bound(most)), lambda n: F.when(F.length(framed) >= n, F.transform(F.sequence(F.lit(1), F.length(framed) - n + 1), lambda i: F.substring(framed, i, n))).otherwise(F.array().cast("array<string>"))))


def let(value: Column, use) -> Column:
    """use(value) where use names it several times, also inside of lambdas: it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(x: Column) -> Column:
    over = lambda each: let(F.aggregate(each, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(each, lambda v: v / total))
    return let(F.array_max(x), lambda top: let(F.transform(x, lambda v: F.exp(v - top)), over))


def argmax(x: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def case_like(model: Column, word: Column) -> Column:
    """word in the case of model: all upper, first upper, or as it is."""
    upper = (model == F.upper(model)) & (model != F.lower(model))
    first = F.substring(model, 1, 1)
    titled = (first == F.upper(first)) & (first != F.lower(first))
    return F.when(upper & (F.length(model) > 1), F.upper(word)).when(titled, F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))).otherwise(word)
