"""Readers: each knows one written form of a number and how it is spoken.

A text is read once from left to right. Where a number begins, the language's readers are tried in order on the text
from there; the first that accepts and ends at a clean border wins. If none does, the whole surface of the number (with
what clings to it) stays as it is and is reported once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from vocalis.kernel import english, russian

LIMIT = 999_999_999
_LETTER = "A-Za-z\u00c0-\u024f\u0400-\u052f"
_MARK = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
#: Nothing that would make the number longer may follow.
BORDER = f"(?![0-9_{_LETTER}{_MARK}]|[.,:/%=*#+\u2010-\u2015\u2212-]+[0-9{_LETTER}]|\\s?%)"
#: Where a number can begin: a currency sign, a sign or a digit, not inside a word or after a number's separator.
START = re.compile(f"(?<![0-9_{_LETTER}{_MARK}])(?<![0-9][.,:/%=*#+\u2010-\u2015\u2212-])(?:[$€£¥₽]\\s?[+\u2212-]?|[+\u2212-]?[$€£¥₽]?)[0-9]")
#: All that clings to a number which no reader accepts.
SURFACE = re.compile(f"[$€£¥₽]?\\s?[+\u2212-]?[$€£¥₽]?[0-9](?:[0-9_{_LETTER}{_MARK}€£¥₽$%]|[.,:/=*#+\u2010-\u2015\u2212-]+(?=[0-9A-Za-z\u00c0-\u024f]))*(?:\\s?%+|-(?=[\u0400-\u052f]))?")
_CURRENCY_AFTER = re.compile(r"\s?[€£¥₽]")


@dataclass(frozen=True)
class Reader:
    pattern: re.Pattern
    say: Callable[[re.Match], str | None]


def small(*tokens: str) -> bool:
    """Whole numbers of at most nine digits."""
    return all(abs(int(t)) <= LIMIT for t in tokens)


def _left(m: re.Match) -> str:
    """The text just before a match: more than the longest word that readers ask for there."""
    return m.string[max(0, m.start() - 24) : m.start()]


def valid_day(d: int, m: int, y: int) -> bool:
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return 1 <= m <= 12 and 1 <= d <= [31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]


def _reader(pattern: str, say, border: str = BORDER, flags: int = 0) -> Reader:
    return Reader(re.compile(pattern + border, flags), say)


def plain(token: str) -> str:
    """A number without its group separators."""
    return re.sub(r"[,\s]", "", token)


_ENGLISH_UNIT = {w: unit for unit, words in english.MEASURES.items() for w in words.split()}
_UNIT = "|".join(sorted(_ENGLISH_UNIT, key=len, reverse=True))
_WHOLE = r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,3}(?: [0-9]{3})+|[0-9]+"
# fixed values: words that start like a unit or a currency but are none the readers know keep their number as it is
ENGLISH_STEMS = "kg kilogram kilomet km meter metre m centimet cm millimet mm MB GB dollar euro pound yen руб кг".split()
ENGLISH_SURFACES = "kg kilogram kilograms km kilometer kilometers kilometre kilometres m meter meters metre metres cm mm MB GB dollar".split()
_FOLLOWING = re.compile(f"\\s?([{_LETTER}{_MARK}]+)")


def _unit_like(m: re.Match) -> bool:
    word = _FOLLOWING.match(m.string, m.end())
    return bool(word) and word[1] not in ENGLISH_SURFACES and any(word[1].startswith(s) for s in ENGLISH_STEMS)


def _en_date(m: re.Match) -> str | None:
    d, y = int(m[1]), int(m[2])
    month = re.search(r"\b([A-Z][a-z]+)\s$", _left(m))
    if not month or month[1] not in english.MONTHS or not valid_day(d, english.MONTHS.index(month[1]) + 1, y):
        return None
    return f"{english.ordinal(d)}, {english.cardinal(y)}"


def _en_year(m: re.Match) -> str | None:
    return english.year(int(m[0])) if 1000 <= int(m[0]) <= 2099 and re.search(r"\b(?:in|from)\s$", _left(m), re.I) else None


def _en_measure(m: re.Match) -> str | None:
    whole, fraction, unit = plain(m[1]), m[2], _ENGLISH_UNIT[m[3]]
    if not small(whole):
        return None
    many = fraction is not None or abs(int(whole)) != 1
    return f"{english.decimal(whole, fraction) if fraction else english.signed(whole)} {unit}{'s' * many}"


def _en_ordinal(m: re.Match) -> str | None:
    return english.ordinal(int(m[1])) if small(m[1]) and english.suffix(int(m[1])) == m[2] else None


def _clock(m: re.Match, say) -> str | None:
    h, mi = int(m[1]), int(m[2])
    return say(h, mi) if h <= 23 and mi <= 59 else None


def _en_whole(m: re.Match) -> str | None:
    return english.signed(plain(m[0])) if small(plain(m[0])) and not _unit_like(m) else None


ENGLISH = [
    _reader(r"([0-9]{1,2}), ([0-9]{4})", _en_date),
    _reader(rf"\$({_WHOLE})(?:\.([0-9]{{1,2}}))?", lambda m: english.dollars(int(plain(m[1])), m[2]) if small(plain(m[1])) else None),
    _reader(r"(-?[0-9]+)(st|nd|rd|th)", _en_ordinal),
    _reader(rf"(-?(?:{_WHOLE}))(?:\.([0-9]+))?\s*%", lambda m: f"{english.decimal(plain(m[1]), m[2]) if m[2] else english.signed(plain(m[1]))} percent" if small(plain(m[1])) else None),
    _reader(r"([0-9]{1,2}):([0-9]{2})", lambda m: _clock(m, lambda h, mi: f"{english.counted(h, 'hour')} {english.counted(mi, 'minute')}")),
    _reader(rf"(-?(?:{_WHOLE}))(?:\.([0-9]+))?\s*({_UNIT})", _en_measure),
    _reader(rf"(-?(?:{_WHOLE}))\.([0-9]+)", lambda m: english.decimal(plain(m[1]), m[2]) if small(plain(m[1])) else None),
    _reader(r"[0-9]{4}", _en_year),
    _reader(rf"-?(?:{_WHOLE})", _en_whole),
]

_RUSSIAN_UNIT = {w: forms for forms, words in russian.MEASURES.items() for w in words.split()}
_RU_UNIT = "|".join(sorted(_RUSSIAN_UNIT, key=len, reverse=True))
_RU_WHOLE = r"[0-9]{1,3}(?: [0-9]{3})+|[0-9]+"
_ROUBLE = r"(?:рублей|рубля|рубль|руб)"
_NOUN = {w: (forms, free) for forms, free in russian.NOUNS.items() for w in forms}


def _before(m: re.Match, words: str) -> bool:
    return re.search(rf"(?<![{_LETTER}])(?:{words})\s$", _left(m)) is not None


def _ru_date(m: re.Match) -> str | None:
    d, mo, y = int(m[1]), int(m[2]), int(m[3])
    if not valid_day(d, mo, y):
        return None
    return f"{russian.day(d, 'genitive' if _before(m, '[Пп]осле|[Дд]о') else 'neuter')} {russian.MONTHS[mo - 1]} {russian.year(y, 'genitive')} года"


def _ru_year(case: str, words: str, noun: str):
    def say(m: re.Match) -> str | None:
        return f"{russian.year(int(m[1]), case)} {noun}" if int(m[1]) >= 1000 and _before(m, words) else None

    return say


def _ru_measure(m: re.Match) -> str | None:
    whole, fraction, forms = plain(m[1]), m[2], _RUSSIAN_UNIT[m[3]]
    if not small(whole):
        return None
    if fraction:
        return f"{russian.decimal(whole, fraction)} {forms[1]}" if len(fraction) <= 3 else None
    return f"{russian.signed(whole)} {russian.plural(int(whole), forms)}"


def _ru_roubles(m: re.Match) -> str | None:
    """The dot of the abbreviation stays at the end of the text and goes before anything that follows."""
    if not small(plain(m[1])) or (m[2] and len(m[2]) > 2):
        return None
    dot = "." if m[3] and m.end() == len(m.string) else ""
    return russian.roubles(plain(m[1]), m[2]) + dot


def _ru_genitive(m: re.Match) -> str | None:
    n = int(m[0])
    return russian.genitive(n) if abs(n) <= 999 and russian.form(n) != 0 and _before(m, "[Пп]осле|[Ии]з") else None


def _ru_noun(m: re.Match) -> str | None:
    n, (forms, free) = int(plain(m[1])), _NOUN[m[2]]
    if not free and m[2] != russian.plural(n, forms):
        return None
    return f"{russian.cardinal(n, True)} {russian.plural(n, forms)}"


RUSSIAN = [
    _reader(r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})", _ru_date),
    _reader(r"([0-9]{4})\s*г\.", lambda m: f"{russian.year(int(m[1]), 'locative')} году" if int(m[1]) >= 1000 else None, border=""),
    _reader(r"([0-9]{4})\sгоду", _ru_year("locative", "[Вв]", "году"), border=f"(?![{_LETTER}])"),
    _reader(r"([0-9]{4})\sгод", _ru_year("nominative", "[Зз]а", "год"), border=f"(?![{_LETTER}])"),
    _reader(rf"(-?(?:{_RU_WHOLE})),([0-9]{{1,3}})\s*%", lambda m: f"{russian.decimal(plain(m[1]), m[2])} процента" if small(plain(m[1])) else None),
    _reader(rf"(-?(?:{_RU_WHOLE}))\s*%", lambda m: f"{russian.signed(plain(m[1]))} {russian.plural(int(plain(m[1])), russian.PERCENT)}" if small(plain(m[1])) else None),
    _reader(rf"(-?(?:{_RU_WHOLE}))(?:,([0-9]+))?\s*{_ROUBLE}(\.(?!\.))?", _ru_roubles, border=f"(?![{_LETTER}0-9_])"),
    _reader(r"([0-9]{1,2}):([0-9]{2})", lambda m: _clock(m, lambda h, mi: f"{russian.counted(h, russian.HOUR)} {russian.counted(mi, russian.MINUTE, True)}")),
    _reader(rf"(-?(?:{_RU_WHOLE}))(?:,([0-9]+))?\s*({_RU_UNIT})", _ru_measure),
    _reader(r"(-?[0-9]+),([0-9]{1,3})", lambda m: russian.decimal_genitive(m[1], m[2]) if _before(m, "до") and small(m[1]) else None),
    _reader(rf"(-?(?:{_RU_WHOLE})),([0-9]{{1,3}})", lambda m: russian.decimal(plain(m[1]), m[2]) if small(plain(m[1])) else None),
    _reader(r"-?[0-9]+", _ru_genitive),
    _reader(rf"(-?(?:{_RU_WHOLE}))\s({'|'.join(_NOUN)})", _ru_noun, border=f"(?![{_LETTER}])"),
    _reader(rf"-?(?:{_RU_WHOLE})", lambda m: russian.signed(plain(m[0])) if small(plain(m[0])) and not _CURRENCY_AFTER.match(m.string, m.end()) else None),
]
READERS = {"english": ENGLISH, "russian": RUSSIAN}
_CYR = "\u0400-\u052f"
_NUMBERED = rf"-?[0-9]+\s(?>{'|'.join(sorted(_NOUN, key=len, reverse=True))})"
#: A unit whose last letter bears a mark is none, in either language.
_MARKED_UNIT = re.compile(rf"-?[0-9]+(?:[.,][0-9]+)?\s?(?:{_RU_UNIT}|{_UNIT})[{_MARK}][{_LETTER}{_MARK}]*")
#: Numbers which stay with all that is read with them: tried before any reader.
MALFORMED = {
    "english": [_MARKED_UNIT],
    "russian": [
        _MARKED_UNIT,
        # a share with a dot, and what follows it at once
        re.compile(r"[+\u2212-]?[0-9]+\.[0-9]+%(?:\s[0-9]+|(?![.,;:?]+(?:\s|\Z))\S+)?"),
        # a sign that no reader takes, and the word counted
        re.compile(rf"[+\u2212][0-9]+\s[{_CYR}][{_LETTER}{_MARK}]*"),
        # a digit that bears a mark, and the word counted
        re.compile(rf"-?[0-9]+[{_MARK}][{_LETTER}{_MARK}]*\s[{_CYR}][{_LETTER}{_MARK}]*"),
        # a word with another number behind a slash or hash
        re.compile(rf"-?[0-9]+\s[{_CYR}]+[/#][0-9]+"),
        # a counted noun that goes on, or is set against another number
        re.compile(rf"{_NUMBERED}[{_LETTER}{_MARK}]+|{_NUMBERED}\s/\s[0-9]+"),
    ],
}


def malformed(text: str, at: int, language: str) -> int | None:
    """Where a malformed number ends that begins at a place; None if none does."""
    return next((m.end() for p in MALFORMED[language] if (m := p.match(text, at))), None)


ABBREVIATIONS = (re.compile(f"(?<![{_LETTER}])т\\.д\\."), "так далее"), (re.compile(f"(?<![{_LETTER}])т\\.п\\."), "тому подобное")
#: A number glued to a word's end by a slash, and the surface of a code: digits with Latin letters or a long word, which is no number.
GLUED = re.compile(f"[{_LETTER}{_MARK}]/$")
CODE = re.compile("[0-9]+(?:(?!(?:st|nd|rd|th)$)[A-Za-z]+|[\u0400-\u052f]{5,})")
DOTTED_DATE = re.compile(r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9])")


def _bad_dates(text: str) -> list[tuple[int, int]]:
    """English dates that no calendar has."""
    found = re.finditer(rf"\b({'|'.join(english.MONTHS)})\s([0-9]{{1,2}}),\s([0-9]{{4}})(?![0-9])", text)
    return [m.span() for m in found if not valid_day(int(m[2]), english.MONTHS.index(m[1]) + 1, int(m[3]))]


#: Years with a leading zero, and spans of years, stay as they are.
KEPT = {
    "english": [re.compile(r"(?i)\bfrom [0-9]{4} to [0-9]{4}(?![0-9])")],
    "russian": [re.compile(r"(?<![0-9.,:])0[0-9]{3}(?![0-9.,:]|\s*%)"), re.compile(r"(?<![А-Яа-яЁё])[Сс] [0-9]{4} по [0-9]{4} год")],
}


def kept(text: str, language: str) -> list[tuple[int, int]]:
    """Spans whose numbers stay, known before any number is read."""
    return [m.span() for p in KEPT[language] for m in p.finditer(text)] + (_bad_dates(text) if language == "english" else [])
