"""English number words. Plain functions of integers and digit strings."""

from __future__ import annotations

# fixed values
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINAL_UNITS = "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
MONTHS = "January February March April May June July August September October November December".split()
#: Spoken unit by written unit.
MEASURES = {
    "kilometer": "kilometers kilometres kilometer kilometre km",
    "kilogram": "kilograms kilogram kg",
    "meter": "meters metres meter m",
    "centimeter": "cm",
    "millimeter": "mm",
    "gigabyte": "GB",
    "megabyte": "MB",
}
INITIAL_READINGS = {"RTX 4090": "R-T-X forty ninety", "C++": "C plus plus", "HTTP/2": "H-T-T-P two"}


def below_thousand(n: int) -> list[str]:
    out = []
    if n >= 100:
        out += [UNITS[n // 100], "hundred"]
        n %= 100
        if not n:
            return out
    if n < 20:
        return [*out, UNITS[n]]
    return [*out, TENS[n // 10], *([UNITS[n % 10]] if n % 10 else [])]


def cardinal(n: int) -> str:
    if n < 0:
        return "minus " + cardinal(-n)
    if n < 1000:
        return " ".join(below_thousand(n))
    if n >= 10**9:
        return str(n)
    out = []
    for size, name in ((10**6, "million"), (1000, "thousand")):
        if n >= size:
            out += [*below_thousand(n // size), name]
            n %= size
    return " ".join(out + (below_thousand(n) if n else []))


def ordinal(n: int) -> str:
    if n < 0:
        return "minus " + ordinal(-n)
    head, _, last = cardinal(n).rpartition(" ")
    if last in UNITS:
        last = ORDINAL_UNITS[UNITS.index(last)]
    elif last in TENS:
        last = last[:-1] + "ieth"
    else:
        last += "th"
    return f"{head} {last}".strip()


def suffix(n: int) -> str:
    """The written ending of an ordinal."""
    n = abs(n)
    return "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


def year(n: int) -> str:
    """Years from 1000 to 1999 in two halves, others as numbers."""
    if not 1000 <= n <= 1999:
        return cardinal(n)
    return f"{cardinal(n // 100)} {cardinal(n % 100) if n % 100 else 'hundred'}"


def digits(text: str) -> str:
    return " ".join(UNITS[int(c)] for c in text)


def signed(token: str) -> str:
    """A whole number as written: -0 keeps its sign."""
    n = int(token)
    return "minus zero" if n == 0 and token.startswith("-") else cardinal(n)


def decimal(whole: str, fraction: str) -> str:
    return f"{signed(whole)} point {digits(fraction)}"


def counted(n: int, one: str, many: str | None = None) -> str:
    return f"{cardinal(n)} {one if abs(n) == 1 else many or one + 's'}"


def dollars(whole: int, fraction: str | None) -> str:
    """Cents are spoken whenever they are written."""
    out = counted(whole, "dollar")
    return out if fraction is None else f"{out} {counted(int(fraction.ljust(2, '0')), 'cent')}"
