"""The row-level normaliser: spoken forms, preservation, diagnostics, pronunciation."""

import random

import time

import pytest

from vocalis.kernel.surfaces import SurfaceIndex, goes_on
from vocalis.kernel import english, russian, technical
from vocalis.kernel.frontend import Entry, Options, process, process_bytes
from vocalis.kernel.text import cleaned, folded, tokens

EN, RU, AUTO, SEGMENT = Options(language="english"), Options(language="russian"), Options(), Options(mixed="segment")


@pytest.mark.parametrize(
    "text, spoken",
    [
        ("Add 7% or 2.5% now", "Add seven percent or two point five percent now"),
        ("It costs $3, $3.07 or $1,200.", "It costs three dollars, three dollars seven cents or one thousand two hundred dollars."),
        ("the 3rd, 22nd and 112th", "the third, twenty second and one hundred twelfth"),
        ("at 7:30 and 0:01", "at seven hours thirty minutes and zero hours one minute"),
        ("3 km, 1 kg, -1 cm, 1.0 mm", "three kilometers, one kilogram, minus one centimeter, one point zero millimeters"),
        ("On May 3, 2021 we met", "On May third, two thousand twenty one we met"),
        ("born in 1987, from 1905", "born in nineteen eighty seven, from nineteen five"),
        ("12 345 678 things", "twelve million three hundred forty five thousand six hundred seventy eight things"),
        ("minus -0 and -5", "minus minus zero and minus five"),
        ("5 books, 0.50", "five books, zero point five zero"),
    ],
)
def test_english(text, spoken):
    got = process(text, EN)
    assert got.normalized == spoken and not got.warnings


@pytest.mark.parametrize(
    "text, spoken",
    [
        ("12% и 3,25%", "двенадцать процентов и три целых двадцать пять сотых процента"),
        ("3 руб. 50 коп", "три рубля пятьдесят коп"),
        ("цена 1 руб.", "цена один рубль."),
        ("2,05 рубля", "два рубля пять копеек"),
        ("в 14:02", "в четырнадцать часов две минуты"),
        ("3 км и 1,5 кг", "три километра и одна целая пять десятых килограмма"),
        ("24.12.1740", "двадцать четвёртое декабря тысяча семьсот сорокового года"),
        ("после 04.05.2003", "после четвёртого мая две тысячи третьего года"),
        ("В 3000 году, за 1812 год", "В трехтысячном году, за тысяча восемьсот двенадцатый год"),
        ("после 15 дней", "после пятнадцати дней"),
        ("2 ошибка и 21 книга", "две ошибки и двадцать одна книга"),
        ("1 234 567", "один миллион двести тридцать четыре тысячи пятьсот шестьдесят семь"),
        ("и т.д.", "и так далее"),
    ],
)
def test_russian(text, spoken):
    got = process(text, RU)
    assert got.normalized == spoken and not got.warnings


@pytest.mark.parametrize("text, options, spans", [("x 25:61 y", EN, [(2, 5)]), ("the 12st", EN, [(4, 4)]), ("on June 31, 2020", EN, [(3, 13)]), ("1,23.4", EN, [(0, 6)]), ("30.02.2020", RU, [(0, 10)]), ("цена 5 %%", RU, [(9, 4)]), ("€5", EN, [(0, 4)]), ("5 minutes", EN, [(0, 1)])])
def test_what_cannot_be_read_stays(text, options, spans):
    got = process(text, options)
    assert got.normalized == text
    assert [(w[2], w[3]) for w in got.warnings] == spans


@pytest.mark.parametrize("text", ["https://a.example/1?q=2", "a1@example.org", "10.0.0.1", "v1.2.3", "RTX 3080", "C++", "HTTP/2", "#42", "__MARK_A__"])
def test_technical_spans_stay(text):
    assert process(text, EN).normalized == text


def test_languages_of_mixed_texts():
    assert process("Купил 3 apples", AUTO).normalized == "Купил три apples"
    assert process("Купил 3 apples", SEGMENT).normalized == "Купил three apples"
    assert [w[0] for w in process("Купил 3 apples", AUTO).warnings] == ["ambiguous_normalization"]
    assert process("3 apples", AUTO).normalized == "three apples"


def test_pronunciation():
    entries = (Entry("GIF", "jif"), Entry("gif", "ghif", "folded", 1), Entry("New York", "noo york", "phrase"), Entry("New York City", "the city", "phrase"))
    got = process("GIF Gif New York City New York C++", Options(language="english", entries=entries))
    assert got.pronunciation == "jif ghif the city noo york C plus plus"
    assert [r[:2] for r in got.replacements] == [("GIF", "jif"), ("Gif", "ghif"), ("New York City", "the city"), ("New York", "noo york")]
    assert [r[3] for r in got.rewrites] == ["technical"]
    assert [w[1] for w in got.words][:5] == ["jif", "ghif", "the city", "", ""]
    assert ("Gif", 1, True, "dictionary") in got.decisions
    assert process("РФ и ВК", Options(language="russian", initialisms=True)).pronunciation == "эр эф и вэ ка"
    assert process("см. HTTP/2", RU).pronunciation == "см. аш ти ти пи два"
    assert [w[0] for w in process("a", Options(language="english", stress="automatic")).warnings] == ["stress_backend_unavailable"]


def test_options_are_checked():
    with pytest.raises(ValueError):
        Options(language="german")


def test_text_primitives():
    assert cleaned(" a  \t b ,c ")[0] == "a b,c"
    assert [("x1.5 y"[a:b]) for a, b in tokens("x1.5 y")] == ["x1.5", "y"]
    assert folded("ÉЖЁa") == "Éжёa"
    assert technical.spans("see https://x.y and a@b.co") == [(4, 15), (20, 26)]


def test_number_words():
    assert english.cardinal(-1_000_001) == "minus one million one" and english.cardinal(10**9) == "1000000000"
    assert [english.suffix(n) for n in (1, 2, 3, 4, 11, 112, 121)] == ["st", "nd", "rd", "th", "th", "th", "st"]
    assert russian.cardinal(2_001_002, True) == "два миллиона одна тысяча две"
    assert russian.year(1900, "locative") == "тысяча девятисотом" and russian.genitive(451) == "четырёхсот пятидесяти одного"
    assert russian.day(4) == "четвертое" and russian.day(24) == "двадцать четвёртое"


def test_invariants_on_random_texts():
    r = random.Random(4)
    parts = ["5", "12", "3.5", "7,5", "%", "$", "км", "kg", " ", " ", "-", "/", "#", ":", ".", ",", "год", "in ", "в ", "2024", "года", "é", "́", "½", "\U0001f600", "https://x.y/1", "C++", "\n", "1st", "руб.", "т.д."]
    for options in (EN, RU, AUTO, SEGMENT):
        for _ in range(400):
            text = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
            got = process(text, options)
            data = text.encode()
            seen = set()
            last = 0
            for code, _, a, n in got.warnings:
                data[a : a + n].decode()
                assert 0 <= a <= a + n <= len(data) and (code, a, n) not in seen
                seen.add((code, a, n))
                if code == "unresolved_number":
                    assert a >= last
                    last = a + n
            assert got.original == text
            again = process(got.normalized, options)
            assert again.normalized is not None


def test_technical_tokens_have_entries_of_their_own():
    entries = (Entry("RTX 4090", "the card"), Entry("http/2", "h two", "folded"), Entry("HTTP/2", "the phrase", "phrase"))
    got = process("RTX 4090, HTTP/2", Options(language="english", entries=entries))
    assert got.pronunciation == "the card, the phrase"
    assert process("HTTP/2", Options(language="english", entries=entries[:2])).pronunciation == "h two"


def test_bytes():
    assert process_bytes("в 1999 году".encode(), RU) == process("в 1999 году", RU)
    for data in (b"\xff 1", b"\xc0\x80", b"\xed\xa0\x80", "я".encode()[:1]):
        got = process_bytes(data)
        assert got.normalized == "" and got.warnings == [("invalid_utf8", "Input is not valid UTF-8", 0, len(data))]


def test_scientific_surfaces():
    text = "x 5e3 и -7E-2, 9e, 4euro a1e5"
    index = SurfaceIndex.of(text)
    assert [text[a:b] for a, b in index.spans] == ["5e3", "-7E-2", "9e,", "4euro"]
    brute = [(p, any(a < p < b for a, b in index.spans)) for p in range(len(text))]
    assert [(p, index.contains(p)) for p in range(len(text))] == brute
    assert all(index.overlaps(p, q) == any(a < q and p < b for a, b in index.spans) for p in range(len(text)) for q in range(p + 1, len(text)))
    assert not SurfaceIndex.of("").contains(0)


@pytest.mark.parametrize(
    "text, strict, loose",
    [
        (" / 4 - 5x", " / 4 - 5", " / 4 - 5x"),
        (", 12–13 кг", ", 12–13", ", 12–13"),
        (" –  7", " –  7", " –  7"),
        (" abc", "", ""),
        ("-", "", ""),
        ("", "", ""),
        ("!! 3 4 5", "!! 3 4 5", "!! 3 4 5"),
        ("/2я/3", "/2", "/2я/3"),
    ],
)
def test_groups_go_on(text, strict, loose):
    assert text[: goes_on(text, 0)] == strict
    assert text[: goes_on(text, 0, loose=True)] == loose


def test_groups_go_on_in_linear_time():
    began = time.perf_counter()
    assert goes_on(" – 1 / 2" * 100_000, 0) == 800_000
    assert goes_on(("- " * 200_000) + "x", 0) == 0
    assert time.perf_counter() - began < 5
