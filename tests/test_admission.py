"""Numbers that stay whole with what clings to them, and time that grows with the text."""

import time

import pytest

from vocalis.kernel.frontend import Entry, Options, process

RU, EN, AUTO, SEGMENT = Options(language="russian"), Options(language="english"), Options(), Options(mixed="segment")


@pytest.mark.parametrize(
    "text, kept",
    [
        ("Рост 2.5% 40 лет", "2.5% 40"),
        ("Рост 2.5%/7", "2.5%/7"),
        ("Рост −3.5%тут", "−3.5%тут"),
        ("Всего +3 дня", "+3 дня"),
        ("Всего −3 дня", "−3 дня"),
        ("Есть 3 дня/4 тут", "3 дня/4"),
        ("Есть 3 книги́ тут", "3 книги́"),
        ("Есть 3 книгиz тут", "3 книгиz"),
        ("Есть 3 ошибкию тут", "3 ошибкию"),
        ("Есть 3 ошибки / 7 тут", "3 ошибки / 7"),
        ("Вес 3 кѓ тут", "3 кѓ"),
        ("Есть 3́ дня", "3́ дня"),
    ],
)
def test_malformed_numbers_stay_whole(text, kept):
    got = process(text, RU)
    assert got.normalized == text
    begin = len(text[: text.index(kept)].encode())
    assert [(a, n) for code, _, a, n in got.warnings if code == "unresolved_number"] == [(begin, len(kept.encode()))]


@pytest.mark.parametrize("text, spoken", [("Есть 3 книги, потом 4.", "Есть три книги, потом четыре."), ("-3 ошибки", "минус три ошибки"), ("Есть 3 книги 4", "Есть три книги четыре"), ("2.5", "2.5")])
def test_sound_numbers_beside_them_are_spoken(text, spoken):
    assert process(text, RU).normalized == spoken


def test_marked_units_stay_in_every_mode():
    for options in (RU, EN, AUTO, SEGMENT):
        assert process("3 кѓ.", options).normalized == "3 кѓ."


@pytest.mark.parametrize("piece, options", [("May 5, 2024 ", EN), ("в 1999 году ", RU), ("$5 and 3 km ", EN), ("Рост 2.5% 40 ", RU), ("от 5 книг до +3 книг ", AUTO)])
def test_time_grows_with_the_text(piece, options):
    """Eight times the text takes at most three times eight times as long."""
    took = []
    for n in (500, 4000):
        text = piece * n
        process(text, options)
        best = min(_timed(text, options) for _ in range(2))
        took.append(best)
    assert took[1] <= 24 * took[0]


@pytest.mark.parametrize("piece", ["C# ", "a@b.co ", "the cat ", "the C++ ", "HTTP/2 the "])
def test_time_grows_with_text_without_numbers(piece):
    """Technical spans, dictionary words and readings, and one number at the end."""
    options = Options(entries=(Entry("the", "thee"),))
    took = []
    for n in (1000, 8000):
        text = piece * n + "7"
        process(text, options)
        took.append(min(_timed(text, options) for _ in range(2)))
    assert took[1] <= 24 * took[0]


def _timed(text, options):
    start = time.perf_counter()
    process(text, options)
    return time.perf_counter() - start
