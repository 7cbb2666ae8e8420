"""Text with its origin: cleaned characters, each with the place it came from."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from functools import cached_property

import numpy as np

SPACES = " \t\n\r\v\f\u00a0\u202f"
_TIGHT = ",.;:!?"
CYRILLIC = "\u0400-\u052f"
LATIN = "A-Za-z\u00c0-\u024f"
MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
TOKEN = re.compile(f"(?:[{CYRILLIC}{LATIN}+#_]+|[0-9]+(?:\\.[0-9]+)*)+")
HAS_CYRILLIC = re.compile(f"[{CYRILLIC}]")
HAS_LATIN = re.compile(f"[{LATIN}]")
WORD = re.compile(f"[{CYRILLIC}{LATIN}{MARKS}]+")
#: Case folding covers ASCII and Russian letters only.
FOLD = str.maketrans({c: c + 32 for c in [*range(65, 91), *range(0x410, 0x430)]} | {0x401: 0x451})


class Origin:
    """Byte offsets of the characters of a text; start[i] is where character i begins, start[-1] the length."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def start(self) -> Sequence[int]:
        if self.text.isascii():
            return range(len(self.text) + 1)
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        return [0, *np.cumsum(widths).tolist()]

    def span(self, begin: int, end: int) -> tuple[int, int]:
        return self.start[begin], self.start[end] - self.start[begin]


#: Runs of space that cleanup changes: of two or more, before closing punctuation, at the ends, or no plain space. A run is
#: met at its first character, so one lone space costs one step.
_LOOSE = re.compile(f" (?:[{SPACES}]+|(?=[,.;:!?]|\\Z))|[\t\n\r\v\f\u00a0\u202f][{SPACES}]*|^ ")


def _spots(text: str) -> list[tuple[int, int, str]]:
    """Where cleanup changes a text: (begin, end, what stands there then)."""
    return [(a, b, "" if a == 0 or b == len(text) or text[b] in ",.;:!?" else " ") for a, b in (m.span() for m in _LOOSE.finditer(text))]


def cleaned(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Spacing cleanup: runs of space become one, none at the ends or before closing punctuation. With the changes."""
    spots = _spots(text)
    if not spots:
        return text, spots
    out, at = [], 0
    for a, b, now in spots:
        out += [text[at:a], now]
        at = b
    return "".join([*out, text[at:]]), spots


class Places:
    """From indexes of a cleaned text to those of the text it came from."""

    def __init__(self, spots: list[tuple[int, int, str]]):
        self.cut, self.shift = [], []
        moved = 0
        for a, b, now in spots:
            moved += b - a - len(now)
            self.cut.append(b - moved)
            self.shift.append(moved)

    def __getitem__(self, i: int) -> int:
        k = bisect_right(self.cut, i) - 1
        return i + (self.shift[k] if k >= 0 else 0)


def tokens(text: str) -> list[tuple[int, int]]:
    """Words as (begin, end): letters, digits, + # _, and dots between digits."""
    return [m.span() for m in TOKEN.finditer(text)]


def folded(text: str) -> str:
    return text.translate(FOLD)


def language_of(text: str) -> str:
    return "russian" if HAS_CYRILLIC.search(text) else "english"
