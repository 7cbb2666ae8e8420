"""Scientific numbers as an index of places, and how far a number goes on over further groups."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_LETTER = "A-Za-zÀ-ɏЀ-ԯ"
_MARK = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯"
_DASH = "‐-―−"
_PUNCTUATION = r"!-/:-@\[-`{-~"
_RUN = f"[0-9{_LETTER}{_MARK}{_PUNCTUATION}{_DASH}]"
#: Digits and an exponent: a whole one, an unfinished one at the text's end, or one that goes on as something else.
SCIENTIFIC = re.compile(f"(?<![0-9_{_LETTER}{_MARK}])[+−-]?[0-9]++[eE](?:[+-]?[0-9]++|[+-]?{_RUN}*+)[{_MARK}]*+(?:[#$]{_RUN}*+)?")
_SPACED_DASH = f"[{_DASH}][ \\t]*+(?=[0-9])"
_LEAD = f"[ \\t]*+(?:[{_PUNCTUATION}][ \\t]*+|{_SPACED_DASH})*+(?=[0-9])"
#: Groups that go on after a number: punctuation and spaces, then digits with what joins them; loose: letters as well.
_GROUPS = re.compile(f"(?:{_LEAD}(?:[0-9{_PUNCTUATION}]|{_SPACED_DASH})++)*+")
_LOOSE_GROUPS = re.compile(f"(?:{_LEAD}(?:[0-9{_PUNCTUATION}{_LETTER}{_MARK}]|{_SPACED_DASH})++)*+")


@dataclass(frozen=True)
class SurfaceIndex:
    """Scientific numbers of a text in order, as (begin, end); lookups take the logarithm of their number."""

    spans: tuple[tuple[int, int], ...]

    @staticmethod
    def of(text: str) -> SurfaceIndex:
        return SurfaceIndex(tuple(m.span() for m in SCIENTIFIC.finditer(text)))

    def _after(self, at: int) -> tuple[int, int] | None:
        """The first span that ends behind a place."""
        k = bisect_right(self.spans, at, key=lambda s: s[1])
        return self.spans[k] if k < len(self.spans) else None

    def contains(self, at: int) -> bool:
        """A place is inside of a number, behind its first character."""
        span = self._after(at)
        return span is not None and span[0] < at

    def overlaps(self, begin: int, end: int) -> bool:
        span = self._after(begin)
        return span is not None and span[0] < end


def goes_on(text: str, at: int, loose: bool = False) -> int:
    """Where the groups that go on from a place end; the place itself if none does."""
    return (_LOOSE_GROUPS if loose else _GROUPS).match(text, at).end()
