"""Technical spans: addresses, versions, identifiers. They are never rewritten by number rules."""

from __future__ import annotations

import re

# fixed patterns, by class
CLASSES = {
    "url": r"https?://[^\s]+",
    "email": r"(?:\b[A-Za-z][A-Za-z0-9.,_%+\-\u0080-\uffff]*|[A-Za-z0-9._%+-]+)@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b",
    "version": r"\b[vV][0-9]+(?:\.[0-9]+)+\b",
    "http": r"\bHTTP/[0-9]+(?:\.[0-9]+)?\b",
    "model": r"\b(?:RTX|CUDA|GPU|API)\s+[0-9]+(?:\.[0-9]+)?\b",
    "identifier": r"#[0-9]+|[A-Za-z][A-Za-z0-9+._$#-]*[-+$][A-Za-z0-9._$#-]+",
    "cpp": r"C\+\+",
    "csharp": r"C#",
}
_COMPILED = {k: re.compile(p, re.ASCII) for k, p in CLASSES.items()}
_DIGIT = re.compile("[0-9]")
READABLE = re.compile(r"(?<![A-Za-z0-9_@./-])(?:RTX 4090(?! Ti)|C\+\+|HTTP/2)(?![A-Za-z0-9_@/-]|\.[A-Za-z0-9])")


def _possible(text: str) -> list[tuple[str, re.Pattern]]:
    """Classes whose marks a text has at all."""
    number = _DIGIT.search(text) is not None
    marks = {"url": "://" in text, "email": "@" in text, "identifier": "#" in text or "-" in text or "+" in text or "$" in text, "cpp": "C++" in text, "csharp": "C#" in text, "http": "HTTP/" in text}
    return [(k, p) for k, p in _COMPILED.items() if marks.get(k, number)]


def spans(text: str) -> list[tuple[int, int]]:
    """All technical spans, touching ones merged, in order."""
    found = sorted(m.span() for _, p in _possible(text) for m in p.finditer(text))
    out: list[list[int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def by_class(text: str) -> list[tuple[str, int, int]]:
    return [(k, *m.span()) for k, p in _possible(text) for m in p.finditer(text)]
