"""process(): one text to its spoken form, with pronunciation, words and diagnostics."""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

from vocalis.kernel import english, readers, russian, technical
from vocalis.kernel.stress import VOWELS
from vocalis.kernel.text import HAS_CYRILLIC, HAS_LATIN, WORD, Origin, Places, cleaned, folded, tokens

READINGS = {"english": english.INITIAL_READINGS, "russian": russian.INITIAL_READINGS}
# fixed diagnostic texts
PRESERVED = "Unsupported numeric-like candidate preserved verbatim"
INVALID = "Input is not valid UTF-8"
MIXED = {"dominant": "Mixed Cyrillic/Latin input uses dominant-language normalization", "segment": "Mixed Cyrillic/Latin input uses segmented candidate normalization"}
#: Names the stress bundle where the options do not.
BUNDLE = "VOCALIS_STRESS_BUNDLE"


@dataclass(frozen=True)
class Entry:
    """A dictionary entry. match: exact, folded (ignores case) or phrase."""

    pattern: str
    pronunciation: str
    match: str = "exact"
    stressed_vowel: int | None = None


@dataclass(frozen=True)
class Options:
    language: str = "auto"
    mixed: str = "dominant"
    fallback: str = "english"
    stress: str = "dictionary"
    cleanup: bool = True
    normalize: bool = True
    use_dictionary: bool = True
    resolve_stress: bool = True
    diagnostics: bool = False
    initialisms: bool = False
    entries: tuple[Entry, ...] = ()
    #: Where the stress bundle lies, and how it is opened: once a process, giving a function from a sentence to the same
    #: sentence with + before stressed vowels.
    bundle: str | None = None
    open_bundle: Callable[[str], Callable[[str], str]] | None = None

    def __post_init__(self):
        for value, known in ((self.language, ("auto", "english", "russian")), (self.mixed, ("dominant", "segment")), (self.fallback, ("english", "russian")), (self.stress, ("disabled", "dictionary", "automatic"))):
            if value not in known:
                raise ValueError(f"{value!r} is none of {known}")


@dataclass
class Result:
    original: str
    normalized: str = ""
    pronunciation: str = ""
    words: list = field(default_factory=list)
    replacements: list = field(default_factory=list)
    rewrites: list = field(default_factory=list)
    decisions: list = field(default_factory=list)
    warnings: list = field(default_factory=list)


def dominant(text: str, shields: list[tuple[int, int]], mixed: str) -> tuple[str, bool]:
    """The language of a text, and whether both scripts stand outside technical spans."""
    outside, at = [], 0
    for a, b in [*shields, (len(text), len(text))]:
        outside.append(text[at:a])
        at = b
    rest = "".join(outside)
    if mixed != "segment":
        both = HAS_CYRILLIC.search(rest) is not None and HAS_LATIN.search(rest) is not None
        return ("russian" if HAS_CYRILLIC.search(text) else "english"), both
    cyrillic, latin = len(HAS_CYRILLIC.findall(rest)), len(HAS_LATIN.findall(rest))
    return ("russian" if cyrillic and cyrillic >= latin else "english"), bool(cyrillic and latin)


def _beside(text: str, end: int, default: str) -> str:
    """Language of the word right after a number, by its script."""
    at = end + 1 if text[end : end + 1] == " " else end
    m = WORD.match(text, at)
    if not m or (HAS_CYRILLIC.search(m[0]) and HAS_LATIN.search(m[0])):
        return default
    return "russian" if HAS_CYRILLIC.search(m[0]) else "english"


def _reach(text: str) -> tuple[int, int] | None:
    """Where the first word of a text begins and the last one ends."""
    first = last = WORD.search(text)
    for last in WORD.finditer(text):
        pass
    return (first.start(), last.end()) if first else None


class Cover:
    """Spans that others may overlap."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def meets(self, begin: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > begin


class Reading:
    """One pass over a cleaned text: pieces of output, and the spans that stayed."""

    def __init__(self, text: str, language: str, segments: bool, shields: list[tuple[int, int]]):
        self.text, self.language, self.segments = text, language, segments
        self.shields = shields
        self.kept: list[tuple[int, int]] = []
        self.out: list[str] = []
        self.whole = False  # the number just read is kept together even where it meets a technical span
        self._read()

    def _copy(self, a: int, b: int) -> None:
        self.out.append(self.text[a:b])

    def _fixed(self) -> list[tuple[int, int, str | None]]:
        """Spans that are decided before numbers: technical ones, kept ones, abbreviations."""
        found: list[tuple[int, int, str | None]] = [(a, b, None) for a, b in self.shields]
        self.kept = readers.kept(self.text, self.language)
        found += [(a, b, None) for a, b in self.kept]
        if self.language == "russian":
            found += [(*m.span(), spoken) for p, spoken in readers.ABBREVIATIONS for m in p.finditer(self.text)]
        return sorted(found, key=lambda f: (f[0], -f[1]))

    def _number(self, at: int, limit: int) -> tuple[int, str | None]:
        """End of the number at a place, and how it is spoken (None: it stays)."""
        language = self.language
        if self.segments:
            m = readers.SURFACE.match(self.text, at)
            if self.text[at] == "$":
                language = "english"
            elif readers.DOTTED_DATE.match(self.text, at):
                language = "russian"
            elif "%" not in m[0]:
                language = _beside(self.text, m.end(), language)
        if readers.GLUED.search(self.text[max(0, at - 2) : at]):
            return readers.SURFACE.match(self.text, at).end(), None
        if (end := readers.malformed(self.text, at, language)) is not None:
            self.whole = True
            return end, None
        for reader in readers.READERS[language]:
            m = reader.pattern.match(self.text, at)
            if m and m.end() <= limit and (spoken := reader.say(m)) is not None:
                return m.end(), spoken
        return readers.SURFACE.match(self.text, at).end(), None

    def _read(self) -> None:
        text, at = self.text, 0
        begin = -1  # the next number, looked for again only once it is passed
        for a, b, spoken in [*self._fixed(), (len(text), len(text), None)]:
            while at < a:
                if begin < at:
                    m = readers.START.search(text, at)
                    begin = m.start() if m else len(text)
                if begin >= a:
                    break
                if self.language == "russian" and not self.segments and text[begin] == "$":
                    begin += 1  # the sign is no Russian currency; the number is read alone
                self._copy(at, begin)
                self.whole = False
                end, said = self._number(begin, len(text))
                if said is None:
                    end = min(end, a) if end > a and a > begin and not self.whole else end
                    if not readers.CODE.fullmatch(text[begin:end]):
                        self.kept.append((begin, end))
                    self._copy(begin, end)
                else:
                    self.out.append(said)
                at = end
            if at > a:
                if at < b and spoken is None:
                    self._copy(at, b)
                    at = b
                continue
            self._copy(at, a)
            if spoken is None:
                self._copy(a, b)
            else:
                self.out.append(spoken)
            at = b


def process(original: str, options: Options = Options(), brief: bool = False) -> Result:
    """The whole treatment of one text. brief: words may stand as their places only, where just their number is wanted."""
    out = Result(original)
    bytes_of: Origin | None = None
    text, spots = cleaned(original) if options.cleanup else (original, [])
    shields = technical.spans(text)
    language, both = dominant(text, shields, options.mixed)
    auto = options.language == "auto"
    if not auto:
        language = options.language
    if auto and (both if options.mixed == "segment" else HAS_CYRILLIC.search(text) and HAS_LATIN.search(text)):
        bytes_of = Origin(original)
        out.warnings.append(("ambiguous_normalization", MIXED[options.mixed], 0, bytes_of.start[-1]))
    normalized = text
    if options.normalize:
        segments = auto and options.mixed == "segment" and HAS_CYRILLIC.search(text) is not None
        reading = Reading(text, language, segments, shields)
        place = Places(spots)
        for a, b in sorted(set(reading.kept)):
            bytes_of = bytes_of or Origin(original)
            out.warnings.append(("unresolved_number", PRESERVED, *bytes_of.span(place[a], place[b - 1] + 1)))
        normalized = "".join(reading.out)
    if options.cleanup and normalized != text:
        normalized = cleaned(normalized)[0]
    out.normalized = normalized
    taken = _pronounce(out, options, language, auto, both, brief and options.stress != "automatic")
    if options.stress == "automatic" and options.resolve_stress:
        _accent(out, options, taken)
    return out


def process_bytes(data: bytes, options: Options = Options(), brief: bool = False) -> Result:
    """The treatment of bytes. Those that are not UTF-8 are not read: one diagnostic covers them all, and the original
    text shows replacement characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return Result(data.decode(errors="replace"), warnings=[("invalid_utf8", INVALID, 0, len(data))])
    return process(text, options, brief)


def bundle_of(options: Options) -> str | None:
    """The bundle's place: the option, else the environment, never a default."""
    return options.bundle or os.environ.get(BUNDLE) or None


@lru_cache(maxsize=8)
def _opened(open_bundle: Callable, bundle: str) -> Callable[[str], str]:
    return open_bundle(bundle)


def _marks(text: str, accented: str) -> tuple[set[int], str]:
    """The places of text that a + was put before, and the letters there now. Nothing else may change but е to ё."""
    marks, letters, at = set(), [], 0
    for i, c in enumerate(text):
        if c != "+" and accented[at : at + 1] == "+":
            marks.add(i)
            at += 1
        now = accented[at : at + 1]
        if now.lower() != c.lower() and (c.lower(), now.lower()) != ("е", "ё"):
            raise ValueError("the text came back changed")
        letters.append(now)
        at += 1
    if at != len(accented):
        raise ValueError("the text came back changed")
    return marks, "".join(letters)


def _accent(out: Result, options: Options, taken: list[tuple[int, int, str]]) -> None:
    """Automatic stress of all that nothing else has rewritten. Where it fails, everything stays and a diagnostic tells."""
    bundle = bundle_of(options)
    if options.open_bundle is None or bundle is None:
        lacks = "backend is not given (Options.open_bundle)" if options.open_bundle is None else f"bundle is not configured (set {BUNDLE} or Options.bundle)"
        out.warnings.append(("stress_backend_unavailable", f"Automatic stress {lacks}", 0, 0))
        return
    text = out.normalized
    hidden, at = [], 0
    for a, b, _ in taken:
        hidden += [text[at:a], "\x01" * (b - a)]
        at = b
    hidden = "".join([*hidden, text[at:]])
    try:
        marks, letters = _marks(hidden, _opened(options.open_bundle, bundle)(hidden))
    except Exception as error:  # any fault of a foreign model leaves the text as it is
        out.warnings.append(("stress_backend_unavailable", f"Automatic stress backend unavailable: {error}", 0, 0))
        return

    def spoken(a: int, b: int) -> str:
        return "".join("+" * (i in marks) + letters[i] for i in range(a, b))

    pieces, at = [], 0
    for a, b, said in taken:
        pieces += [spoken(at, a), said]
        at = b
    out.pronunciation = "".join([*pieces, spoken(at, len(text))])
    for k, (a, b) in enumerate(tokens(text)):
        mark = next((i for i in range(a, b) if i in marks), None)
        if out.words[k][5] or out.words[k][6] or (mark is None and letters[a:b] == text[a:b]):
            continue
        vowel = None if mark is None else sum(c.lower() in VOWELS for c in letters[a:mark])
        out.words[k] = (text[a:b], spoken(a, b), *out.words[k][2:4], vowel, False, False)
        out.decisions.append((text[a:b], vowel, False, "automatic"))


def _pronounce(out: Result, options: Options, language: str, auto: bool, both: bool, brief: bool) -> list[tuple[int, int, str]]:
    """Dictionary, initialisms and technical readings over the normalized text; then words and stress decisions. Gives
    the rewrites as (begin, end, said)."""
    text = out.normalized
    spans = tokens(text)
    offset = Origin(text)
    entries = options.entries if options.use_dictionary else ()
    words: dict[str, tuple[int, Entry]] = {}
    loose: dict[str, tuple[int, Entry]] = {}
    phrases: dict[tuple, tuple[int, Entry]] = {}
    for k, e in enumerate(entries):
        if e.match == "phrase":
            parts = tuple(e.pattern[a:b] for a, b in tokens(e.pattern))
            if parts:
                phrases.setdefault((e.pattern, parts[0]), (len(parts), e))
        else:
            (words if e.match == "exact" else loose).setdefault(e.pattern if e.match == "exact" else folded(e.pattern), (k, e))
    whole = {}
    for e in entries:
        if e.match == "phrase":
            whole.setdefault(e.pattern, e)
    by_first: dict[str, list[tuple[int, Entry]]] = {}
    for (_, first), found in phrases.items():
        by_first.setdefault(first, []).append(found)
    for found in by_first.values():
        found.sort(key=lambda f: -f[0])

    def found_word(word: str) -> Entry | None:
        """The first entry of the dictionary for a word, exact or folded."""
        best = min((x for x in (words.get(word), loose.get(folded(word))) if x), key=lambda x: x[0], default=None)
        return best and best[1]

    edits: list[tuple[int, int, str, str, Entry | None]] = []
    k = 0 if entries or options.initialisms else len(spans)
    while k < len(spans):
        a, b = spans[k]
        word = text[a:b]
        hit = next(((n, e) for n, e in by_first.get(word, ()) if text.startswith(e.pattern.strip(), a) and k + n <= len(spans) and spans[k + n - 1][1] == a + len(e.pattern.strip())), None)
        if hit:
            n, e = hit
            end = spans[k + n - 1][1]
            edits.append((a, end, e.pronunciation, "dictionary", e))
            out.replacements.append((text[a:end], e.pronunciation, offset.start[a]))
            k += n
            continue
        if best := found_word(word):
            edits.append((a, b, best.pronunciation, "dictionary", best))
            if best.pronunciation != word:
                out.replacements.append((word, best.pronunciation, offset.start[a]))
        elif options.initialisms and language == "russian" and word in russian.INITIALISMS:
            edits.append((a, b, russian.INITIALISMS[word], "initialism", None))
        k += 1
    taken = Cover([(a, b) for a, b, *_ in edits])
    if options.use_dictionary and technical.READABLE.search(text):
        closed = Cover([(a, b) for kind, a, b in technical.by_class(text) if kind in ("url", "email")])
        cyrillic, letters = HAS_CYRILLIC.search(text) is not None, _reach(text)
        for m in technical.READABLE.finditer(text):
            a, b = m.span()
            if taken.meets(a, b) or closed.meets(a, b):
                continue
            # a technical token's own entry, or else a phrase's, goes before its reading
            if best := found_word(m[0]) or whole.get(m[0]):
                edits.append((a, b, best.pronunciation, "dictionary", best))
                if best.pronunciation != m[0]:
                    out.replacements.append((m[0], best.pronunciation, offset.start[a]))
                continue
            tongue = language if not auto else None if both and options.mixed == "dominant" else language
            if auto and options.mixed == "segment":
                tongue = _owner(text, a, b) or options.fallback
            elif auto and not cyrillic and not (letters and (letters[0] < a or letters[1] > b)):
                tongue = options.fallback
            if tongue and (reading := READINGS[tongue].get(m[0])):
                edits.append((a, b, reading, "technical", None))
    edits.sort(key=lambda e: (e[0], -e[1]))
    pieces, at, applied = [], 0, []
    for a, b, said, why, _ in edits:
        if a < at:
            continue
        applied.append((a, b, said))
        pieces += [text[at:a], said]
        at = b
        if why != "dictionary":
            out.rewrites.append((text[a:b], said, offset.start[a], why, True))
    out.pronunciation = "".join([*pieces, text[at:]])

    starts = [e[0] for e in edits]
    if not edits and not options.diagnostics:
        if brief:
            out.words = spans
            return applied
        at = offset.start
        out.words = [(word := text[a:b], word, at[a], None, None, False, False) for a, b in spans]
        return applied
    order: dict[int, int] = {}
    for n, r in enumerate(out.replacements):
        order.setdefault(r[2], n)
    for a, b in spans:
        i = bisect_right(starts, a) - 1
        inside = edits[i] if i >= 0 and a < edits[i][1] else None
        entry = inside[4] if inside else None
        said = text[a:b] if not inside else inside[2] if inside[0] == a else ""
        number = order.get(offset.start[inside[0]]) if entry else None
        stressed = entry.stressed_vowel if entry and options.resolve_stress and options.stress != "disabled" else None
        out.words.append((text[a:b], said, offset.start[a], number, stressed, entry is not None, inside is not None and entry is None))
        if stressed is not None or options.diagnostics:
            out.decisions.append((text[a:b], stressed, stressed is not None, "dictionary" if stressed is not None else "undecided"))
    return applied


def _owner(text: str, begin: int, end: int) -> str | None:
    """Language of the nearest plain word in the same segment, the left one in ties."""
    left = max((text.rfind(c, 0, begin) for c in ".,;:!?\n"), default=-1) + 1
    right = min((i for c in ".,;:!?\n" if (i := text.find(c, end)) >= 0), default=len(text))
    best: tuple[int, int, str] | None = None
    for m in WORD.finditer(text, left, right):
        if m.start() < end and begin < m.end():
            continue
        cyr, lat = bool(HAS_CYRILLIC.search(m[0])), bool(HAS_LATIN.search(m[0]))
        if cyr == lat:
            continue
        far = (begin - m.end(), 0) if m.end() <= begin else (m.start() - end, 1)
        found = (*far, "russian" if cyr else "english")
        best = min(best, found) if best else found
    return best[2] if best else None
