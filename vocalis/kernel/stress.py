"""Word stress from a model bundle: tokenising, subword pieces, exceptions, classifier choices.

The models themselves are callables (an onnxruntime session or any function), so tests use toys. Without a bundle the
frontend reports that no backend is there and changes nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

VOWELS = "аеёиоуыэюя"
_WORD = re.compile("[А-Яа-яЁё+-]+|[^А-Яа-яЁё+-]+")
_SURE_YO = 0.5


def words(sentence: str) -> list[str]:
    """Russian words and what stands between them, in order."""
    return _WORD.findall(sentence)


def clean(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalpha())


def grams(word: str, least: int = 1, most: int | None = None) -> list[str]:
    """Substrings of <word>, of every length."""
    framed = f"<{word}>"
    return [framed[i : i + n] for n in range(least, (most or len(framed)) + 1) for i in range(len(framed) - n + 1)]


def embed(word: str, vectors: dict[str, np.ndarray], size: int = 16) -> np.ndarray:
    """The mean of the known grams' vectors; zero without any."""
    known = [vectors[g] for g in grams(word) if g in vectors]
    return np.mean(known, axis=0, dtype=np.float32) if known else np.zeros(size, np.float32)


def pieces(word: str, vocabulary: dict[str, int], unknown: str = "[UNK]") -> list[int]:
    """Greedy longest pieces; those inside a word begin with ##. A word that has no cover is the unknown piece."""
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in vocabulary), None)
        if end is None:
            return [vocabulary[unknown]]
        out.append(vocabulary[mark + word[at:end]])
        at = end
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def like(model: str, word: str) -> str:
    """word in the letter case of model; a stress mark keeps its place."""
    letters = iter(model)
    return "".join(c if c == "+" else (c.upper() if (m := next(letters, "")) and m.isupper() else c) for c in word)


@dataclass
class Backend:
    """stress: batch of embeddings -> scores by vowel; yo: the same for which е is ё (the last class: none);
    homograph: (sentence pieces, position) -> probability of the second reading."""

    vectors: dict[str, np.ndarray]
    stress: Callable[[np.ndarray], np.ndarray]
    yo: Callable[[np.ndarray], np.ndarray] | None = None
    exceptions: dict[str, str] = field(default_factory=dict)
    homographs: dict[str, tuple[str, str]] = field(default_factory=dict)
    homograph: Callable[[list[int], int], float] | None = None
    vocabulary: dict[str, int] = field(default_factory=dict)
    phrases: list[tuple[str, str]] = field(default_factory=list)

    def _phrased(self, sentence: str) -> str:
        """The leftmost phrase rule that stands between word borders."""
        best = None
        for old, new in self.phrases:
            m = re.search(rf"(?<![А-Яа-яЁё]){re.escape(old)}(?![А-Яа-яЁё])", sentence)
            if m and (best is None or m.start() < best[0]):
                best = (m.start(), m.end(), new)
        return sentence if best is None else sentence[: best[0]] + best[2] + sentence[best[1] :]

    def _homographs(self, parts: list[str]) -> list[str]:
        if not self.homograph:
            return parts
        whole = [[i for i in pieces(clean(p), self.vocabulary)] if clean(p) else [] for p in parts]
        out = []
        for k, p in enumerate(parts):
            pair = self.homographs.get(clean(p))
            if pair and "+" not in p:
                before = sum(len(w) for w in whole[:k])
                p = like(p, pair[self.homograph([i for w in whole for i in w], before) >= 0.5])
            out.append(p)
        return out

    def accent(self, sentence: str) -> str:
        """+ before each word's stressed vowel. Exceptions and marks that are there win; a single vowel needs no mark."""
        parts = self._homographs(words(self._phrased(sentence)))
        open_ = [k for k, p in enumerate(parts) if clean(p) and "+" not in p and clean(p) not in self.exceptions and sum(c in VOWELS for c in clean(p)) > 1]
        if open_:
            batch = np.stack([embed(clean(parts[k]), self.vectors) for k in open_])
            scores = self.stress(batch)
            yo = softmax(self.yo(batch)) if self.yo else None
            for row, k in enumerate(open_):
                parts[k] = self._marked(parts[k], scores[row], yo[row] if yo is not None else None)
        return "".join(like(p, self.exceptions[clean(p)]) if "+" not in p and clean(p) in self.exceptions else p for p in parts)

    @staticmethod
    def _marked(word: str, scores: np.ndarray, yo: np.ndarray | None) -> str:
        vowels = [i for i, c in enumerate(word) if c.lower() in VOWELS]
        if yo is not None and len(yo) > 1:
            at = [i for i, c in enumerate(word) if c.lower() == "е"]
            best = int(yo[:-1].argmax())
            if best < len(at) and yo[best] > _SURE_YO:
                i = at[best]
                return word[:i] + "+" + like(word[i], "ё") + word[i + 1 :]
        i = vowels[int(np.argmax(scores[: len(vowels)]))]
        return word[:i] + "+" + word[i:]


def file_hash(path: str, step: int = 1 << 20) -> str:
    """SHA-256 of a file, read in steps."""
    if step <= 0:
        raise ValueError("a step is at least one byte")
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(step):
            digest.update(part)
    return digest.hexdigest()


def over_batches(make: Callable[[], Backend], column: str):
    """For mapInPandas: one backend a worker, made on first use; adds the accented text."""

    def run(batches: Iterator) -> Iterator:
        backend = make()
        for batch in batches:
            yield batch.assign(accented=[None if t is None else backend.accent(t) for t in batch[column]])

    return run
