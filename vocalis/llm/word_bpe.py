"""Fast exact encoding with a word-level BPE tokenizers file: words are encoded once and remembered."""

from __future__ import annotations

import re
import sys
from array import array

from tokenizers import Tokenizer

#: Words remembered in one worker, about 100 MB; then the memory starts anew.
MEMORY_WORDS = 400_000
#: Letters then marks, Latin only: for these the file's own rules are plain, so the model is asked directly.
_PLAIN = re.compile("([a-z\xdf-\xf6\xf8-\xff]*)([!\"#$%&()*+,./:;<=>?@\\[\\]^_`{|}~-]*)")


def byte_letters() -> list[str]:
    """Byte-level alphabets show printable Latin-1 bytes as they are and the rest as letters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes, as the file's own encoding has them.

    Texts are cut at spaces and newlines, which the file's rules drop and never cross.
    """

    def __init__(self, path: str, memory_words: int = MEMORY_WORDS):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.memory: dict[str, bytes] = {"": b""}
        self.limit = memory_words
        self.letters = byte_letters()

    def _direct(self, word: str) -> list[int]:
        if not word:
            return []
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(word)]

    def _learn(self, words: set[str]) -> None:
        hard = []
        for w in words:
            low = w.lower()
            m = _PLAIN.fullmatch(low)
            if m:
                self.memory[w] = packed(self._direct(m[1]) + self._direct(m[2]))
            else:
                hard.append(w)
        for i in range(0, len(hard), 4096):
            part = hard[i : i + 4096]
            for w, e in zip(part, self.whole.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memory[w] = packed(e.ids)

    def forget(self) -> None:
        self.memory = {"": b""}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            words = text.replace("\n", " ").split(" ") if text else []
            ids = list(map(self.memory.get, words))
            if None in ids:
                if len(self.memory) > self.limit:
                    self.memory = {"": b""}
                self._learn({w for w in words if w not in self.memory})
                ids = map(self.memory.__getitem__, words)
            out.append(b"".join(ids))
        return out
