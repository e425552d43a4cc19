"""Token ids of whole texts with a public tokenizer file, fast enough for a corpus.

The library's own encoder spends most of its time on normalising and splitting. For a
tokenizer that drops white space and never joins across it, a text's ids are the ids of its
words one after the other, so words are encoded once and remembered (bounded), and only the
rest goes through the full encoder. The ids are exactly those of ``Tokenizer.encode``.
"""

from __future__ import annotations

import functools
import json
import string
import unicodedata

import numpy as np
from tokenizers import Tokenizer

REMEMBERED = 150_000  # words in each of the two halves of a cache
LONGEST = 64  # bytes or letters of a remembered word: a text without white space is one word of any length

# The pipeline of tokenizer files for which words are independent.
WORDWISE_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDWISE_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_TAIL = string.punctuation.replace("'", "")  # an apostrophe may start an ending of its own


class _Memory(dict):
    """Remembers what ``make`` gives for words that are not too long; when full, forgets what was not used since the last time."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, word):
        if isinstance(word, (bytes, str)) and len(word) > LONGEST:
            return self.make(word)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``encode(text)``: the ids as little-endian bytes of ``dtype`` (two bytes where the
    vocabulary allows, else four)."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.wordwise = (
            (spec["normalizer"] or {}).get("normalizers") == WORDWISE_NORMALIZER and len(parts) == 2
            and parts[0]["type"] == "Split" and parts[0]["pattern"] == {"Regex": WORDWISE_SPLIT} and parts[0]["invert"]
            and parts[1]["type"] == "ByteLevel" and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"])
        self.letters = _byte_letters()
        self.pieces = _Memory(self._piece)
        self.words = _Memory(self._word)
        self.marks = [t["content"] for t in spec["added_tokens"]]

    def _full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        tokens = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return np.array([t.id for t in tokens], dtype=self.dtype).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        core = text.rstrip(_TAIL)
        if core.isalpha():  # letters, then nothing or one run of punctuation: one or two pieces
            tail = text[len(core):]
            return self.pieces[core] + (self.pieces[tail] if tail else b"")
        return self._full(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        text = text.encode("utf-8", "replace").decode()  # lone surrogates have no UTF-8
        low = text
        if not text.isascii():
            low = unicodedata.normalize("NFC", text)
            if "Σ" in low:  # capital sigma: str.lower() looks at its neighbours
                return self._full(text)
        if not self.wordwise or any(m in text or m in low.lower() for m in self.marks):
            return self._full(text)
        return b"".join(map(self.words.__getitem__, low.lower().encode().split()))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype=self.dtype)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file; it lives on between tasks."""
    return Encoder(path)
