"""Encoding with a vocabulary file of the tokenizers library, each distinct word once.

The vocabulary's pre-tokenizer never joins text across white space, so the ids of a text are the ids
of its words in order. Words repeat, so a worker keeps the ids of the words it has met. A new word of
Latin letters goes through the library's BPE model alone, as the rest of its chain (lower case,
splitting, byte alphabet) is known for it; any other goes through the whole chain.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

#: Words that a worker keeps, some 170 bytes each. They come in two generations: when the younger is full,
#: the older is dropped, but for what was used since. The pieces of a word are kept as words, too: split by
#: itself, a piece is one piece.
CACHE_WORDS = 500_000

# The split pattern of the vocabulary file, and the characters whose lower case and
# composed form depend on nothing but themselves.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = re.compile(r"[\x00-įı-ɏ]+")
# Information separators: white space to str.split, but not to the vocabulary.
ODD_SPACE = re.compile(r"[\x1c-\x1f]")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Cache(dict):
    """The younger generation of a cache; what it lacks comes from the older, or is made."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.half, self.old = make, entries // 2, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        self[key] = ids
        return ids


class Encoder:
    """ids(text): what Tokenizer.encode(text, add_special_tokens=False).ids has."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._known_chain(path)
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        self.words = _Cache(self.word, CACHE_WORDS)

    @staticmethod
    def _known_chain(path: str) -> bool:
        """True if the file's normalizer and pre-tokenizer are those that this module knows."""
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return norm == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": SPLIT.pattern} and spec.get("post_processor") is None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a lower-case piece of the split."""
        spelled = piece if piece.isascii() and piece.isalnum() else "".join([self.alphabet[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word that is not kept."""
        if "<|" in word or not (word.isascii() or PLAIN.fullmatch(word)):
            return self._whole(word)
        low = word.lower()
        pieces = [low] if low.isalpha() else SPLIT.findall(low)
        if len(pieces) > 1:
            return b"".join([self.words[p] for p in pieces])
        return self.piece(low) if low == word else self.words[low]

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is as empty."""
        if not text:
            return b""
        if not self.fast or ODD_SPACE.search(text):
            return self._whole(text)
        if "<|" not in text and PLAIN.fullmatch(text):
            text = text.lower()  # fewer distinct words
        return b"".join(map(self.words.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
