"""Word shingles of a text, as 64-bit hashes and as words."""

from __future__ import annotations

import hashlib
import string

import numpy as np

#: Fixed value: A-Z to a-z. Words are parted by blanks: 0x20 and 0x09 to 0x0D.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
STEP = 0x9E3779B97F4A7C15
#: Words whose hashes a worker remembers, and their longest.
WORDS_KEPT, LONG_WORD = 100_000, 64


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """A 64-bit hash of each word, by BLAKE2b; words are told apart in full."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= WORDS_KEPT:
            self.clear()
        if len(word) <= LONG_WORD:
            self[word] = h
        return h


HASHES = _Hashes()


def word_list(text: str | None) -> list[bytes]:
    """The words of the text in order, A-Z in lower case; bytes.split parts at just those blanks."""
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word of the text."""
    words = word_list(text)
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int = 5) -> set[tuple[bytes, ...]]:
    """The runs of `size` words themselves; the whole text's if it has fewer words, none if it has none."""
    w = word_list(text)
    n = min(size, len(w))
    return set(zip(*(w[k:] for k in range(n)), strict=False)) if n else set()


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; the whole text's if it has fewer words, none if it has none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(size, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(STEP) + w[k : len(w) - n + 1 + k])
    return np.unique(out)
