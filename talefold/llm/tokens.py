"""Token ids of whole texts, for the byte-level BPE files of a tokenizer folder.

A text is cut into words by array operations that follow the tokenizer's
pattern, and each distinct word is encoded once per task. Words that a hash takes
for equal are compared letter by letter, and remembered by the word itself. Texts
that hold the end-of-text string, or code points whose class is unknown here, go to
the `tokenizers` library as they are.
"""

from __future__ import annotations

import base64
import functools
import json
import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER, END, UNKNOWN = range(6)
#: The characters of the Unicode property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words that an encoder remembers, their longest, and code points that are looked at together.
WORDS_KEPT, LONG_WORD, SLAB = 100_000, 64, 400_000


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point; the last entry stands for the end of a text."""
    first = {"L": LETTER, "N": NUMBER}
    kinds = (unicodedata.category(chr(i)) for i in range(0x110000))
    out = np.fromiter((UNKNOWN if k in ("Cn", "Cs") else first.get(k[0], OTHER) for k in kinds), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return np.append(out, np.uint8(END))


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, from the 0th to the n-th."""
    both = int(MULTIPLIER), pow(int(MULTIPLIER), -1, 1 << 64)
    out = []
    for m in both:
        steps = np.full(n + 1, m, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return tuple(out)


def word_starts(cp: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where words start: contractions; a run of letters, numbers or others with
    one blank before it; white space up to the last one before a word."""
    start = np.ones(len(cp), bool)
    start[1:] = c[1:] != c[:-1]
    blank = c == SPACE
    last = np.zeros(len(cp), bool)
    last[:-1] = blank[:-1] & ~blank[1:] & (c[1:] != END)
    start |= last
    start[np.flatnonzero(last & (cp == 32)) + 1] = False
    at = np.flatnonzero(start[:-2] & (cp[:-2] == 39))
    a, b = cp[at + 1], cp[at + 2]
    is_ = lambda x, s: x == ord(s)
    one = at[is_(a, "s") | is_(a, "t") | is_(a, "m") | is_(a, "d")]
    two = at[(is_(a, "r") & is_(b, "e")) | (is_(a, "v") & is_(b, "e")) | (is_(a, "l") & is_(b, "l"))]
    start[one + 1] = start[two + 1] = False
    start[one + 2] = start[two + 3] = True
    return start


class Encoder:
    """ids(texts): one uint32 array per text, as Tokenizer.encode gives them.

    path: the tokenizer's JSON file. ranks: the same vocabulary as a file of ranks,
    which encodes single words faster; without it the JSON file serves for both.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.path = path
        self.word = self._plain
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=table, special_tokens={})
            self.word = lambda x: np.array(own.encode_ordinary(x), np.uint32)
        self.words: dict[str, np.ndarray] = {}

    @functools.cached_property
    def slow(self):
        """The library's tokenizer, loaded for the texts that need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _of(self, word: str) -> np.ndarray:
        got = self.words.get(word)
        if got is None:
            got = self.word(word)
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            if len(word) <= LONG_WORD:
                self.words[word] = got
        return got

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = self._plain(t)
                continue
            held.append(i)
            size += len(t)
            if size > SLAB:
                self._some(texts, held, out)
                held, size = [], 0
        self._some(texts, held, out)
        return out

    def _some(self, texts: list[str], held: list[int], out: list) -> None:
        if not held:
            return
        lens = np.array([len(texts[i]) for i in held])
        ends = np.cumsum(lens + 1) - 1  # of each text's end mark
        all_ = "\0".join(texts[i] for i in held)
        cp = np.full(ends[-1] + 4, 0x110000, np.uint32)
        cp[: ends[-1]] = np.frombuffer(all_.encode("utf-32-le"), np.uint32)
        cp[ends] = 0x110000
        c = classes()[cp]
        unknown = np.unique(np.searchsorted(ends, np.flatnonzero(c == UNKNOWN)))
        bounds = np.flatnonzero(word_starts(cp, c) | (c == END))
        s, e = bounds[:-1], bounds[1:]
        word = c[s] != END
        s, e = s[word], e[word]
        power, back = powers(1 << int(len(cp)).bit_length())
        code = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(29)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[: len(cp)])])
        h = (total[e] - total[s]) * back[s]
        h ^= h >> np.uint64(31)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        # Words of one hash that are not the first one's letters get a number of their own.
        size = e - s
        begin = np.cumsum(size) - size
        model = np.repeat((s[first][which] - begin).astype(np.int32), size)
        model += np.arange(len(model), dtype=np.int32)
        differ = cp[np.minimum(model, len(cp) - 1, out=model)] != cp[cp != 0x110000]  # words tile the texts
        odd = np.unique(np.concatenate([np.flatnonzero(size != size[first][which]), np.searchsorted(begin, np.flatnonzero(differ), "right") - 1]))
        which[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
        pieces = [self._of(all_[a:b]) for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        n = np.array([len(x) for x in pieces], np.int64)
        flat = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
        each = n[which]
        stop = np.cumsum(each)
        take = np.repeat((np.cumsum(n) - n)[which] - (stop - each), each) + np.arange(stop[-1] if len(stop) else 0)
        ids = flat[take]
        upto = np.concatenate([[0], stop])[np.searchsorted(s, ends)]
        low = 0
        for i, high in zip(held, upto.tolist(), strict=True):
            out[i] = ids[low:high]
            low = high
        for k in unknown.tolist():
            if k < len(held):
                out[held[k]] = self._plain(texts[held[k]])
