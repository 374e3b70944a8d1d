"""Spelling variants: words that differ by one letter, grouped under the form that is far more frequent.

Two words are near if they differ by exactly one inserted, deleted or replaced code
point. Near words share the first half of the shorter one, or its last half, as one
edit spoils one half at most. So each word is dealt by both halves, as the shorter
and as the longer word of a pair, and meets all its near words. Small halves fill
units of bounded size together; a half that more words share than fit a unit is cut
into slices, and each pair of slices is a unit.

In a unit the words are a bit-sliced position index: for each position and letter, a
bitset over the unit's words. A word is looked up by four bitsets that move along its
letters at once, 64 words a step: no error yet; one letter replaced; the indexed
word has one more (read one position ahead); or one less (one position behind).
Bitsets of a position are made when it is reached, so a word may have any length.

A word's form is its near word of largest count, if that is `times` its own count;
counts grow along forms, so following them ends, and doubling the steps takes a
logarithm of the longest way in joins.

Defined cases: a null or empty text has no words; a null id counts as an empty
string where ids mark rows; repeated rows count as often as they come; of near words
of one count the least in code-point order is taken; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut, small

#: Fixed value: the letters of a run.
LETTERS = "A-Za-zÀ-ÿ"
#: Words of a slice, and the letters that these have at most together.
SLICE, SLICE_LETTERS = 2048, 1 << 19
NEAR = "word string, n_near long, less long, near string"


def lower_ascii(c: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def misspelt(word: Column, mark: Column, every: int = 31) -> Column:
    """word without one code point, in one of `every` cases, chosen by the CRC-32 of mark:word."""
    h = F.crc32(F.concat(F.coalesce(mark.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, least: int = 7, times_seen: int = 2, change=misspelt) -> DataFrame:
    """word, n of the words of at least `least` letters that occur at least `times_seen` times.

    change: Column, Column -> Column, what becomes of a word given its row's id; it may shorten
    words but not lengthen them, so shorter runs are not looked at. None leaves words as they are.
    """
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{letters}]{{{least},}}"), F.lit(0))
    words = docs.select(F.col(id_col).alias("mark"), F.explode(runs).alias("word")).select("mark", lower_ascii(F.col("word")).alias("word"))
    if change:
        words = words.select(change(F.col("word"), F.col("mark")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times_seen)


def _bits(column: np.ndarray, letters: int) -> np.ndarray:
    """Bitset over the words of each letter in one position; one more, empty, for letters that no word has."""
    wide = -len(column) % 64
    is_ = np.arange(letters + 1, dtype=column.dtype)[:, None] == np.append(column, np.full(wide, letters + 1, column.dtype))
    is_[letters] = False
    return np.packbits(is_, axis=1, bitorder="little").view(np.uint64)


def near_words(queries: list[str], indexed: list[str], block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Places (in queries, in indexed) of all pairs that differ by exactly one edit."""
    if not queries or not indexed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_q = np.array([len(w) for w in queries])
    n_w = np.array([len(w) for w in indexed])
    wide = int(max(n_q.max(), n_w.max()))
    points = np.array([*queries, *indexed], dtype=f"U{wide}").view(np.uint32).reshape(-1, wide)
    alphabet = np.unique(points)
    alphabet = alphabet[alphabet > 0]
    absent = len(alphabet)
    code = np.minimum(np.searchsorted(alphabet, points), absent).astype(np.int32)
    code[points == 0] = absent
    asked, held = code[: len(queries)], code[len(queries) :]
    nothing = np.zeros((absent + 1, -(-len(indexed) // 64)), np.uint64)

    def at(p: int) -> np.ndarray:
        return _bits(held[:, p], absent) if 0 <= p < wide else nothing

    def of_length(n: int) -> np.ndarray:
        return _bits((n_w != n).astype(np.int32), 1)[0]

    found: list[tuple[np.ndarray, np.ndarray]] = []
    for m in np.unique(n_q):
        rows = np.flatnonzero(n_q == m)
        for some in np.array_split(rows, -(-len(rows) // block)):
            same = np.full((len(some), nothing.shape[1]), ~np.uint64(0))
            other, more, less = (np.zeros_like(same) for _ in range(3))
            behind, here = nothing, at(0)
            for i in range(m):
                ahead, letter = at(i + 1), asked[some, i]
                fits = here[letter]
                more |= same
                more &= ahead[letter]
                less &= behind[letter]
                less |= same
                other &= fits
                other |= same & ~fits
                same &= fits
                behind, here = here, ahead
            hit = (other & of_length(m)) | ((more | same) & of_length(m + 1)) | (less & of_length(m - 1))
            q, w = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, count=len(indexed), bitorder="little"))
            found.append((some[q], w))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _unit(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts and best near words that a unit's pairs give to its words."""
    short, last = int(rows["short"].iloc[0]), bool(rows["last"].iloc[0])
    one, two = rows[rows["one"]], rows[rows["two"]]
    both_ways = len(one) != len(rows)  # two slices: each pair is met once
    a, b = near_words(one["word"].tolist(), two["word"].tolist())
    q, w = one.iloc[a], two.iloc[b]
    q_word, w_word = q["word"].to_numpy(str), w["word"].to_numpy(str)
    # A pair counts in one unit alone: where its shorter word has the unit's length, in the half's own rows, by the first halves if both are shared.
    keep = (q["part"].to_numpy() == w["part"].to_numpy()) & (np.minimum(np.char.str_len(q_word), np.char.str_len(w_word)) == short)
    if last and len(q_word):
        half = f"U{short // 2}"
        keep &= q_word.astype(half) != w_word.astype(half)
    pairs = pd.DataFrame({"word": q["word"].to_numpy()[keep], "near": w["word"].to_numpy()[keep], "less": -w["n"].to_numpy()[keep]})
    if both_ways:
        back = pd.DataFrame({"word": pairs["near"], "near": pairs["word"], "less": -q["n"].to_numpy()[keep]})
        pairs = pd.concat([pairs, back], ignore_index=True)
    pairs = pairs.sort_values(["word", "less", "near"], kind="stable")
    met = pairs.groupby("word", sort=False).agg(n_near=("near", "size"), less=("less", "first"), near=("near", "first"))
    return met.reset_index()[["word", "n_near", "less", "near"]]


def near_counts(words: DataFrame, least: int = 7, rows: int = SLICE, letters: int = SLICE_LETTERS) -> DataFrame:
    """word, n_near, near (the near word of largest n), near_n for the words(word, n) that have near words; words are distinct."""
    n = F.length("word")
    routes = []
    for short in (n, n - 1):
        half = F.floor(short / 2).cast("int")
        for last in (False, True):
            part = F.substring("word", n - (short - half) + 1, n) if last else F.substring("word", F.lit(1), half)
            routes.append(F.struct(short.alias("short"), F.lit(last).alias("last"), part.alias("part")))
    dealt = words.select("word", "n", F.explode(F.array(*routes)).alias("r")).select("word", "n", "r.*").where(F.col("short") >= least)
    room = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(letters) / (F.col("short") + 1)))).cast("int")
    shared = cut(dealt.groupBy("short", "last", "part").agg(F.count("*").alias("c")))
    large = shared.where(F.col("c") > room).select("short", "last", "part", F.ceil(F.col("c") / room).cast("int").alias("slices"))
    units = shared.where(F.col("c") <= room).groupBy("short", "last").agg(F.sum("c").alias("c")).select("short", "last", F.ceil(F.col("c") / room).cast("int").alias("units"))
    dealt = dealt.join(small(cut(large)), ["short", "last", "part"], "left").join(small(units), ["short", "last"], "left")
    own, of = F.pmod(F.xxhash64("word", F.lit(1)), "slices").cast("int"), F.coalesce(F.col("slices"), F.lit(1))
    dealt = dealt.select("word", "n", "short", "last", "part", F.when(F.col("slices").isNotNull(), F.col("part")).alias("large"), F.when(F.col("slices").isNull(), F.pmod(F.xxhash64("part"), "units")).alias("unit"), F.coalesce(own, F.lit(0)).alias("own"), F.explode(F.sequence(F.lit(0), of - 1)).alias("other"))
    dealt = dealt.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = dealt.select("*", (F.col("own") == F.col("i")).alias("one"), (F.col("own") == F.col("j")).alias("two"))
    met = dealt.groupBy("short", "last", "large", "unit", "i", "j").applyInPandas(_unit, NEAR)
    best = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): the last form on the way; each round doubles the steps."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        up = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if state.join(up, "root", "left_semi").isEmpty():
            return state
        state = cut(state.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(words: DataFrame, least: int = 7, times: int = 10, **slices: int) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words(word, n)."""
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    form = F.when(F.col("near_n") >= times * F.col("n"), F.col("near"))
    named = cut(words.join(near_counts(words, least, **slices), "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), F.col("near_n")).cast("long").alias("form_n")))
    last = roots(named.where("form IS NOT NULL"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
