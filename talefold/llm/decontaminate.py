"""Benchmark decontamination by winnowing.

Of each window of consecutive k-grams, the one with the least hash is kept with
its place, for documents and benchmark items alike. With windows of
`span - k + 1` k-grams, any shared run of `span` words has the same least k-gram
in both, so a join of the kept hashes finds it. Each hit is checked on the words
and extended to both sides; it counts if the extended run reaches `span` words.
An item of fewer words is looked up as a whole.

Only DataFrame functions are used. The items' fingerprints are broadcast if
they are counted to be few; else both sides are shuffled by hash, and a common
hash is split by the adaptive join.

Words are runs of characters outside ASCII or of ASCII letters and digits, with
A-Z lower-cased. Defined cases: a null or empty text has no words and hits
nothing; an item without words occurs nowhere; an item with a null id marks
words but is not listed; repeated rows give repeated results; an empty table
gives an empty result or, for items, no hits; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, cut

SPAN, K = 10, 5
#: Fixed values of the word pattern: what is not in these ranges is part of a word.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, BETWEEN), "")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_, text = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(id_.alias("id"), F.xxhash64(id_, text).alias("k"), text.alias("text"))


def _cut_words(rows: DataFrame) -> DataFrame:
    cut = rows.select("id", "k", words(F.col("text")).alias("words"))
    return cut.select("id", "k", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def _placed(rows: DataFrame, n: int, *more: str) -> DataFrame:
    """A row with `s` for each place, from 1, where a run of n words starts."""
    places = F.expr(f"IF(size(hashes) < {n}, CAST(array() AS array<int>), sequence(1, size(hashes) - {n - 1}))")
    each = rows.select("id", "k", "words", "hashes", *more, F.explode_outer(places).alias("s")).where("s IS NOT NULL")
    # Known not to be null, it makes Spark test nothing that is built on it.
    return each.withColumn("s", F.coalesce("s", F.lit(0)))


def _gram(start: int, n: int) -> str:
    """Hash of the n words from s + start on."""
    return f"xxhash64({', '.join(f'hashes[s + {start + j - 1}]' for j in range(n))})"


def fingerprints(rows: DataFrame, span: int, k: int) -> DataFrame:
    """id, k, words, at, key of each kept k-gram: its place and hash.

    The offset in the window stands in a hash's low bits, so the least one tells it. A
    window that keeps the place that the one before it keeps adds no row.
    """
    w = span - k + 1
    low = (1 << max(1, (w - 1).bit_length())) - 1
    gram = f"xxhash64({', '.join(f'hashes[i + {j}]' for j in range(k))})"
    grams = F.expr(f"IF(size(hashes) < {span}, CAST(array() AS array<bigint>), transform(sequence(0, size(hashes) - {k}), i -> {gram} & ~{low}L))")
    # Each hash is made once per place, so what runs per window stays a method small enough to be compiled.
    each = _placed(rows.withColumn("grams", grams), span, "grams")
    least = F.expr(f"least({', '.join(f'grams[s + {j - 1}] | {j}L' for j in range(w))})")
    kept = each.withColumn("least", least)
    # A window keeps a place anew if it is its last one, or was behind a lesser one so far.
    kept = kept.where(f"s = 1 OR least & {low}L = {w - 1}L OR grams[greatest(s, 2) - 2] <= least & ~{low}L")
    return kept.select("id", "k", "words", F.expr(f"s + int(least & {low}L)").alias("at"), F.expr(f"least & ~{low}L").alias("key"))


def _around(side: str, span: int, k: int) -> list[Column]:
    """The k-gram, the words before it (nearest first) and after it."""
    reach = span - k
    low = f"greatest(1, at - {reach})"
    return [
        F.expr(f"slice(words, at, {k})").alias(f"{side}_gram"),
        F.expr(f"reverse(slice(words, {low}, at - {low}))").alias(f"{side}_before"),
        F.expr(f"slice(words, at + {k}, {reach})").alias(f"{side}_after"),
    ]


def _agreed(a: str, b: str, reach: int) -> str:
    """How many leading elements of two arrays agree."""
    out = "0"
    for j in reversed(range(reach)):
        out = f"IF(coalesce(get({a}, {j}) = get({b}, {j}), false), 1 + {out}, 0)"
    return out


def _runs(docs: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    """id, k, item_id, start, stop of every run of at least span words that a document shares with an item."""
    known = fingerprints(items, span, k).select(F.col("id").alias("item_id"), "key", *_around("item", span, k)).distinct()
    found = fingerprints(docs, span, k)
    if known.count() <= BROADCAST_ROWS:
        hits = found.join(F.broadcast(known), "key").select("id", "k", "at", "item_id", "item_gram", "item_before", "item_after", *_around("doc", span, k))
    else:
        hits = found.select("id", "k", "at", "key", *_around("doc", span, k)).join(known, "key")
    hits = cut(hits)  # few; and what runs for every window stays a method small enough to be compiled
    reach = span - k
    before, after = _agreed("doc_before", "item_before", reach), _agreed("doc_after", "item_after", reach)
    ends = hits.where("doc_gram = item_gram").select("id", "k", "item_id", F.expr(f"at - {before}").alias("start"), F.expr(f"at + {k} + {after}").alias("stop"))
    return ends.where(f"stop - start >= {span}")


def _whole(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for items of exactly so many words: one pass looks for all lengths at each place."""
    of = lambda n: F.expr(_gram(0, n).replace("s + ", "1 + "))
    key = F.coalesce(*(F.when(F.size("words") == n, of(n)) for n in lengths))
    known = items.where(F.size("words").isin(lengths)).select(F.col("id").alias("item_id"), F.col("words").alias("own"), F.size("words").alias("n"), key.alias("key")).distinct()
    run_of = "array<struct<n:int,at:int,key:bigint>>"
    places = [f"IF(size(hashes) < {n}, CAST(array() AS {run_of}), transform(sequence(1, size(hashes) - {n - 1}), i -> named_struct('n', {n}, 'at', i, 'key', xxhash64({', '.join(f'hashes[i + {j - 1}]' for j in range(n))}))))" for n in lengths]
    each = docs.select("id", "k", "words", F.inline(F.expr(f"flatten(array({', '.join(places)}))")))
    run = F.expr("slice(words, at, n)").alias("run")
    if known.count() <= BROADCAST_ROWS:
        hits = each.join(F.broadcast(known), ["n", "key"]).select("id", "k", "at", "n", "item_id", "own", run)
    else:
        hits = each.select("id", "k", "at", "n", "key", run).join(known, ["n", "key"])
    return hits.where("own = run").select("id", "k", "item_id", F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("stop"))


def shared_runs(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, k (hash of id and text), item_id, start, stop (word places, from 1) of all shared runs."""
    docs, items = _cut_words(_rows(docs, id_col, text_col)), _cut_words(_rows(items, item_id, item_text))
    found = _runs(docs, items, span, k)
    lengths = sorted(n for (n,) in items.select(F.size("words").alias("n")).where(f"n BETWEEN 1 AND {span - 1}").distinct().collect())  # fewer than span
    return found.unionByName(_whole(docs, items, lengths)) if lengths else found


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, id_col: str = "doc_id", text_col: str = "text", **of_items: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    runs = shared_runs(docs, items, span, k, id_col, text_col, **of_items)
    covered = runs.groupBy("id", "k", "start", "stop").agg(F.collect_set(F.col("item_id").cast("string")).alias("names"))
    before = Window.partitionBy("id", "k").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = covered.withColumn("seen", F.coalesce(F.max("stop").over(before), F.lit(0)))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "seen"))
    marked = covered.groupBy("id", "k").agg(F.sum(new).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    rows = _rows(docs, id_col, text_col).select("id", "k", F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"))
    a, b = rows.alias("a"), marked.alias("b")
    both = a.join(b, (F.col("a.k") == F.col("b.k")) & F.col("a.id").eqNullSafe(F.col("b.id")), "left")
    hit = F.coalesce("b.n_hit", F.lit(0))
    names = F.coalesce("b.names", F.array().cast("array<string>"))
    return both.select(
        F.col("a.id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
