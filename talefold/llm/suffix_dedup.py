"""Removal of long repeated byte strings by suffix sorting around anchors.

A byte goes if a string of SPAN bytes that covers it starts in two places of the
corpus. Equal windows of SPAN bytes share an anchor at the same offset (see
anchors.py), so windows are compared only under equal anchors:

1. Each text gives its anchors, with a 128-bit BLAKE2b digest of the bytes of all
   windows that the anchor marks (its context). Counted by anchor and digest, contexts
   that occur twice are repeated as a whole, however many copies there are. Equal contexts
   in a row, as in a text of one repeated letter or phrase, are one row with their number.
2. Anchors with several different contexts need a comparison. One of each context
   brings its bytes. The suffixes that start at the anchor, and the reversed
   prefixes that end there, are sorted by multikey quicksort to a shallow depth and
   by blind tries below it. Common prefixes of neighbours give the stretch that any
   two contexts share, and so the repeated windows.
3. An anchor with more contexts than one task sorts is split first: windows whose
   anchor lies in the first half of their offsets agree in the bytes that all of these
   windows hold, and likewise in the second half, so contexts are dealt by these bytes,
   and what is alone is left. Halving goes on until each group can be sorted or holds
   one window alone, which then repeats.

Windows never cross texts, and are judged on the input. Defined cases: a null text
is empty; texts shorter than SPAN lose nothing; repeated rows are places of their
own, so each removes the other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import K, SPAN, Prefix, anchors
from .scratch import cut, small
from .suffix_sort import pairwise

#: Contexts of one anchor that one task sorts at most; and of several anchors together.
GROUP, BATCH = 1000, 4000
#: Anchors after which a task hands rows on.
HANDED = 50_000
PLACED = "id long, k long, at long, first long, last long, ending long, times long, key long, context long, context2 long"
CONTEXT = ["key", "context", "context2"]
RUNS = "id long, k long, start long, stop long"


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(id_.alias("id"), F.xxhash64(id_, text).alias("k"), text.alias("text"))


def _ids(column: pd.Series) -> pd.Series:
    return column.astype("Int64")


def contexts_of(b: np.ndarray, span: int, k: int) -> list[np.ndarray]:
    """at, first, last, ending, times, key and digest (two numbers) of each anchor's context; of `times` equal contexts
    in a row, the first one and the last window of the last one."""
    at, key, first, last = anchors(Prefix(b), len(b), span, k)
    raw, digest, kept, previous = b.tobytes(), [], [], None
    for i, (f, t) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        context = raw[f : t + span]
        # Equal contexts have their anchors, the leftmost least hashes of their windows, at equal places.
        if context != previous:
            kept.append(i)
            digest.append(hashlib.blake2b(context, digest_size=16).digest())
            previous = context
    of = np.array(kept, np.int64)
    after = np.append(of[1:], len(at))
    return [at[of], first[of], last[of], last[after - 1], after - of, key[of].view(np.int64), *np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2).T]


def place(rows: DataFrame, span: int, k: int) -> DataFrame:
    """PLACED: the anchors of every text, the windows they mark, the anchor's hash, and its context's digest."""
    names = PLACED.replace(" long", "").split(", ")

    def table(out: list[tuple[int | None, int, list[np.ndarray]]]) -> pd.DataFrame:
        n = [len(found[0]) for _, _, found in out]
        whose = pd.DataFrame({"id": pd.array([i for i, _, _ in out], "Int64").repeat(n), "k": np.repeat([k for _, k, _ in out], n)})
        return whose.assign(**{name: np.concatenate(x) for name, x in zip(names[2:], zip(*(found for _, _, found in out), strict=True), strict=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for id_, of, text in zip(_ids(batch["id"]).tolist(), batch["k"].tolist(), batch["text"], strict=True):
                b = _bytes(text)
                if len(b) >= span:
                    out.append((id_, of, contexts_of(b, span, k)))
                    size += len(out[-1][2][0])
                if size >= HANDED:
                    yield table(out)
                    out, size = [], 0
            if out:
                yield table(out)

    return rows.where(F.octet_length("text") >= span).mapInPandas(run, PLACED)


def _cut_out(of_docs: DataFrame, rows: DataFrame) -> DataFrame:
    """id, k, at, first, last, key, before (reversed), after: the bytes of the contexts asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, k, text, spots in zip(batch["id"].tolist(), batch["k"].tolist(), batch["text"], batch["spots"], strict=True):
                b = _bytes(text).tobytes()
                for s in spots:
                    at, first, stop = s["at"], s["first"], s["last"] + s["span"]
                    out.append((id_, k, at, first, s["last"], s["key"], s["copies"], b[first:at][::-1], b[at:stop]))
            yield pd.DataFrame(out, columns=["id", "k", "at", "first", "last", "key", "copies", "before", "after"]).astype({"id": "Int64"})

    texts = rows.join(small(cut(of_docs.select("k").distinct())), "k", "left_semi").alias("t")
    both = of_docs.alias("d").join(texts, (F.col("t.k") == F.col("d.k")) & F.col("t.id").eqNullSafe(F.col("d.id")))
    return both.select("d.id", "d.k", "t.text", "d.spots").mapInPandas(run, "id long, k long, at long, first long, last long, key long, copies long, before binary, after binary")


def repeated_windows(at: np.ndarray, first: np.ndarray, last: np.ndarray, before: list[bytes], after: list[bytes], wanted: np.ndarray, span: int) -> list[tuple[int, int, int]]:
    """(position, start, stop) of bytes in windows that a context of the same anchor has too."""
    left, right = pairwise(before), pairwise(after)
    low = np.maximum((at - last)[:, None], span - right)  # offsets of the anchor in a shared window
    high = np.minimum((at - first)[:, None], left)
    np.fill_diagonal(high, -1)
    out = []
    for i in np.flatnonzero(wanted):
        found = np.flatnonzero(high[i] >= low[i])
        stretches = sorted(set(zip((at[i] - high[i][found]).tolist(), (at[i] - low[i][found] + span).tolist(), strict=True)))
        for n, (a, b) in enumerate(stretches):
            if not n or b > stop:
                out.append((i, a, b))
                stop = b
    return out


def _sorted_groups(contexts: DataFrame, n: int, batch: int, span: int) -> DataFrame:
    """RUNS of n contexts(..., part), each part sorted by itself, about `batch` contexts in a task's group."""
    groups = max(1, -(-n // batch))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in rows.groupby("part", sort=False):
            at, first, last = (g[c].to_numpy(np.int64) for c in ("at", "first", "last"))
            found = repeated_windows(at, first, last, g["before"].tolist(), g["after"].tolist(), g["copies"].to_numpy() == 1, span)
            ids, ks = g["id"].tolist(), g["k"].tolist()
            out += [(ids[i], ks[i], a, b) for i, a, b in found]
        return pd.DataFrame(out, columns=["id", "k", "start", "stop"]).astype({"id": "Int64"})

    return contexts.groupBy(F.pmod(F.xxhash64("part"), F.lit(groups)).alias("task")).applyInPandas(run, RUNS)


def _halves(contexts: DataFrame, span: int) -> DataFrame:
    """Contexts of crowded parts dealt anew: low and high bound the anchor's offset in a window, and the
    bytes that all windows of these offsets share become the part. first and last are cut to these windows."""
    middle = "((low + high) div 2)"
    two = F.explode(F.expr(f"array(struct(low, {middle} AS high), struct({middle} + 1 AS low, high))")).alias("range")
    half = contexts.select(*(c for c in contexts.columns if c not in ("low", "high")), two).select("*", "range.*").drop("range")
    # Of a context, the windows from at - high to at - low are left, if it has any of them.
    half = half.withColumn("first", F.greatest("first", F.expr("at - high"))).withColumn("last", F.least("last", F.expr("at - low"))).where("first <= last")
    shared = F.concat(F.lit("|"), F.expr("hex(substring(before, 1, int(low)))"), F.lit("|"), F.expr(f"hex(substring(after, 1, int({span} - high)))"))
    return half.withColumn("part", F.sha2(F.concat_ws(",", F.col("key").cast("string"), "low", "high", shared), 256))


def _split(crowded: DataFrame, span: int, k: int, group: int) -> tuple[DataFrame, DataFrame]:
    """crowded(key, ...) in parts of at most `group` contexts, and RUNS of windows that repeat without a sort."""
    open_ = crowded.withColumns({"part": F.col("key").cast("string"), "low": F.lit(0).cast("long"), "high": F.lit(span - k).cast("long")})
    ready = same = None
    while True:
        # All members of a part of one offset hold one and the same window.
        one = open_.where("low = high AND copies = 1").select("id", "k", F.col("first").alias("start"), (F.col("last") + span).alias("stop"))
        same = one if same is None else same.unionByName(one)
        halves = cut(_halves(open_.where("low < high"), span))
        sizes = cut(halves.groupBy("part").agg(F.count("*").alias("n"), F.min("copies").alias("fewest")).where("n > 1 AND fewest = 1").select("part", "n"))
        few = halves.join(small(cut(sizes.where(F.col("n") <= group).select("part"))), "part", "left_semi")
        ready = few if ready is None else ready.unionByName(few)
        many = cut(sizes.where(F.col("n") > group).select("part"))
        if many.isEmpty():
            return ready, same
        open_ = halves.join(small(many), "part", "left_semi")


def repeated_runs(rows: DataFrame, span: int = SPAN, k: int = K, group: int = GROUP, batch: int = BATCH) -> DataFrame:
    """RUNS: stretches of bytes, of any overlap, that windows with a second place cover; rows(id, k, text)."""
    placed = cut(place(rows, span, k))
    firsts = [F.first(c).alias(c) for c in ("id", "k", "at", "first", "last")]
    classes = cut(placed.groupBy(*CONTEXT).agg(F.sum("times").alias("copies"), *firsts))
    whole = placed.join(classes.where("copies > 1").select(*CONTEXT), CONTEXT).select("id", "k", F.col("first").alias("start"), (F.col("ending") + span).alias("stop"))

    # Written first, so that the join on the anchors is one of two shuffled sides, which a common anchor splits.
    keys = cut(classes.groupBy("key").agg(F.count("*").alias("n"), F.min("copies").alias("fewest")).where("n > 1 AND fewest = 1").select("key", "n"))
    chosen = cut(classes.join(small(keys.select("key")), "key", "left_semi"))
    spot = F.struct("at", "first", "last", "key", "copies", F.lit(span).alias("span"))
    of_docs = cut(chosen.groupBy("id", "k").agg(F.collect_list(spot).alias("spots")))
    contexts = cut(_cut_out(of_docs, rows).dropDuplicates(["key", "id", "k", "at"]))
    columns = ["part", "id", "k", "at", "first", "last", "copies", "before", "after"]
    crowded = cut(keys.where(F.col("n") > group).select("key"))
    if crowded.isEmpty():
        return whole.unionByName(_sorted_groups(contexts.withColumn("part", F.col("key").cast("string")).select(columns), contexts.count(), batch, span))
    calm = contexts.join(small(crowded), "key", "left_anti").withColumn("part", F.col("key").cast("string"))
    parts, same = _split(contexts.join(small(crowded), "key", "left_semi"), span, k, group)
    parts = calm.select(columns).unionByName(parts.select(columns))
    return whole.unionByName(same).unionByName(_sorted_groups(parts, parts.count(), batch, span))


def merged(spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of a list of stretches."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spots):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = K, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, runs (array of start, stop), kept (binary) for every row of docs."""
    rows = _rows(docs, id_col, text_col)
    spots = F.collect_set(F.struct("start", "stop"))
    runs = cut(repeated_runs(rows, span, k, **sizes).groupBy("id", "k").agg(spots.alias("spots")))
    touched = small(cut(runs.select("k").distinct()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists, kept = [], []
            for text, spots in zip(batch["text"], batch["spots"], strict=True):
                b = _bytes(text).tobytes()
                gone = merged([(s["start"], s["stop"]) for s in spots])
                lists.append([{"start": s, "stop": e} for s, e in gone])
                kept.append(b"".join(b[s:e] for s, e in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(b)], strict=True)))
            yield pd.DataFrame({"doc_id": _ids(batch["id"]), "n_bytes": [len(t.encode("utf-8", "replace")) for t in batch["text"]], "runs": lists, "kept": kept})

    schema = "doc_id long, n_bytes long, runs array<struct<start:long,stop:long>>, kept binary"
    t, r = rows.join(touched, "k", "left_semi").alias("t"), runs.alias("r")
    changed = t.join(r, (F.col("t.k") == F.col("r.k")) & F.col("t.id").eqNullSafe(F.col("r.id"))).select("t.id", "t.text", "r.spots").mapInPandas(run, schema)
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    same = rows.join(touched, "k", "left_anti").select(F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), none.alias("runs"), F.col("text").cast("binary").alias("kept"))
    return same.unionByName(changed)


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, changed (whether anything is removed)."""
    out = remove_repeats(docs, **options)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("runs") > 0).alias("changed"))
