"""Best-fit packing of token pieces, refined by a swap-based local search.

A text's ids, closed by an end id, are one piece if they fit a sequence; longer
ones are cut from the back into full pieces, so the first piece takes what is
left over. Pieces are dealt evenly to groups of bounded size. In a group, pieces
go, longest first, to the fullest bin that takes them. Then the bins with room
are gone through from the emptiest: each of its pieces is moved to another bin,
or exchanged one-for-one or two-for-one for shorter ones of another bin, which
each time raises the sum of squared fills; a bin that runs empty is given up. All
bins are partners, with all their pieces, and passes go on until one changes
nothing or no fewer bins are possible by a lower bound.
Bins that are left half empty are dealt anew to groups of their own, until
one group takes all of them.

Defined cases: a null text is empty and gives one piece that holds the end id
alone; repeated rows are packed as often as they come; an empty table gives an
empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, parts
from .tokens import Encoder

ROOM, END_ID = 1024, 2
GROUP_ROWS = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, room: int) -> list[int]:
    """Starts of the pieces of n ids, and n: full pieces from the back."""
    return [0, *range(n - (n - 1) // room * room, n, room), n] if n > room else [0, n]


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None, room: int = ROOM, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with the CRC-32 of its ids as little-endian 32-bit numbers."""

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks)
        for part in parts(batches):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = cut_points(len(ids), room)
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, PIECES)


def least_bins(lengths: np.ndarray, room: int) -> int:
    """A lower bound: pieces over room - k stand alone, those over half a bin stand
    apart, and what the others of at least k don't find beside these needs more bins."""
    count = np.bincount(lengths, minlength=room + 1)
    n, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(room + 1))])
    k, half = np.arange(room // 2 + 1), room // 2
    alone = n[-1] - n[room - k + 1]
    paired = n[room - k + 1] - n[half + 1]
    beside = paired * room - (total[room - k + 1] - total[half + 1])
    return int((alone + paired + np.maximum(0, -((beside - (total[half + 1] - total[k])) // room))).max())


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins of positions; longest first, each to the fullest bin with room for it."""
    free: list[list[int]] = [[] for _ in range(room + 1)]  # bins by free room
    open_: list[int] = []  # amounts of free room that some bin has
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(open_, n)
        if at == len(open_):
            b, left = len(bins), room - n
            bins.append([i])
        else:
            f = open_[at]
            b, left = free[f].pop(), f - n
            if not free[f]:
                open_.pop(at)
            bins[b].append(i)
        if left:
            if not free[left]:
                insort(open_, left)
            free[left].append(b)
    return bins


def improve(lengths: np.ndarray, bins: list[list[int]], room: int) -> list[list[int]]:
    """Empties underfull bins by moves and exchanges, until a pass changes nothing or the lower bound is reached."""
    least = least_bins(lengths, room)
    own = np.empty(len(lengths), np.int64)
    for b, held in enumerate(bins):
        own[held] = b
    fill = np.bincount(own, lengths, len(bins)).astype(np.int64)
    members = [list(b) for b in bins]
    alive, changed = len(bins), True
    # pairs[b, x]: the largest sum of at most x of two pieces of bin b, or 0.
    pairs, known = np.zeros((len(bins), room + 1), np.int32), np.zeros(len(bins), bool)

    def put(i: int, b: int) -> None:
        members[own[i]].remove(i)
        fill[own[i]] -= lengths[i]
        members[b].append(i)
        fill[b] += lengths[i]
        known[own[i]] = known[b] = False
        own[i] = b

    def learn(b: int) -> None:
        """Brings pairs of bin b up to date."""
        each, n = np.unique(lengths[members[b]], return_counts=True)
        sums = np.add.outer(each, each)[np.triu(np.ones((len(each), len(each)), bool), 1)]
        sums = np.concatenate([sums, 2 * each[n > 1]])
        pairs[b] = 0
        pairs[b, sums] = sums
        np.maximum.accumulate(pairs[b], out=pairs[b])
        known[b] = True

    def two_of(c: int, total: int) -> tuple[int, int]:
        """Two pieces of bin c of that total length."""
        seen: dict[int, int] = {}
        for j in members[c]:
            if total - int(lengths[j]) in seen:
                return seen[total - int(lengths[j])], j
            seen[int(lengths[j])] = j
        raise ValueError("no such pieces")

    def step(b: int) -> bool:
        """One change that raises the squared fill and takes from bin b."""
        for i in sorted(members[b], key=lambda i: -lengths[i]):
            n = int(lengths[i])
            left = room - fill
            left[b] = -1
            fits = np.flatnonzero((left >= n) & (fill > 0) & (fill + n > fill[b]))
            if len(fits):
                put(i, int(fits[np.argmin(left[fits])]))
                return True
        for i in sorted(members[b], key=lambda i: -lengths[i]):
            n = int(lengths[i])
            spare = (room - fill)[own]
            short = np.flatnonzero((lengths < n) & (lengths + spare >= n) & (own != b) & (fill[own] + n - lengths > fill[b]))
            if len(short):
                j = int(short[np.argmin(lengths[short] + spare[short])])
                c = int(own[j])
                put(j, b)
                put(i, c)
                return True
        open_ = np.flatnonzero((fill > 0) & (fill < room))
        open_ = open_[open_ != b]
        for c in open_[~known[open_]].tolist():
            learn(c)
        for i in sorted(members[b], key=lambda i: -lengths[i]):
            n = int(lengths[i])
            # Below n, and so far below that c gets fuller than b was.
            two = pairs[open_, np.maximum(0, n - 1 + np.minimum(0, fill[open_] - fill[b]))]
            over = room - fill[open_] - n + two
            fits = np.flatnonzero((two > 0) & (over >= 0))
            if len(fits):
                at = int(fits[np.argmin(over[fits])])
                c = int(open_[at])
                for j in two_of(c, int(two[at])):
                    put(j, b)
                put(i, c)
                return True
        return False

    while changed and alive > least:
        changed = False
        for b in np.argsort(fill, kind="stable").tolist():
            if alive <= least:
                break
            if not 0 < fill[b] < room:
                continue
            while fill[b] and step(b):
                changed = True
            alive -= not fill[b]
    return [m for m in members if m]


def pack_group(room: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start"], ascending=False, kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        held = improve(lengths, best_fit(lengths, room), room)
        bin_, offset, filled = (np.empty(len(rows), np.int64) for _ in range(3))
        for b, items in enumerate(held):
            n = lengths[items]
            bin_[items], offset[items], filled[items] = b, np.cumsum(n) - n, n.sum()
        return rows.drop(columns="part").assign(sequence_id=(int(key[0]) << 32) + bin_, offset=offset, filled=filled)

    return run


def pack(pieces: DataFrame, room: int = ROOM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces with sequence_id and offset; no sequence is longer than room."""
    out, first, left = None, 0, cut(pieces)
    n = left.count()
    while True:
        n_parts = max(1, -(-n // group_rows))
        dealt = left.withColumn("part", F.monotonically_increasing_id() % n_parts + first)
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema)
        done = cut(dealt.groupBy("part").applyInPandas(pack_group(room), f"{fields}, sequence_id long, offset long, filled long"))
        again = done.where(F.col("filled") * 2 < room) if n_parts > 1 else None
        kept = (done.where(F.col("filled") * 2 >= room) if n_parts > 1 else done).drop("filled")
        out = kept if out is None else out.unionByName(kept)
        if again is None:
            return out
        left, first = again.select(*left.columns), first + n_parts
        n = left.count()
        if not n:
            return out
