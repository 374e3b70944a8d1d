"""Near-duplicate components by b-bit MinHash.

Each document's set of distinct five-word shingles gives 128 minima. Bands of
four minima make its bucket keys; the two low bits of each (scrambled) minimum
are packed into four 64-bit words. Of two packed signatures, the share of
differing places, found by bit counts, estimates the similarity after the
chance agreement of two bits, 1/4, is taken out. Pairs of an estimate well below
the threshold (over five standard errors) are left; all others are confirmed on
the full sets, word for word. A pair at the threshold shares none of the 32 bands with a
probability below 1e-5.

No bucket's pairs are enumerated. Documents of one and the same set are first
one class. In each bucket the class that shares most with others is the hub. Each
class is confirmed with the hub that it is estimated to be nearest to, and these
links are joined to components. Only
what a bucket still holds outside its largest component is compared with the bucket's
rest, block by block where it is large, by longer signatures (2048 minima of one bit) whose estimate is far tighter;
pairs that pass it, each found in the first bucket that it shares, are confirmed as
well. So every pair in a bucket is either compared or already connected.

A bucket that holds more than CROWD classes outside its largest component (documents of
one template, which don't link) is not compared as it is. Its classes get finer buckets,
200 bands of ten of the long signature's minima: a pair at the threshold shares one but with a probability below
1e-5, one of similarity 0.55 does in half of the cases, one of 0.4 in one of fifty. In the finer
buckets the signatures are compared in blocks of BLOCK by BLOCK, as bits.

Defined cases: a null text is empty; a text without words has an empty set and
is linked with nothing; with fewer than five words, the whole sequence is its one
shingle; rows that share an id are one document; a row with a null id is linked
with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import cut, parts, small
from .shingles import mix, shingle_set, shingles

PERCENT, WORDS = 75, 5
BANDS, ROWS, BITS = 32, 4, 2
#: Shingles that a task of confirm keeps for further pairs of a document.
HELD = 100_000
#: Rows of a bucket that are compared in one piece.
BLOCK = 2_000
#: Minima of one bit in the longer signatures; their estimates below TIGHT are over four standard errors below 0.75.
LONG, TIGHT = 2048, 0.685
#: Classes outside a bucket's main component beyond which finer bands are taken, and these bands and their rows.
CROWD, FINE_BANDS, FINE_ROWS = 64, 200, 10
#: Rows of finer buckets that one group of a task compares, about, and rows of a block held against the others at once.
DEALT, STRIP = 20_000, 256
#: Estimates below this are over five standard errors below 0.75 with 128 minima of two bits.
LEAST_ESTIMATE = 0.5
SIGNATURE = "doc_id long, n_shingles long, set_key binary, bands array<long>, planes array<long>"


def _numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """n minima of a set of hashes, each under its own map of 32-bit numbers."""
    a = (_numbers(n, 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (_numbers(n, 2) >> np.uint64(32)).astype(np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (a[:, None] * x[None, i : i + 2048] + b[:, None]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[: bands * rows].reshape(bands, rows)[:, r])
    return keys.view(np.int64)


def signature(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys, one per band, and bit planes of the minima's low bits."""
    low = minima(hashes, bands * rows).astype(np.uint64)
    return band_keys(low, bands, rows), bit_planes(low, bits)


def bit_planes(low: np.ndarray, bits: int) -> np.ndarray:
    mixed = mix(low + np.uint64(0x632BE59BD9B4E019))
    planes = np.packbits([(mixed >> np.uint64(i)) & np.uint64(1) for i in range(bits)], axis=1, bitorder="little")
    return planes.astype(np.uint8).reshape(-1).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """SIGNATURE columns, one row per document; no set key, bands and planes for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids, n, sets, keys, planes = batch.column(0), [], [], [], []
            for doc, text in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingles(text, words)
                n.append(len(found))
                if len(found) and doc is not None:
                    sets.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    k, p = signature(found)
                else:
                    sets.append(None)
                    k = p = np.zeros(0, np.int64)
                keys.append(k)
                planes.append(p)
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *x])) for x in (keys, planes)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sets, pa.binary()), *lists], ["doc_id", "n_shingles", "set_key", "bands", "planes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SIGNATURE)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """id, sketch: one low bit of each of LONG minima, for docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [signature(shingles(t, words), LONG, 1, 1)[1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, sketch array<long>")


def fine_sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """id, sketch as bytes, fine: keys of the finer buckets, for docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            lows = [minima(shingles(t, words), LONG).astype(np.uint64) for t in batch.column(1).to_pylist()]
            planes, keys = [bit_planes(x, 1).tobytes() for x in lows], [band_keys(x, FINE_BANDS, FINE_ROWS) for x in lows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(planes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "sketch", "fine"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, sketch binary, fine array<long>")


def _alike(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in x and y of sketches (rows of words) whose estimate is TIGHT at least."""
    most = int((1 - TIGHT) / 2 * LONG)
    for i in range(0, len(x), STRIP):
        differ = np.zeros((len(x[i : i + STRIP]), len(y)), np.uint16)
        for w in range(x.shape[1]):
            differ += np.bitwise_count(x[i : i + STRIP, w, None] ^ y[None, :, w])
        p, q = np.nonzero(differ <= most)
        yield p + i, q


def _blocks(n: Column, most: Column) -> list[Column]:
    """Blocks of the n classes of a bucket, and of those outside its main component, which has `most`."""
    return [F.ceil(n / BLOCK).cast("int").alias("blocks"), F.ceil((n - most) / BLOCK).cast("int").alias("outer")]


def in_blocks(placed: DataFrame) -> DataFrame:
    """placed(id, component, main, blocks, outer, ...) dealt to groups i, j of a bucket: in each, the classes outside the main
    component of block i (left) meet all classes of block j (right). A row that is on both sides of a group is there once."""
    rows = placed.withColumn("block", F.expr("int(pmod(xxhash64(id), blocks))")).withColumn("row", F.expr("int(pmod(xxhash64(id, 1), outer))"))
    right = rows.withColumns({"i": F.explode(F.expr("sequence(0, outer - 1)")), "j": F.col("block")}).withColumns({"left": F.expr("component != main AND i = row"), "right": F.lit(True)})
    left = rows.where("component != main").withColumns({"i": F.col("row"), "j": F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x != block)"))}).withColumns({"left": F.lit(True), "right": F.lit(False)})
    return right.unionByName(left).drop("blocks", "outer", "block", "row")


def crowded_pairs(classes: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """a > b: classes(id, component) of different components that share a finer bucket and may be alike; docs(doc_id, text)."""
    # The components join before the keys are exploded: one row per class instead of FINE_BANDS.
    fine = cut(fine_sketches(docs, words).join(classes, "id"))
    placed = fine.select("id", "component", F.explode("fine").alias("key"))
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("component", "c").alias("main"))
    open_ = counts.where("n > most").select("key", "main", *_blocks(F.col("n"), F.col("most")))
    placed = cut(placed.join(open_, "key"))
    sides = in_blocks(placed)
    held = fine.select("id", "sketch").join(placed.groupBy("id").agg(F.collect_list("key").alias("places")), "id")
    groups = int(sides.count() // DEALT) + docs.sparkSession.sparkContext.defaultParallelism
    dealt = sides.join(held, "id").withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 2), np.int64)]
        for (key, _, _), g in rows.groupby(["key", "i", "j"], sort=False):
            a, b = (np.flatnonzero(g[side].to_numpy()) for side in ("left", "right"))
            if not len(a) or not len(b):
                continue
            sketch = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), -1)
            ids, of, main = g["id"].to_numpy(), g["component"].to_numpy(), g["main"].iloc[0]
            for p, q in _alike(sketch[a], sketch[b]):
                p, q = a[p], b[q]
                keep = (of[p] != of[q]) & ((of[q] == main) | (ids[p] < ids[q]))
                p, q = p[keep], q[keep]
                places = {x: set(g["places"].iloc[x]) for x in {*p.tolist(), *q.tolist()}}
                # A pair is handed on in the first of the finer buckets that it shares.
                once = np.fromiter((min(places[x] & places[y]) == key for x, y in zip(p.tolist(), q.tolist(), strict=True)), bool, len(p))
                p, q = ids[p[once]], ids[q[once]]
                found.append(np.stack([np.maximum(p, q), np.minimum(p, q)], axis=1))
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    # A stated number of partitions, as the work grows with the rows of a group, not with their bytes.
    return dealt.repartition(groups, "task").groupBy("task").applyInPandas(run, "a long, b long")


def estimate(a: str, b: str, n: int = BANDS * ROWS, bits: int = BITS) -> Column:
    """Similarity estimated from the bit planes in columns a and b."""
    per = n // 64
    differ = " + ".join("bit_count(" + " | ".join(f"({a}[{i * per + w}] ^ {b}[{i * per + w}])" for i in range(bits)) + ")" for w in range(per))
    chance = 0.5**bits
    return F.expr(f"(1 - ({differ}) / {n}D - {chance}D) / {1 - chance}D")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Those of pairs(a, b) whose full sets, compared word for word, are similar enough; docs(doc_id, text)."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = cut(docs.join(small(cut(ids)), "doc_id", "left_semi"))
    left, right = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set] = {}
        size = 0

        def of(doc: int, text: str) -> set:
            nonlocal size
            if doc not in held:
                if size > HELD:
                    held.clear()
                    size = 0
                held[doc] = shingle_set(text, words)
                size += len(held[doc])
            return held[doc]

        for batch in parts(batches):
            keep = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = of(a, x), of(b, y)
                both = len(x & y)
                keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(signatures(texts, words=words))
    classes = cut(signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("bands", "planes"), "doc_id").alias("s")).select("set_key", "id", "s.bands", "s.planes"))
    planes = classes.select("id", "planes")

    placed = classes.select("id", F.explode("bands").alias("key"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = cut(placed.join(sizes, "key"))
    # Of near copies, the one that is the least changed is in the most and largest buckets: it is their hub.
    central = shared.join(shared.groupBy("id").agg(F.sum("c").alias("score")), "id")
    hubs = central.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("id"))).alias("h")).select("key", (-F.col("h.id")).alias("hub"))
    members = cut(shared.drop("c").join(hubs, "key"))
    to_hub = members.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    signed_pairs = to_hub.join(planes.select(F.col("id").alias("a"), F.col("planes").alias("x")), "a").join(planes.select(F.col("id").alias("b"), F.col("planes").alias("y")), "b")
    near = signed_pairs.withColumn("like", estimate("x", "y")).where(F.col("like") >= LEAST_ESTIMATE)
    first = cut(near.groupBy("a").agg(F.max_by("b", F.struct("like", "b")).alias("b")))
    links = cut(confirm(first, texts, percent, words))

    known = components(links)
    labelled = cut(members.join(known, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    places = labelled.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("n"), F.max_by("component", "c").alias("main"), *_blocks(F.sum("c"), F.max("c")), (F.sum("c") - F.max("c") > CROWD).alias("crowded")).where("n > 1").drop("n")
    mixed = cut(labelled.join(cut(places), "key"))
    crowd, mixed = cut(mixed.where("crowded").select("id", "component").distinct()), mixed.where("NOT crowded").drop("crowded")
    unsure = texts.join(small(cut(mixed.select(F.col("id").alias("doc_id")).distinct())), "doc_id", "left_semi")
    mixed = cut(mixed.join(sketches(unsure, words), "id").join(classes.select("id", "bands"), "id"))
    p, q = ([F.col(c).alias(f"{c}_{side}") for c in ("id", "component", "bands", "sketch")] for side in "pq")
    # A large bucket is dealt into blocks, and each two blocks meet in a group of their own.
    sides = in_blocks(mixed)
    left, right = sides.where("left").select("key", "i", "j", *p), sides.where("right").select("key", "main", "i", "j", *q)
    pair = left.join(right, ["key", "i", "j"])
    once = "component_p != component_q AND (component_q = main OR id_p < id_q)"
    pair = pair.where(F.expr(once) & (estimate("sketch_p", "sketch_q", LONG, 1) >= TIGHT) & F.expr("array_min(array_intersect(bands_p, bands_q)) = key"))
    open_ = pair.select(F.greatest("id_p", "id_q").alias("a"), F.least("id_p", "id_q").alias("b"))
    tried = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if not crowd.isEmpty():
        open_ = open_.unionByName(crowded_pairs(crowd, texts.join(small(crowd.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi"), words)).distinct()
    more = cut(confirm(cut(open_.join(tried, ["a", "b"], "left_anti")), texts, percent, words))
    if not more.isEmpty():
        known = components(links.unionByName(more))

    of_class = classes.select("set_key", "id").join(known, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
