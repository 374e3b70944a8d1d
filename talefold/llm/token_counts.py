"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

A text longer than a chunk and its overlap is cut into chunks that begin every `step`
code points and reach `overlap` beyond the next begin. Chunks are rows of their own,
dealt over all tasks. The library encodes each with offsets, and the counts are
spliced where two neighbours agree on a boundary between words (the pieces that the
tokenizer's pattern cuts before any merge).

Why such a boundary is stable: words are cut from left to right, each cut depends on
where the word begins and on what follows, never on what lies before; merges stay in
a word, and the special strings are found from left to right as well. The pattern
looks at most two code points beyond a word, so a word of the left chunk that ends
`margin` (the longest special string, and two) or more before the chunk's end is a word
of the whole text, if the chunk's words are the text's from some place before. Where
both chunks have a boundary at one place, the right chunk's words are the text's from
there on. The first chunk begins with the text, and so on by induction.

Where no common boundary lies in an overlap (a word as long as the overlap, say), the two
chunks become one, so that the overlap grows over the whole next chunk, and the
grown chunk is encoded and aligned again. Rounds go on until all neighbours agree;
the last resort is one chunk, the whole text.

Defined cases: a null text is empty and has no tokens; repeated rows count as often as
they come; special strings inside texts are the library's special tokens, as its
default has it; an empty table gives an empty result; columns other than id and
text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, parts
from .tokens import Encoder

STEP, OVERLAP = 32_768, 1_024
CHUNKS = "text_key string, doc_id long, n_bytes long, k int, start long, stop long, last boolean, text string"
ENCODED = "text_key string, k int, start long, stop long, head array<int>, head_n array<long>, tail array<int>, tail_n array<long>, n long, ids array<int>"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def chunks(docs: DataFrame, step: int = STEP, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_key, doc_id, n_bytes, k, start, stop, last, text: the overlapping chunks of every row's text.

    text_key tells rows apart and is drawn anew each time, so the table has to be written once before it is read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 16):
            for doc, n_bytes, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                key, starts = uuid.uuid4().hex, range(0, max(1, len(text) - overlap), step)
                stops = [a + step + overlap for a in starts[:-1]] + [len(text)]
                for low in range(0, len(starts), 64):
                    some = range(low, min(low + 64, len(starts)))
                    rows = [(key, doc, n_bytes, k, starts[k], stops[k], k + 1 == len(starts), text[starts[k] : stops[k]]) for k in some]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    names = ["text_key", "doc_id", "n_bytes", "k", "start", "stop", "last", "text"]
    schema = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)))
    return _rows(docs, id_col, text_col).mapInArrow(run, CHUNKS)


def encoded(pieces: DataFrame, tokenizer: str, overlap: int = OVERLAP, with_ids: bool = False) -> DataFrame:
    """Each chunk's word boundaries in the overlaps at its begin and end, with the tokens before them.

    pieces: text_key, k, start, stop, text, last (whether the text ends with the chunk). Places are
    relative to the overlap: `head` to the chunk's start, `tail` to the next chunk's start.
    """
    names = ["text_key", "k", "start", "stop", "head", "head_n", "tail", "tail_n", "n", "ids"]
    numbers = pa.list_(pa.int32()), pa.list_(pa.int64())
    schema = pa.schema(list(zip(names, (pa.string(), pa.int32(), pa.int64(), pa.int64(), *numbers, *numbers, pa.int64(), numbers[0]), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Encoder(tokenizer)
        margin = max(map(len, library.special), default=0) + 2
        for part in parts(batches, 8):
            rows = []
            for row in part.to_pylist():
                got = library.slow.encode(row["text"], add_special_tokens=False)
                at, before = boundaries(got)
                next_ = row["stop"] - row["start"] - overlap
                head = at < overlap
                tail = (at >= next_) & (at <= next_ + overlap - margin) & (not row["last"])
                ids = got.ids if with_ids else None
                rows.append(dict(zip(names, (row["text_key"], row["k"], row["start"], row["stop"], at[head], before[head], at[tail] - next_, before[tail], len(got), ids), strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pieces.select("text_key", "k", "start", "stop", "text", "last").mapInArrow(run, ENCODED)


def boundaries(encoding) -> tuple[np.ndarray, np.ndarray]:
    """Where the library's words begin, in code points, and the number of tokens before each."""
    if not len(encoding):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    word = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (word[1:] < 0)))
    offsets = np.array(encoding.offsets, np.int64)
    return offsets[first, 0], first


def aligned(table: DataFrame) -> DataFrame:
    """encoded rows with `begin`, `begin_n`: the first common boundary with the chunk before, relative to the
    chunk's start, and the tokens of the chunk before it; null where there is none. `end_n`: tokens up to the next chunk's begin."""
    in_order = Window.partitionBy("text_key").orderBy("start")
    first = F.lag("start").over(in_order).isNull()
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(in_order)))
    rows = table.withColumn("begin", F.when(first, F.lit(0)).otherwise(common))
    place = lambda array, n, p: F.try_element_at(F.col(n), F.array_position(array, p).cast("int"))
    rows = rows.withColumn("begin_n", F.when(F.col("begin").isNotNull(), F.when(first, F.lit(0)).otherwise(place("head", "head_n", F.col("begin")))))
    following = F.lead("begin").over(in_order)
    last = F.lead("start").over(in_order).isNull()
    return rows.withColumn("end_n", F.when(last, F.col("n")).when(following.isNotNull(), place("tail", "tail_n", following)))


def grown(table: DataFrame) -> DataFrame:
    """text_key, k, start, stop of the chunks that take in all following ones that they don't agree with."""
    in_order = Window.partitionBy("text_key").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = table.withColumn("run", F.sum(F.col("begin").isNotNull().cast("int")).over(in_order))
    merged = runs.groupBy("text_key", "run").agg(F.min("k").alias("k"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("c"))
    return merged.where("c > 1").drop("run", "c")


def _texts(grown_: DataFrame, written: DataFrame) -> DataFrame:
    """The grown chunks with their texts, put together from the chunks as first cut."""
    within = (F.col("g.text_key") == F.col("w.text_key")) & (F.col("w.start") >= F.col("g.start")) & (F.col("w.stop") <= F.col("g.stop"))
    met = grown_.alias("g").join(written.alias("w"), within).select("g.text_key", "g.k", "g.start", "g.stop", F.col("w.start").alias("at"), F.col("w.last").alias("ends"), F.col("w.text").alias("part"))
    following = F.lead("at").over(Window.partitionBy("text_key", "start").orderBy("at"))
    own = F.when(following.isNull(), F.col("part")).otherwise(F.substring("part", F.lit(1), (following - F.col("at")).cast("int")))
    whole = met.withColumn("own", own).groupBy("text_key", "k", "start", "stop").agg(F.array_sort(F.collect_list(F.struct("at", "own"))).alias("owns"), F.max("ends").alias("last"))
    return whole.select("text_key", "k", "start", "stop", F.array_join(F.transform("owns", lambda x: x["own"]), "").alias("text"), "last")


def spliced(written: DataFrame, tokenizer: str, overlap: int = OVERLAP, with_ids: bool = False) -> DataFrame:
    """text_key, k, begin, n_tokens (and ids): what each chunk of the written chunks adds to its text, in order of begin."""
    table = cut(encoded(written.repartition("text_key", "k"), tokenizer, overlap, with_ids))
    while True:
        rows = cut(aligned(table))
        if rows.where("begin IS NULL").isEmpty():
            break
        wider = cut(grown(rows))
        again = encoded(_texts(wider, written).repartition("text_key", "k"), tokenizer, overlap, with_ids)
        table = cut(_outside(rows, wider).unionByName(again))
    adds = rows.select("text_key", "k", (F.col("start") + F.col("begin")).alias("begin"), (F.col("end_n") - F.col("begin_n")).alias("n_tokens"), "begin_n", "ids")
    ids = F.slice("ids", (F.col("begin_n") + 1).cast("int"), F.col("n_tokens").cast("int"))
    return adds.select("text_key", "k", "begin", "n_tokens", *([ids.alias("ids")] if with_ids else []))


def _outside(rows: DataFrame, wider: DataFrame) -> DataFrame:
    """The encoded rows that no grown chunk takes in; its last chunk ends where it ends."""
    spans = wider.select(F.col("text_key").alias("key"), F.col("start").alias("from"), F.col("stop").alias("to"))
    inside = (F.col("text_key") == F.col("key")) & (F.col("start") >= F.col("from")) & (F.col("stop") <= F.col("to"))
    return rows.join(spans, inside, "left_anti").drop("begin", "begin_n", "end_n")


def token_counts(docs: DataFrame, tokenizer: str, ranks: str | None = None, step: int = STEP, overlap: int = OVERLAP, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    tokenizer, ranks: the files that Encoder takes; texts that fit one chunk are counted as they are read.
    """
    rows = _rows(docs, id_col, text_col)
    fits = F.length("text") <= step + overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks)
        for part in parts(batches):
            n = [len(ids) for ids in encoder.ids(part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    short = rows.where(fits).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    written = cut(chunks(rows.where(~fits), step, overlap))
    counts = spliced(written, tokenizer, overlap).groupBy("text_key").agg(F.sum("n_tokens").cast("long").alias("n_tokens"))
    long_ = written.where("k = 0").select("text_key", "doc_id", "n_bytes").join(counts, "text_key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long_).select("*", (F.col("n_tokens") > limit).alias("over_limit"))
