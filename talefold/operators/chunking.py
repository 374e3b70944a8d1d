"""Chunks of consecutive segments, their context, hashes and reuse."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest
from .ranges import in_ranges

CHUNKED = "recording_id long, seg_idx int, chunk_no int"


def fold(rows: DataFrame, start: Callable[[], Callable[[tuple], bool]], columns: list[str], order: str = "seg_idx", out: str = CHUNKED, carry: str | None = None) -> DataFrame:
    """Numbers groups of consecutive rows of each recording; `carry` names one of the columns that the result keeps.

    start() gives a rule that is told each row's columns and says whether a new group
    begins with it. Rows are dealt once by recording and stream through in order, so
    memory does not grow with a recording's length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, rule, number = None, None, 0
        for batch in batches:
            numbers = []
            for rec, *values in zip(batch["recording_id"].tolist(), *(batch[c].tolist() for c in columns), strict=True):
                if rule is None or rec != current:
                    current, rule, number = rec, start(), 0
                number += rule(values)
                numbers.append(number)
            more = {carry: batch[carry]} if carry else {}
            yield pd.DataFrame({"recording_id": batch["recording_id"], order: batch[order], out.split()[-2]: numbers} | more)

    dealt = rows.select("recording_id", order, *(c for c in columns if c != order)).repartition("recording_id").sortWithinPartitions("recording_id", order)
    return dealt.mapInPandas(run, f"{out}, {carry} int" if carry else out)


def correction_rule(target: int, longest_ms: int, most: int) -> Callable:
    """Stops before a segment once the target is reached, the time is up or the chunk has its segments."""

    def start() -> Callable:
        chars = count = first = 0

        def rule(values: list) -> bool:
            nonlocal chars, count, first
            size, begin, end = values
            new = count > 0 and (chars >= target or end - first >= longest_ms or count >= most)
            if new:
                chars = count = 0
            if not count:
                first = begin
            chars, count = chars + size + 1, count + 1
            return new or count == 1

        return rule

    return start


def size_rule(target: int, gap: int) -> Callable:
    """Stops before a row that would lift the size, with a gap between rows, over the target; the first always fits."""

    def start() -> Callable:
        size = count = 0

        def rule(values: list) -> bool:
            nonlocal size, count
            more = size + values[0] + (gap if size else 0)
            new = count == 0 or more > target
            size, count = (values[0] if new else more), (1 if new else count + 1)
            return new

        return rule

    return start


def correction_chunks(segments: DataFrame, target: int = 1200, longest_ms: int = 60_000, most: int = 35) -> DataFrame:
    rows = segments.withColumn("chars", F.length("text"))
    return fold(rows, correction_rule(target, longest_ms, most), ["chars", "start_ms", "end_ms"])


def semantic_chunks(segments: DataFrame, target: int = 6000, hard_max: int = 8000, sized: bool = False) -> DataFrame:
    """Chunks for extraction; a single segment may pass the target, and is reported by `manifest` if it passes hard_max.

    sized: with the characters of each segment, which saves `manifest` a join.
    """
    if target > hard_max:
        raise ValueError("target is over hard_max")
    return fold(segments.withColumn("chars", F.length("text")), size_rule(target, 1), ["chars"], carry="chars" if sized else None)


def pack_groups(sized: DataFrame, limit: int = 24_000) -> DataFrame:
    """group_no of rows(recording_id, chunk_no, size), packed in order up to the limit."""
    return fold(sized, size_rule(limit, 0), ["size"], "chunk_no", "recording_id long, chunk_no int, group_no int")


def manifest(segments: DataFrame, chunked: DataFrame, hard_max: int = 8000, ids: bool = False) -> DataFrame:
    """recording_id, chunk_no, p_start, p_end, n_segments, chars, too_long; with ids also segment_ids in order."""
    rows = chunked if "chars" in chunked.columns else chunked.join(segments.select("recording_id", "seg_idx", F.length("text").alias("chars")), ["recording_id", "seg_idx"])
    chars = F.sum("chars")
    return rows.groupBy("recording_id", "chunk_no").agg(F.min("seg_idx").alias("p_start"), F.max("seg_idx").alias("p_end"), F.count("*").alias("n_segments"), chars.alias("chars"), (chars > hard_max).alias("too_long"), *([F.array_sort(F.collect_list("seg_idx")).alias("segment_ids")] if ids else []))


def overlap(plan: DataFrame, segments: DataFrame, reach: int = 2, dense: bool = True) -> DataFrame:
    """recording_id, chunk_no, seg_idx, is_primary, text: a chunk's segments and `reach` on both sides.

    The range is spread out and joined by equality, so no chunk meets all segments. Where
    indices have gaps, dense=False counts `reach` in segments, not in indices.
    """
    if not dense:
        place = F.row_number().over(Window.partitionBy("recording_id").orderBy("seg_idx")) - 1
        placed = segments.select("recording_id", "seg_idx", place.alias("at"), "text")
        ends = placed.select("recording_id", F.col("seg_idx").alias("p_start"), F.col("at").alias("a")), placed.select("recording_id", F.col("seg_idx").alias("p_end"), F.col("at").alias("b"))
        by_place = plan.join(ends[0], ["recording_id", "p_start"]).join(ends[1], ["recording_id", "p_end"]).select("recording_id", "chunk_no", F.col("a").alias("p_start"), F.col("b").alias("p_end"))
        found = overlap(by_place, placed.select("recording_id", F.col("at").alias("seg_idx"), "text"), reach).withColumnRenamed("seg_idx", "at").drop("text")
        return found.join(placed, ["recording_id", "at"]).select("recording_id", "chunk_no", "seg_idx", "is_primary", "text")
    spread = plan.select("recording_id", "chunk_no", "p_start", "p_end", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p_start") - reach), F.col("p_end") + reach)).alias("seg_idx"))
    both = spread.join(segments.select("recording_id", "seg_idx", "text"), ["recording_id", "seg_idx"])
    return both.select("recording_id", "chunk_no", "seg_idx", F.col("seg_idx").between(F.col("p_start"), F.col("p_end")).alias("is_primary"), "text")


def chunk_hashes(covered: DataFrame, settings: str = "") -> DataFrame:
    """recording_id, chunk_no, input_hash over own and neighbouring texts and the settings."""
    parts = F.array_sort(F.collect_list(F.struct("seg_idx", "is_primary", "text")))
    told = F.array_join(F.transform(parts, lambda x: F.concat_ws("\x1e", x["seg_idx"].cast("string"), F.when(x["is_primary"], "p").otherwise("o"), x["text"])), "\x1d")
    return covered.groupBy("recording_id", "chunk_no").agg(digest(told, F.lit(settings)).alias("input_hash"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """recording_id, chunk_no, verdict: same, changed, new or gone."""
    o, n = (d.select("recording_id", "chunk_no", F.col("input_hash").alias(c)) for d, c in ((old, "o"), (new, "n")))
    verdict = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "gone").when(F.col("o") == F.col("n"), "same").otherwise("changed")
    return o.join(n, ["recording_id", "chunk_no"], "full").select("recording_id", "chunk_no", verdict.alias("verdict"))


def run_plan(hashes: DataFrame, state: DataFrame, now_ms: int, patience_ms: int = 900_000, most: int = 3) -> DataFrame:
    """recording_id, chunk_no, action for chunks with state(status, attempts, input_hash, output_hash, started_ms).

    The first reason against reuse counts; a chunk in work is left alone until its time is up.
    """
    s = state.withColumnRenamed("input_hash", "known_hash")
    rows = hashes.join(s, ["recording_id", "chunk_no"], "left")
    whole = (F.col("status") == "completed") & F.col("output_hash").isNotNull() & (F.col("known_hash") == F.col("input_hash"))
    working = (F.col("status") == "processing") & (F.lit(now_ms) - F.col("started_ms") <= patience_ms)
    action = F.when(whole, "reuse").when(working, "wait").when(F.coalesce("attempts", F.lit(0)) >= most, "failed").otherwise("execute")
    return rows.select("recording_id", "chunk_no", action.alias("action"))


def reuse_verdicts(chunks: DataFrame, state: DataFrame, outputs: DataFrame, faulty: DataFrame) -> DataFrame:
    """recording_id, chunk_no, reason: 'reusable', or the first reason against it in fixed order.

    chunks(recording_id, chunk_no, input_hash), state(..., status, known_hash, output_hash),
    outputs(..., parses, told_chunk, told_hash, actual_hash), faulty(recording_id, chunk_no) with findings.
    """
    by = ["recording_id", "chunk_no"]
    bad = faulty.select(*by).distinct().withColumn("bad", F.lit(True))
    rows = chunks.join(state, by, "left").join(outputs.withColumn("there", F.lit(True)), by, "left").join(bad, by, "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    reasons = [
        (differs("status", "done"), "not_completed"),
        (F.col("there").isNull(), "output_missing"),
        (differs("known_hash", "input_hash"), "input_changed"),
        (~F.coalesce("parses", F.lit(False)), "output_invalid"),
        (differs("told_chunk", "chunk_no"), "chunk_mismatch"),
        (differs("told_hash", "known_hash"), "output_of_other_input"),
        (differs("output_hash", "actual_hash"), "output_changed"),
        (F.coalesce("bad", F.lit(False)), "provenance"),
    ]
    out = F.lit("reusable")
    for holds, name in reversed(reasons):
        out = F.when(holds, name).otherwise(out)
    return rows.withColumn("done", F.lit("completed")).select(*by, out.alias("reason"))


def run_statistics(plan: DataFrame) -> DataFrame:
    """recording_id and the number of chunks of each action of a run plan."""
    names = ["reuse", "wait", "failed", "execute"]
    return plan.groupBy("recording_id").agg(*(F.count_if(F.col("action") == n).alias(f"n_{n}") for n in names), F.count("*").alias("n_chunks"))


def index_ranges(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """recording_id, chunk_no, seg_idx, text for ranges(recording_id, chunk_no, low, high) of index values; missing ones are skipped, of equal ones the last by pos wins."""
    last = segments.groupBy("recording_id", "seg_idx").agg(F.max_by("text", "pos").alias("text"))
    return in_ranges(last, ranges.select("recording_id", "chunk_no", "low", "high"), "recording_id", "seg_idx", "low", "high").select("recording_id", "chunk_no", "seg_idx", "text")


def extract_items(covered: DataFrame) -> DataFrame:
    """Items of a stand-in extractor: a topic from a chunk's first segment, key points from its first and last.

    recording_id, chunk_no, field, pos, text, source_segment_ids.
    """
    own = covered.where("is_primary").groupBy("recording_id", "chunk_no").agg(F.min(F.struct("seg_idx", "text")).alias("a"), F.max(F.struct("seg_idx", "text")).alias("b"))
    item = lambda field, pos, x, ids: F.struct(F.lit(field).alias("field"), F.lit(pos).alias("pos"), F.substring(x, 1, 60).alias("text"), F.array(*ids).alias("source_segment_ids"))
    a, b = F.col("a.seg_idx"), F.col("b.seg_idx")
    items = F.array(item("topics", 0, F.col("a.text"), [a]), item("key_points", 0, F.col("a.text"), [a]), item("key_points", 1, F.col("b.text"), [b]))
    return own.select("recording_id", "chunk_no", F.inline(items))


def map_chunks(covered: DataFrame, extractor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Any other extractor, over batches of a chunk table."""
    return covered.mapInPandas(extractor, schema)
