"""Chunks of recordings of any length by all tasks at once.

`chunking.fold` streams a recording through one task. Here each row gets a pointer to
the row at which a chunk that began with it would end, found by range search on running
sums, and the rows at which chunks do begin are those that pointers reach from the
first row: all known ones are followed at once, and pointers are doubled until they leave
the recording. Rows are dealt in ranges of the order, so running sums are sums inside a
range and an offset for each range; no step holds a recording in one task.

Results equal those of `fold` with the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept

#: Places whose windows are computed together, by the rule that looks at the next rows.
BLOCK = 8192


def dealt(rows: DataFrame, order: str) -> DataFrame:
    """rows in ranges `part` of recording and order, as a written table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(n, "recording_id", order).withColumn("part", F.spark_partition_id()))


def running(rows: DataFrame, order: str, **sums: Column) -> DataFrame:
    """rows(recording_id, part, ...) with the sum of each value over all rows before, in order of the recording."""
    parts = rows.groupBy("recording_id", "part").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    before = Window.partitionBy("recording_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("recording_id", "part", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in sums))
    here = Window.partitionBy("recording_id", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("*", *(F.coalesce(F.sum(v).over(here), F.lit(0)).alias(k) for k, v in sums.items()))
    out = inside.join(offsets, ["recording_id", "part"])
    return out.select(*rows.columns, *((F.col(k) + F.col(f"{k}_before")).cast("long").alias(k) for k in sums))


def _filled(placed: DataFrame) -> DataFrame:
    """placed with `filled_q`: the running sum before the next row that has a size, this one included."""
    # Frames that look back over a falling order, as those that look ahead to the end are computed anew for each row.
    has = F.when(F.col("size") > 0, F.col("q"))
    behind = Window.partitionBy("recording_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("recording_id", "part").agg(F.min(has).alias("first_q"))
    later = firsts.select("recording_id", "part", F.last("first_q", True).over(behind).alias("later_q"))
    here = Window.partitionBy("recording_id", "part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("here_q", F.last(has, True).over(here)).join(later, ["recording_id", "part"]).withColumn("filled_q", F.coalesce("here_q", "later_q")).drop("here_q", "later_q")


def size_pointers(placed: DataFrame, target: int, gap: int) -> DataFrame:
    """recording_id, at, next: the first row that would lift the size over the target; the first row of a chunk always fits.

    Rows and bounds meet in bins of the running sum. A bin is at least as wide as a row is large,
    so what a bound doesn't find in its own bin is the first row of the next one.
    """
    filled = _filled(placed)
    width = (placed.agg(F.max("size")).first()[0] or 0) + target + gap + 1
    rows = filled.select("recording_id", "at", (F.col("q") + F.col("size") + gap).alias("value"), F.lit(0).alias("bound"))
    bounds = filled.where("filled_q IS NOT NULL").select("recording_id", "at", (F.col("filled_q") + target + gap).alias("value"), F.lit(1).alias("bound"))
    both = rows.unionByName(bounds).withColumn("bin", F.floor(F.col("value") / width))
    beyond = Window.partitionBy("recording_id", "bin").orderBy(F.desc("value"), F.desc("bound"), F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    row = F.when(F.col("bound") == 0, F.col("at"))
    found = both.withColumn("next", F.last(row, True).over(beyond)).where("bound = 1")
    firsts = rows.groupBy("recording_id", (F.floor(F.col("value") / width) - 1).alias("bin")).agg(F.min("at").alias("first"))
    met = found.join(firsts, ["recording_id", "bin"], "left")
    return met.select("recording_id", "at", F.greatest(F.col("at") + 1, F.coalesce("next", "first")).alias("next"), F.coalesce("next", "first").alias("known")).where("known IS NOT NULL").drop("known")


def correction_pointers(placed: DataFrame, target: int, longest_ms: int, most: int) -> DataFrame:
    """recording_id, at, next: the first row before which the target is reached, the time is up or the chunk has its rows.

    A chunk has at most `most` rows, so a row looks at as many behind it; blocks overlap by these.
    """
    block = F.floor(F.col("at") / BLOCK)
    reach = -(-most // BLOCK)
    blocks = F.array_distinct(F.array(block, *(F.floor((F.col("at") - F.least(F.lit(most), F.lit(BLOCK) * k)) / BLOCK) for k in range(1, reach + 1))))
    spread = placed.select("recording_id", "at", "q", "start_ms", "end_ms", F.explode(blocks).alias("block")).where("block >= 0")
    ahead = Window.partitionBy("recording_id", "block").orderBy("at").rowsBetween(1, most)
    seen = spread.withColumn("ahead", F.collect_list(F.struct("at", "q", "end_ms")).over(ahead)).where(F.col("block") == block)
    stops = F.filter("ahead", lambda x: (x["q"] - F.col("q") >= target) | (x["end_ms"] - F.col("start_ms") >= longest_ms) | (x["at"] - F.col("at") >= most))
    return seen.select("recording_id", "at", F.get(stops, F.lit(0))["at"].alias("next")).where("next IS NOT NULL")


def reached(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """recording_id, at of starts and of all rows that pointers(recording_id, at, next) reach from them.

    Each round goes on from all rows reached so far by as many steps as these are, and doubles the steps.
    """
    seen, jump = kept(starts), kept(pointers)
    while not jump.isEmpty():
        seen = kept(seen.unionByName(seen.join(jump, ["recording_id", "at"]).select("recording_id", F.col("next").alias("at"))))
        on = jump.select("recording_id", F.col("at").alias("next"), F.col("next").alias("then"))
        jump = kept(jump.join(on, ["recording_id", "next"]).select("recording_id", "at", F.col("then").alias("next")))
    return seen


def numbered(placed: DataFrame, pointers: DataFrame, order: str, out: str) -> DataFrame:
    """recording_id, order, number of the chunk that each row is in."""
    starts = reached(pointers, placed.where("at = 0").select("recording_id", "at"))
    marked = placed.join(starts.withColumn("start", F.lit(1)), ["recording_id", "at"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    count = running(marked.select("recording_id", order, "part", "start"), order, before=F.col("start"))
    return count.select("recording_id", order, (F.col("before") + F.col("start")).cast("int").alias(out))


def size_chunks(rows: DataFrame, target: int, gap: int, order: str = "seg_idx", out: str = "chunk_no") -> DataFrame:
    """As `fold` with `size_rule(target, gap)` over rows(recording_id, order, size); order is unique in a recording."""
    placed = kept(running(dealt(rows.select("recording_id", order, F.col("size").cast("long").alias("size")), order), order, at=F.lit(1), q=F.col("size") + gap))
    return numbered(placed, size_pointers(placed, target, gap), order, out)


def semantic_chunks(segments: DataFrame, target: int = 6000) -> DataFrame:
    """As `chunking.semantic_chunks`."""
    return size_chunks(segments.withColumn("size", F.length("text")), target, 1)


def pack_groups(sized: DataFrame, limit: int = 24_000) -> DataFrame:
    """As `chunking.pack_groups`."""
    return size_chunks(sized, limit, 0, "chunk_no", "group_no")


def correction_chunks(segments: DataFrame, target: int = 1200, longest_ms: int = 60_000, most: int = 35) -> DataFrame:
    """As `chunking.correction_chunks`."""
    rows = segments.select("recording_id", "seg_idx", "start_ms", "end_ms", (F.length("text") + 1).cast("long").alias("size"))
    placed = kept(running(dealt(rows, "seg_idx"), "seg_idx", at=F.lit(1), q=F.col("size")))
    return numbered(placed, correction_pointers(placed, target, longest_ms, most), "seg_idx", "chunk_no")


def joined(segments: DataFrame, by: Column) -> DataFrame:
    """recording_id, seg_idx, text: the segments of one recording per value of `by`, numbered through in order by all tasks."""
    rows = segments.select(by.alias("recording_id"), F.struct("recording_id", "seg_idx").alias("order"), "text")
    return running(dealt(rows, "order"), "order", seg_idx=F.lit(1)).select("recording_id", F.col("seg_idx").cast("int").alias("seg_idx"), "text")
