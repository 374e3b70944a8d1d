"""Checks of corrected text and extracted items against their source segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE_MS = 1
#: Stands for a segment's index in what is found of a whole chunk.
WHOLE = -1
FATAL = ["count_mismatch", "duplicate", "index_mismatch", "time_moved", "text_emptied"]


def correction_findings(expected: DataFrame, output: DataFrame) -> DataFrame:
    """recording_id, chunk_no, kind, seg_idx, fatal for chunks of corrected segments.

    Both sides have recording_id, chunk_no, pos, seg_idx, start_ms, end_ms, text. A chunk
    of another length has that one finding alone.
    """
    by = ["recording_id", "chunk_no"]
    counts = expected.groupBy(*by).agg(F.count("*").alias("want")).join(output.groupBy(*by).agg(F.count("*").alias("have")), by, "left")
    counts = counts.withColumn("short", F.col("want") != F.coalesce("have", F.lit(0))).select(*by, "short")
    wrong = counts.where("short").select(*by, F.lit("count_mismatch").alias("kind"), F.lit(WHOLE).alias("seg_idx"))
    o = output.join(counts.where("NOT short"), by).select(*by, "pos", F.col("seg_idx").alias("idx"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("text").alias("t"))
    twice = o.groupBy(*by, "idx").agg(F.count("*").alias("c")).where("c > 1").select(*by, F.lit("duplicate").alias("kind"), F.col("idx").alias("seg_idx"))
    pairs = expected.join(o, [*by, "pos"])
    long_, short_ = F.length("t") > 3 * F.length("text"), F.length("t") * 5 < F.length("text")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("seg_idx") != F.col("idx"), "index_mismatch"),
            F.when((F.abs(F.col("start_ms") - F.col("s")) > TOLERANCE_MS) | (F.abs(F.col("end_ms") - F.col("e")) > TOLERANCE_MS), "time_moved"),
            F.when((F.trim("t") == "") & (F.trim("text") != ""), "text_emptied"),
            F.when((F.trim("t") != "") & (F.trim("text") != "") & (long_ | short_), "length_ratio"),
        )
    )
    each = pairs.select(*by, F.explode(kinds).alias("kind"), F.col("seg_idx"))
    return wrong.unionByName(twice).unionByName(each).withColumn("fatal", F.col("kind").isin(FATAL))


def merge_outputs(output: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments, the first by chunk order for each index; and the dropped duplicates."""
    n = F.row_number().over(Window.partitionBy("recording_id", "seg_idx").orderBy("chunk_no", "pos"))
    rows = output.withColumn("n", n)
    return rows.where("n = 1").drop("n"), rows.where("n > 1").select("recording_id", "seg_idx", "chunk_no")


def conservation(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """recording_id, n_raw, n_clean, n_missing, n_added, n_duplicates, n_emptied, n_moved, ok.

    clean comes in the order of chunk_no and pos; a segment behind one of a higher index counts as moved.
    """
    c = clean.groupBy("recording_id", "seg_idx").agg(F.count("*").alias("copies"), F.max(F.trim("text")).alias("t"))
    rows = raw.select("recording_id", "seg_idx", F.trim("text").alias("r")).join(c, ["recording_id", "seg_idx"], "full")
    n = lambda cond: F.count_if(cond)
    out = rows.groupBy("recording_id").agg(
        n(F.col("r").isNotNull()).alias("n_raw"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_clean"),
        n(F.col("copies").isNull()).alias("n_missing"),
        n(F.col("r").isNull()).alias("n_added"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicates"),
        n((F.col("r") != "") & (F.col("t") == "")).alias("n_emptied"),
    )
    before = F.lag("seg_idx").over(Window.partitionBy("recording_id").orderBy("chunk_no", "pos"))
    moved = clean.withColumn("before", before).groupBy("recording_id").agg(F.count_if(F.col("seg_idx") < F.col("before")).alias("n_moved"))
    out = out.join(moved, "recording_id", "left").withColumn("n_moved", F.coalesce("n_moved", F.lit(0)))
    return out.withColumn("ok", F.expr("n_missing + n_added + n_duplicates + n_emptied + n_moved = 0"))


def item_findings(items: DataFrame, covered: DataFrame) -> DataFrame:
    """recording_id, chunk_no, field, pos, kind: ids that are missing, unknown, or of the overlap alone."""
    none = items.where(F.size("source_segment_ids") == 0).select("recording_id", "chunk_no", "field", "pos", F.lit("no_ids").alias("kind"))
    ids = items.select("recording_id", "chunk_no", "field", "pos", F.explode("source_segment_ids").alias("seg_idx"))
    known = covered.select("recording_id", "chunk_no", "seg_idx", "is_primary")
    rows = ids.join(known, ["recording_id", "chunk_no", "seg_idx"], "left")
    kind = F.when(F.col("is_primary").isNull(), "unknown_id").when(~F.col("is_primary"), "overlap_only")
    bad = rows.select("recording_id", "chunk_no", "field", "pos", kind.alias("kind")).where("kind IS NOT NULL").distinct()
    return none.unionByName(bad)


def output_findings(expected: DataFrame, outputs: DataFrame, items: DataFrame, least_chars: int = 40) -> DataFrame:
    """recording_id, chunk_no, kind of what is wrong with a chunk's output as a whole; all of it is fatal.

    expected(recording_id, chunk_no, input_hash, chars), outputs(recording_id, chunk_no,
    told_chunk, told_hash, summary); an output without summary and items counts as
    empty if its chunk says more than least_chars characters.
    """
    by = ["recording_id", "chunk_no"]
    some = items.select(*by).distinct().withColumn("some", F.lit(True))
    rows = outputs.join(expected, by).join(some, by, "left")
    empty = (F.trim(F.coalesce("summary", F.lit(""))) == "") & F.col("some").isNull() & (F.col("chars") > least_chars)
    kinds = F.array_compact(F.array(F.when(~F.col("told_chunk").eqNullSafe(F.col("chunk_no")), "chunk_mismatch"), F.when(~F.col("told_hash").eqNullSafe(F.col("input_hash")), "hash_mismatch"), F.when(empty, "empty_output")))
    return rows.select(*by, F.explode(kinds).alias("kind"))


def provenance(items: DataFrame, segments: DataFrame, ids: int = 3, chars: int = 160) -> DataFrame:
    """recording_id, chunk_no, field, pos, sample, all_known: text of an item's first source segments."""
    by = ["recording_id", "chunk_no", "field", "pos"]
    each = items.select(*by, F.posexplode("source_segment_ids").alias("at", "seg_idx")).join(segments.select("recording_id", "seg_idx", "text"), ["recording_id", "seg_idx"], "left")
    told = F.array_sort(F.collect_list(F.when((F.col("at") < ids) & F.col("text").isNotNull(), F.struct("at", F.substring("text", 1, chars).alias("text")))))
    return each.groupBy(*by).agg(F.array_join(F.transform(told, lambda x: x["text"]), " / ").alias("sample"), F.bool_and(F.col("text").isNotNull()).alias("all_known"))


def completeness(state: DataFrame, inventory: DataFrame, required: list[str], durations: DataFrame | None = None, least_s: int = 3600) -> DataFrame:
    """recording_id, n_chunks, n_completed, n_artifacts, complete from chunk states and files(recording_id, role, bytes).

    With durations(recording_id, duration_sec), a recording has to be long enough too.
    """
    chunks = state.groupBy("recording_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("status") == "completed").alias("n_completed"))
    files = inventory.where(F.col("role").isin(required) & (F.col("bytes") > 0)).groupBy("recording_id").agg(F.count_distinct("role").alias("n_artifacts"))
    out = chunks.join(files, "recording_id", "left").withColumn("n_artifacts", F.coalesce("n_artifacts", F.lit(0).cast("long")))
    out = out.withColumn("complete", F.expr(f"n_chunks = n_completed AND n_artifacts = {len(required)}"))
    if durations is None:
        return out
    long_enough = F.coalesce(F.col("duration_sec") >= least_s, F.lit(False))
    return out.join(durations.select("recording_id", "duration_sec"), "recording_id", "left").withColumn("complete", F.col("complete") & long_enough).drop("duration_sec")
