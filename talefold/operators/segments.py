"""Segment tables: recording_id, seg_idx, speaker, start_ms, end_ms, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled, squeeze, strip

STEP_MS, SPOKEN_MS = 2400, 1800
NO_RESULT = "(no speech recognised)"


def from_turns(turns: DataFrame) -> DataFrame:
    """Segments of conversations, at fixed intervals."""
    return turns.select(
        F.col("conv_id").alias("recording_id"),
        F.col("turn").cast("int").alias("seg_idx"),
        F.col("role").alias("speaker"),
        (F.col("turn") * STEP_MS).alias("start_ms"),
        (F.col("turn") * STEP_MS + SPOKEN_MS).alias("end_ms"),
        first_filled(F.col("text")).alias("text"),
    )


def lines_of(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")


def from_lines(docs: DataFrame) -> DataFrame:
    """Segments of documents: their lines that are not blank, densely numbered."""
    return docs.select(F.col("doc_id").alias("recording_id"), F.posexplode(lines_of(F.col("text"))).alias("seg_idx", "text")).select(
        "recording_id", "seg_idx", F.lit("S1").alias("speaker"), (F.col("seg_idx").cast("long") * STEP_MS).alias("start_ms"), (F.col("seg_idx").cast("long") * STEP_MS + SPOKEN_MS).alias("end_ms"), "text"
    )


def from_recogniser(raw: DataFrame, dense: bool = True, offsets_ms: bool = False) -> DataFrame:
    """Segments of speech recognition results.

    raw(recording_id, transcription, segments): arrays of text, start, end, offsets(from, to).
    `transcription` is taken if present, else `segments`. Times come from start and end
    or from the offsets; whole numbers above 1000 are milliseconds, or all whole numbers
    with offsets_ms. Blank texts are dropped and the rest is numbered densely, or keeps its places.
    """
    rows = raw.select("recording_id", F.posexplode(F.coalesce("transcription", "segments")).alias("pos", "s"))

    def ms(direct: Column, offset: Column) -> Column:
        from_offset = F.when(F.lit(offsets_ms) | (offset > 1000), offset).otherwise(offset * 1000)
        return F.coalesce((direct * 1000).cast("long"), from_offset.cast("long"), F.lit(0).cast("long"))

    rows = rows.select("recording_id", "pos", ms(F.col("s.start"), F.col("s.offsets.from")).alias("start_ms"), F.coalesce((F.col("s.end") * 1000).cast("long"), F.when(F.col("s.offsets.to").isNotNull(), ms(F.lit(None).cast("double"), F.col("s.offsets.to"))), ms(F.col("s.start"), F.col("s.offsets.from"))).alias("end_ms"), strip(F.col("s.text")).alias("text")).where("text <> ''")
    idx = F.row_number().over(Window.partitionBy("recording_id").orderBy("pos")) - 1 if dense else F.col("pos")
    return rows.select("recording_id", idx.cast("int").alias("seg_idx"), F.lit("S1").alias("speaker"), "start_ms", "end_ms", "text")


def transcript(segments: DataFrame) -> DataFrame:
    """recording_id, text: filled segment texts in order, one a line, else a fixed line."""
    said = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("seg_idx", "text"))))
    text = F.array_join(F.transform(said, lambda x: x["text"]), "\n")
    return segments.groupBy("recording_id").agg(F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_RESULT)).alias("text"))


def clean_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines: lines stripped, blank ones and repeats of the line before dropped."""
    kept = docs.select("doc_id", lines_of(F.col("text")).alias("l")).select("doc_id", F.expr("filter(l, (x, i) -> i = 0 OR x <> l[greatest(i - 1, 0)])").alias("l"))
    return kept.select("doc_id", F.array_join("l", "\n").alias("text"), F.size("l").cast("long").alias("n_lines"))


def even_segments(docs: DataFrame, duration_ms: Column | None = None) -> DataFrame:
    """Segments for texts without times: each line an equal step of the duration, two seconds at least."""
    lines = docs.select(F.col("doc_id").alias("recording_id"), (duration_ms if duration_ms is not None else F.lit(None)).cast("long").alias("d"), lines_of(F.col("text")).alias("l"))
    n = F.size("l").cast("long")
    step = F.when(n > 0, F.greatest(F.lit(2000).cast("long"), F.floor(F.coalesce("d", n * 8000) / n)))
    rows = lines.select("recording_id", step.alias("step"), F.posexplode("l").alias("seg_idx", "text"))
    return rows.select("recording_id", "seg_idx", (F.col("seg_idx") * F.col("step")).alias("start_ms"), ((F.col("seg_idx") + 1) * F.col("step")).alias("end_ms"), "text")


#: Fixed value: marks, and syllables of a spoken style, behind which a sentence ends.
ENDS = ".!?。요다"


def sentences(docs: DataFrame, least: int = 3, ends: str = ENDS) -> DataFrame:
    """doc_id, pos, sentence: cut after closing marks, squeezed, of at least `least` characters."""
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), rf"([{ends}])\s+", "$1\n")
    found = F.filter(F.transform(F.split(marked, "\n"), squeeze), lambda x: F.length(x) >= least)
    return docs.select("doc_id", F.posexplode(found).alias("pos", "sentence"))


def action_sentences(found: DataFrame, cues: list[str], cap: int = 6, fallback: int = 4) -> DataFrame:
    """doc_id, rank, sentence: the first `cap` sentences with a cue, else the first `fallback` of all."""
    hit = F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(F.col("low"), c))
    rows = found.withColumn("low", F.lower("sentence")).withColumn("hit", hit)
    rows = rows.withColumn("any", F.max("hit").over(Window.partitionBy("doc_id")))
    rows = rows.where(F.col("hit") | ~F.col("any")).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    return rows.where(F.col("rank") <= F.when(F.col("any"), cap).otherwise(fallback)).select("doc_id", "rank", "sentence")
