"""Merging extracted items into one note per recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key, squeeze

#: How many items of each field a merge keeps.
CAPS = {"topics": 20, "key_points": 40, "decisions": 30, "action_items": 30, "questions": 30}
NO_ID = 1_000_000_000


def union_items(items: DataFrame, *by: str) -> DataFrame:
    """*by, field, rank, text, source_segment_ids of items that agree in all but case and blanks.

    The first seen text stays, ids are united, and items stand by their first id, then text.
    """
    keyed = items.withColumn("key", norm_key(F.col("text"))).where("key <> ''")
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_segment_ids"))))
    merged = keyed.groupBy(*by, "field", "key").agg(F.min_by("text", F.struct("chunk_no", "pos")).alias("text"), ids.alias("source_segment_ids"))
    first = F.coalesce(F.get("source_segment_ids", F.lit(0)), F.lit(NO_ID))
    rank = F.row_number().over(Window.partitionBy(*by, "field").orderBy(first, "text"))
    return merged.withColumn("rank", rank).select(*by, "field", "rank", "text", "source_segment_ids")


def capped(merged: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("field"))
    return merged.where(F.col("rank") <= cap)


def merge_summaries(summaries: DataFrame, first: int = 6, none: str = "(no summary)") -> DataFrame:
    """recording_id, summary, warnings of summaries(recording_id, chunk_no, summary, warning)."""
    filled = F.when(squeeze(F.col("summary")) != "", F.struct("chunk_no", "summary"))
    text = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(filled)), 1, first), lambda x: x["summary"]), " / ")
    return summaries.groupBy("recording_id").agg(F.coalesce(F.nullif(text, F.lit("")), F.lit(none)).alias("summary"), F.array_sort(F.collect_set("warning")).alias("warnings"))


def sizes(items: DataFrame) -> DataFrame:
    """recording_id, chunk_no, size: additive, so no prefix is measured twice."""
    return items.groupBy("recording_id", "chunk_no").agg(F.sum(F.length("text") + 1).alias("size"))


def mode(sized: DataFrame, direct: int = 12_000) -> DataFrame:
    """recording_id, size, mode: one merge if the whole fits, else two levels."""
    return sized.groupBy("recording_id").agg((F.sum("size") + 1).alias("size")).withColumn("mode", F.when(F.col("size") <= direct, "direct").otherwise("group"))


def two_levels(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Merged items per recording by way of groups(recording_id, chunk_no, group_no)."""
    inner = capped(union_items(items.join(groups, ["recording_id", "chunk_no"]), "recording_id", "group_no"))
    return capped(union_items(inner.withColumnRenamed("group_no", "chunk_no").withColumnRenamed("rank", "pos"), "recording_id"))


def matched_rules(texts: DataFrame, rules: list[tuple[int, str, list[str]]]) -> DataFrame:
    """recording_id, label of the first rule (priority, label, cues) with a cue in the text."""
    label = F.lit(None).cast("string")
    for _, name, cues in sorted(rules, reverse=True):
        hit = F.lit(False)
        for c in cues:
            hit = hit | F.contains(F.lower("text"), F.lit(c))
        label = F.when(hit, F.lit(name)).otherwise(label)
    return texts.select("recording_id", label.alias("label"))


def sections(merged: DataFrame, rules: dict[str, tuple[list[str], int]]) -> DataFrame:
    """recording_id, section, rank, text: items with a section's cue (an item may be in several), capped."""
    found = [merged.where(_has(F.col("text"), cues)).select("recording_id", F.lit(name).alias("section"), F.lit(cap).alias("cap"), "field", "rank", "text") for name, (cues, cap) in rules.items()]
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    place = F.row_number().over(Window.partitionBy("recording_id", "section").orderBy("field", "rank"))
    return rows.withColumn("place", place).where("place <= cap").select("recording_id", "section", F.col("place").alias("rank"), "text")


def _has(text: Column, cues: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(F.lower(text), c))


def render(merged: DataFrame) -> DataFrame:
    """recording_id, markdown: a heading per field with its items."""
    lines = merged.groupBy("recording_id", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("list"))
    part = F.concat(F.lit("## "), F.col("field"), F.lit("\n"), F.col("list"))
    return lines.groupBy("recording_id").agg(F.array_join(F.array_sort(F.collect_list(part)), "\n\n").alias("markdown"))
