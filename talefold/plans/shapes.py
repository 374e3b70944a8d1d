"""The given tables in the shapes of the library, and the same as SQL views for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import segments as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_turns(table(spark, sf_dir, "conversations"))


def long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_lines(table(spark, sf_dir, "documents"))


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
SHORT = f"""short_segments AS (
  SELECT conv_id AS recording_id, CAST(turn AS INTEGER) AS seg_idx, role AS speaker, turn * 2400 AS start_ms, turn * 2400 + 1800 AS end_ms,
    {STRIP.format("coalesce(text, '')")} AS text FROM conversations)"""
LINES = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '')"
LONG = f"""long_segments AS (
  SELECT doc_id AS recording_id, CAST(i - 1 AS INTEGER) AS seg_idx, 'S1' AS speaker, CAST(i - 1 AS BIGINT) * 2400 AS start_ms, CAST(i - 1 AS BIGINT) * 2400 + 1800 AS end_ms, l[i] AS text
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {LINES} AS l FROM documents)))"""
