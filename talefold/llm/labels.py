"""Labelled rows that a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = 1 << 30


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def training(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label of the rows that are not held out; one row per id, the larger label of several."""
    rows = labels.where("doc_id IS NOT NULL").where(F.col(column).isin(0, 1)).where(~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def sample(ids: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About `rows` rows of ids(doc_id, ...), or all if there are no more; chosen by a hash of the id."""
    n = ids.count()
    if n <= rows:
        return ids
    return ids.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(GRAINS)) < int(rows / n * GRAINS))
