"""Exact deduplication by a 128-bit content hash, confirmed on the bytes.

Two texts are equal when they are identical after every character of
`[\\x20\\x09-\\x0D]` is deleted. The key of a group is the 128-bit MD5 of what is
left. Groups are counted over hashes alone, with map-side combining, so a hash
that a third of all rows share costs one row per task. Only members of groups
of two or more carry their text further; there the bytes themselves are the
grouping key, which splits any group that a hash collision made.

Defined cases: a null text counts as empty, and all empty texts form one group;
a null id sorts behind all others; repeated rows of one id all count in
`group_size` and share their fate; an empty table gives an empty result;
columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, small

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text):
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def _best():
    """Most code points first, then the smallest id."""
    return F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("z"), "doc_id"))["doc_id"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    hash_of: Column -> Column, the content hash; 128-bit MD5 unless a test needs collisions.
    """
    hash_of = hash_of or (lambda c: F.unhex(F.md5(c)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("h", hash_of(F.col("norm").cast("binary")))

    copies = cut(rows.groupBy("h").agg(F.count("*").alias("group_size"), _best().alias("keep_id")).where("group_size > 1"))
    shared = F.col("group_size").isNotNull()
    flagged = cut(
        rows.withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
        .join(small(copies), "h", "left")
        .select("doc_id", "n", "h", "sha", "group_size", "keep_id", F.when(shared, F.col("norm")).alias("norm"))
    )
    # Grouping by the bytes compares them; copies are combined before the shuffle.
    collided = flagged.where(shared).groupBy("h", "norm").agg(F.count("*").alias("c")).groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")
    collided = cut(collided)
    if not collided.isEmpty():
        apart = flagged.where(shared).join(collided, "h", "left_semi")
        by_bytes = apart.groupBy("h", "norm").agg(F.count("*").alias("group_size"), _best().alias("keep_id"))
        flagged = flagged.join(collided, "h", "left_anti").unionByName(apart.drop("group_size", "keep_id").join(by_bytes, ["h", "norm"]))
    return flagged.select(
        "doc_id",
        F.when(shared, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(shared, F.col("keep_id").eqNullSafe(F.col("doc_id"))).otherwise(F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
