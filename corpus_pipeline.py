"""A training-data pipeline over `documents`.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents; rows that a stage rejects are gone for
the next one.

Each stage decides on texts, not on ids: further texts of a repeated id and texts of a
null id are judged, kept and rejected by themselves, and stand behind all others where
the least id wins. Of rows of one id and one text, exact deduplication keeps one.

Other defined cases: a null text counts as empty; empty texts are judged by the quality
model like all others, and one of them at most passes exact deduplication; texts of any
length are read as a whole; further columns go through all stages but the last, whatever
their names (but for OWN and HASH below); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talefold.llm.decontaminate import contamination
from talefold.llm.exact_dedup import exact_dedup
from talefold.llm.minhash import near_duplicates
from talefold.llm.packing import pack, pieces
from talefold.llm.places import tokenizer
from talefold.llm.quality import accepted
from talefold.llm.scratch import cut, small, table


#: Columns that the stages add inside: an id of a row's id and text, and the text's hash.
OWN, HASH = "_own_id", "_text_md5"
LOW = (1 << 33) - 1


def _doubtful(docs: DataFrame) -> DataFrame:
    """The ids that do not tell rows apart: repeated ones and null."""
    return cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(HASH, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))


def _join(docs: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """docs joined null-safely on all columns that others shares with it; others may go as a bounded broadcast."""
    keys = [c for c in others.columns if c in docs.columns]
    named = small(others.withColumnsRenamed({c: f"_of_{c}" for c in keys}))
    on = F.lit(True)
    for c in keys:
        on &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return docs.join(named, on, how)


def _one_of_equals(docs: DataFrame) -> DataFrame:
    """docs with one row of each id and text."""
    doubtful = _doubtful(docs)
    if doubtful.isEmpty():
        return docs
    ids = _join(_hashed(docs.select("doc_id", "text")), doubtful, "left_semi")
    equal = cut(ids.groupBy("doc_id", HASH).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", HASH))
    one = _join(_hashed(docs), equal, "left_semi").groupBy("doc_id", HASH).agg(F.max(F.struct(*docs.columns)).alias("row"))
    return _join(_hashed(docs), equal, "left_anti").select(*docs.columns).unionByName(one.select("row.*"))


def _apart(docs: DataFrame) -> DataFrame:
    """docs with OWN, which tells its texts apart: the id, or for null and all but one text of an id a number behind all ids."""
    doubtful = _doubtful(docs)
    if doubtful.isEmpty():
        return docs.withColumn(OWN, F.col("doc_id"))
    texts = cut(_join(_hashed(docs.select("doc_id", "text")), doubtful, "left_semi").select("doc_id", HASH).distinct())
    first = texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(HASH).alias(HASH))
    further = cut(_join(texts, first, "left_anti").withColumn("at", F.monotonically_increasing_id()))
    # Numbers of all parts lie as close as the largest part lets them.
    step = F.lit((further.agg(F.max(F.col("at").bitwiseAND(LOW))).first()[0] or 0) + 1)
    behind = F.lit((docs.agg(F.max("doc_id")).first()[0] or 0) + 1)
    numbered = further.select("doc_id", HASH, (F.shiftright("at", 33) * step + F.col("at").bitwiseAND(LOW) + behind).alias("number"))
    return _join(_hashed(docs), numbered, "left").select(*docs.columns, F.coalesce("number", "doc_id").alias(OWN))


def _without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents of rows less the rejected own ids, which go to the join as a bounded broadcast or by a shuffle."""
    gone = cut(rejected.select(F.col("doc_id").alias(OWN)).distinct())
    return rows.join(small(gone), OWN, "left_anti").drop(OWN)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _apart(_one_of_equals(docs))
    return _without(rows, exact_dedup(rows, OWN).where(~F.col("kept")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _apart(docs)
    return _without(rows, near_duplicates(rows, OWN).where(~F.col("kept")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _apart(docs)
    return _without(rows, contamination(rows, table(spark, sf_dir, "benchmark"), id_col=OWN).where("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs, *tokenizer()))


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The quality model, the packing and its token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
