"""Terms of recordings and of the whole collection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Words that are never keywords; a neutral list.
STOP = "the and for that this with from are was der die und das von mit les des est une que los las del por".split()


def tokens(rows: DataFrame, key: str, pattern: str = TOKEN) -> DataFrame:
    """key, pos, surface for every token of rows(key, seg_idx, text), in reading order."""
    found = rows.select(key, "seg_idx", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("at", "surface"))
    return found.select(key, (F.col("seg_idx").cast("long") * 1_000_000 + F.col("at")).alias("pos"), "surface")


def top_terms(rows: DataFrame, key: str, k: int = 8, fold: bool = True, stop: Iterable[str] = STOP, pattern: str = TOKEN) -> DataFrame:
    """key, rank, term, n: the k most frequent terms, ties in code point order; shown as first seen."""
    each = tokens(rows, key, pattern).withColumn("term", F.lower("surface") if fold else F.col("surface")).where(~F.col("term").isin(list(stop)))
    counted = each.groupBy(key, "term").agg(F.count("*").alias("n"), F.min_by("surface", "pos").alias("surface"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "term"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", F.col("surface").alias("term"), "n")


def collection_terms(rows: DataFrame, key: str, k: int = 100, stop: Iterable[str] = STOP) -> DataFrame:
    """term, n, n_recordings of the k most frequent terms; counted per recording first, so frequent ones combine early."""
    each = tokens(rows, key).select(key, F.col("surface").alias("term")).where(~F.col("term").isin(list(stop)))
    counted = each.groupBy(key, "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_recordings"))
    return counted.orderBy(F.desc("n"), "term").limit(k)


def memo(terms: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, topic, core, flow from top terms(doc_id, rank, term) and sentences(doc_id, pos, sentence)."""
    topic = terms.where("rank <= 3").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " · ").alias("topic"))
    first = found.where("pos < 4").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]).alias("s"))
    said = first.select("doc_id", F.substring(F.array_join(F.slice("s", 1, 3), " "), 1, 180).alias("core"), F.array_join(F.transform("s", lambda x: F.substring(x, 1, 90)), " / ").alias("flow"))
    return said.join(topic, "doc_id", "left").select("doc_id", F.coalesce("topic", F.lit("")).alias("topic"), "core", "flow")
