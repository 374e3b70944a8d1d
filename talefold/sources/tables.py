"""Readers and writers of recording data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECOGNISED = (
    "transcription array<struct<text:string,start:double,end:double,offsets:struct<from:long,to:long>>>,"
    " segments array<struct<text:string,start:double,end:double,offsets:struct<from:long,to:long>>>"
)


def recogniser_json(spark: SparkSession, path: str) -> DataFrame:
    """recording_id (the folder's name), transcription, segments of speech recognition files; unreadable files give nulls."""
    rows = spark.read.schema(RECOGNISED).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("recording_id"), "transcription", "segments")


def catalog(spark: SparkSession, path: str, schema: str = "title string, recorded_at string, duration_sec double") -> DataFrame:
    """One row per folder with a metadata file; hidden and trash folders are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return rows.select(folder.alias("recording_id"), "*").where("recording_id NOT LIKE '.%' AND recording_id <> 'trash'")


def flat_files(paths: DataFrame) -> DataFrame:
    """prefix and the roles of files named <prefix>_<role>.<kind>, from paths(path)."""
    name = F.substring_index("path", "/", -1)
    rows = paths.select(F.regexp_extract(name, r"^(.+?)_(raw|clean|summary|analysis)\.[^.]+$", 1).alias("prefix"), F.regexp_extract(name, r"^(.+?)_(raw|clean|summary|analysis)\.[^.]+$", 2).alias("role"))
    return rows.where("prefix <> ''").groupBy("prefix").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def jdbc_rows(spark: SparkSession, url: str, table: str, by: str, parts: int = 32, **options: str) -> DataFrame:
    """A table of a database, read by `parts` tasks in ranges of the whole-numbered column `by`, whose bounds are asked for first.

    The bounds only deal the rows; rows outside them and those where `by` is null are read too.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    low, high = reader.load().agg(F.min(by), F.max(by)).first()  # the database works these out
    if low is None:
        return reader.load()
    return reader.option("partitionColumn", by).option("lowerBound", low).option("upperBound", high + 1).option("numPartitions", max(1, min(parts, high - low + 1))).load()


def _by_bucket(rows: DataFrame, buckets: int):
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("recording_id"), F.lit(buckets)))
    return rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")


def write_notes(notes: DataFrame, path: str, buckets: int = 64) -> None:
    """Markdown per recording as Parquet, partitioned by a hash of the id; a partition is replaced as a whole."""
    _by_bucket(notes, buckets).parquet(path)


def write_json(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """One JSON object per recording and line, in the same partitions."""
    _by_bucket(rows, buckets).json(path)


def write_text(transcripts: DataFrame, path: str, buckets: int = 64) -> None:
    """Texts of transcripts(recording_id, text) behind a line with the recording's id, in the same partitions."""
    told = F.concat(F.lit("# "), F.col("recording_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = transcripts.select(told.alias("value"), F.pmod(F.xxhash64("recording_id"), F.lit(buckets)).alias("bucket"))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").text(path)
