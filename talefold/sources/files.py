"""Files by their content: sizes and digests, and whether copies agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import verify_archive


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path (below the folder), size, md5, sha256 of the files in a folder and below; each file is a row, read in one task.

    Spark's reader passes over files without content, and takes none over 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    root = F.lit(path.split("://")[-1].rstrip("/") + "/")
    below = F.expr("substring(path, instr(path, root) + length(root))")
    return files.withColumn("root", root).select(below.alias("path"), F.col("length").alias("size"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def copies(local: DataFrame, remote: DataFrame) -> DataFrame:
    """path, verdict of local files against a remote inventory, both (path, size, md5): size first, then checksum."""
    named = [d.select(F.col("path").alias("recording_id"), "size", "md5") for d in (local, remote)]
    return verify_archive(*named).withColumnRenamed("recording_id", "path")


def unlisted(local: DataFrame, remote: DataFrame) -> DataFrame:
    """path, size, md5 of remote files that no local file has the content of."""
    return remote.join(local.select("size", "md5"), ["size", "md5"], "left_anti").select("path", "size", "md5")
