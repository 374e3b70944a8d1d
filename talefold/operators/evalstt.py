"""Speech recognition quality over cases and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def case_hits(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """case_id, model, n_must, n_hits, misses, n_bad of cases(must, bad) against runs(text)."""
    rows = runs.join(cases, "case_id")
    misses = F.filter("must", lambda x: ~F.contains(F.col("text"), x))
    bad = F.filter("bad", lambda x: F.contains(F.col("text"), x))
    return rows.select("case_id", "model", F.size("must").cast("long").alias("n_must"), (F.size("must") - F.size(misses)).cast("long").alias("n_hits"), misses.alias("misses"), F.size(bad).cast("long").alias("n_bad"))


def report(hits: DataFrame) -> DataFrame:
    """model, n_cases, n_must, n_hits, n_bad, hit_permille; with a total row of a null model."""
    out = hits.rollup("model").agg(F.count("*").alias("n_cases"), F.sum("n_must").alias("n_must"), F.sum("n_hits").alias("n_hits"), F.sum("n_bad").alias("n_bad"))
    return out.withColumn("hit_permille", F.expr("CASE WHEN n_must > 0 THEN n_hits * 1000 DIV n_must END"))


def timed_report(hits: DataFrame, runs: DataFrame) -> DataFrame:
    """The report with the runs' seconds: runs(case_id, model, elapsed_sec and, where known, audio_sec).

    seconds, slowest_sec, and real_time_permille: seconds of work for a thousand of audio, over the runs whose audio is known.
    """
    known = F.col("audio_sec") > 0 if "audio_sec" in runs.columns else F.lit(False)
    audio = F.when(known, F.col("audio_sec")) if "audio_sec" in runs.columns else F.lit(None).cast("double")
    took = runs.rollup("model").agg(F.sum("elapsed_sec").alias("seconds"), F.max("elapsed_sec").alias("slowest_sec"), F.sum(F.when(known, F.col("elapsed_sec"))).alias("timed"), F.sum(audio).alias("audio"))
    took = took.select(F.col("model").alias("of"), "seconds", "slowest_sec", F.when(F.col("audio") > 0, F.floor(F.col("timed") * 1000 / F.col("audio"))).cast("long").alias("real_time_permille"))
    rows = report(hits)
    return rows.join(took, rows["model"].eqNullSafe(took["of"])).drop("of")


def keyword_quality(rows: DataFrame, fillers: list[str], most: int = 8) -> DataFrame:
    """recording_id, n_keywords, filler_hits, passed of rows(recording_id, keywords array): no filler and at most `most`."""
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    hits = F.filter(words, lambda k: F.coalesce(F.regexp_replace(strip(k), "^#+", "").isin(fillers), F.lit(False)))
    n = F.size(words).cast("long")
    return rows.select("recording_id", n.alias("n_keywords"), hits.alias("filler_hits"), ((F.size(hits) == 0) & (n <= most)).alias("passed"))
