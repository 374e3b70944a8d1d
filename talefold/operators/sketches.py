"""Terms of a collection from mergeable states, saved by day and merged for any span of days.

A day's state has a bounded size whatever the day holds: HyperLogLog sketches of its recordings and
terms, and a frequent-items sketch of its terms. New days are added without the old texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a HyperLogLog sketch as a power of two, and the items that a frequent-items sketch tracks.
LG_K, TRACKED = 14, 10_000


def day_states(terms: DataFrame, lg_k: int = LG_K, tracked: int = TRACKED) -> DataFrame:
    """day, recordings, terms, top, n of terms(day, recording_id, term): the states of each day."""
    return terms.groupBy("day").agg(
        F.hll_sketch_agg(F.col("recording_id").cast("string"), lg_k).alias("recordings"),
        F.hll_sketch_agg("term", lg_k).alias("terms"),
        F.expr(f"approx_top_k_accumulate(term, {tracked})").alias("top"),
        F.count("*").alias("n"),
    )


def merged(states: DataFrame, by: list[Column] | None = None, tracked: int = TRACKED) -> DataFrame:
    """The states of several days as one, by other columns or over all."""
    return states.groupBy(*(by or [])).agg(
        F.hll_union_agg("recordings").alias("recordings"),
        F.hll_union_agg("terms").alias("terms"),
        F.expr(f"approx_top_k_combine(top, {tracked})").alias("top"),
        F.sum("n").alias("n"),
    )


def counts(states: DataFrame, *by: str) -> DataFrame:
    """*by, n, n_recordings, n_terms of states."""
    return states.select(*by, "n", F.hll_sketch_estimate("recordings").alias("n_recordings"), F.hll_sketch_estimate("terms").alias("n_terms"))


def frequent(states: DataFrame, k: int, *by: str) -> DataFrame:
    """*by, term, n: the k most frequent terms of states, by the sketch."""
    top = F.expr(f"approx_top_k_estimate(top, {k})")
    return states.select(*by, F.explode(top).alias("t")).select(*by, F.col("t.item").alias("term"), F.col("t.count").alias("n"))
