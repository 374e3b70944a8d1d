"""Structured Streaming jobs: ingest once per key, lease watchdog, progress changes."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest_once(uploads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of uploads(client_key, uploaded_at, ...) with one row per client key within the delay: the first that arrives, at once."""
    return uploads.withWatermark("uploaded_at", delay).dropDuplicatesWithinWatermark(["client_key"])


def _earliest(columns: list[str]) -> Column:
    """The row of a key that was uploaded first; of several the least by its other columns."""
    rest = [c for c in columns if c not in ("client_key", "uploaded_at")]
    return F.min(F.struct(F.col("uploaded_at").isNull().alias("_undated"), "uploaded_at", *rest))


def ingest_earliest(uploads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same with the row that was uploaded first, in whatever order they arrive, once the delay has passed.

    Uploads of a key that follow one another within the delay are one upload; state is dropped as the watermark passes.
    """
    by = uploads.withWatermark("uploaded_at", delay).groupBy("client_key", F.session_window("uploaded_at", delay).alias("w"))
    return by.agg(_earliest(uploads.columns).alias("e")).select("client_key", "e.*").select(*uploads.columns)


def write_new(uploads: DataFrame, path: str, checkpoint: str, buckets: int = 256):
    """Starts the sink: of each batch, the earliest row of each client key that the written table does not hold yet.

    The table lies in buckets of the key, and in a bucket by batch. A batch reads the keys of the
    buckets that it falls into and no others, and writes partitions that bear its own name;
    done again after a failure, it leaves aside what it wrote itself and replaces it, so a
    replay adds nothing. One sink writes to a table at a time; a key once written stays as it is.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    spark, layout = uploads.sparkSession, ["bucket", "batch"]
    placed = T.StructType([*uploads.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.StringType())])
    spark.createDataFrame([], placed).write.mode("ignore").partitionBy(*layout).parquet(path)

    def sink(batch: DataFrame, number: int) -> None:
        own = f"{name}-{number}"
        bucket = F.pmod(F.xxhash64("client_key"), F.lit(buckets)).cast("int")
        rows = batch.groupBy("client_key").agg(_earliest(batch.columns).alias("e")).select("client_key", "e.*").select(*batch.columns, bucket.alias("bucket"), F.lit(own).alias("batch"))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most as many as there are buckets
        known = batch.sparkSession.read.schema(placed).parquet(path).where(F.col("bucket").isin(touched) & (F.col("batch") != own)).select("client_key", "bucket")
        new = rows.join(known, rows["client_key"].eqNullSafe(known["client_key"]) & (rows["bucket"] == known["bucket"]), "left_anti")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*layout).parquet(path)
        rows.unpersist()

    return uploads.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lease_sessions(events: DataFrame, lease: str = "90 seconds", delay: str = "10 minutes") -> DataFrame:
    """job_id, claim_token, first_at, last_at, n: stretches of heartbeats without a gap over the lease."""
    by = events.withWatermark("ts", delay).groupBy(F.session_window("ts", lease).alias("w"), "job_id", "claim_token")
    return by.agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n")).drop("w")


def progress_changes(events: DataFrame) -> DataFrame:
    """job_id, event_id, event of a stream(job_id, event_id, event): rows whose state differs from the job's last, as they arrive."""

    def step(key: tuple, batches, state):
        last = state.get[0] if state.exists else None
        out = []
        for rows in batches:
            for e, name in sorted(zip(rows["event_id"].tolist(), rows["event"].tolist(), strict=True)):
                if name != last:
                    out.append((key[0], e, name))
                    last = name
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["job_id", "event_id", "event"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, event_id long, event string", "last string", "append", "NoTimeout")


def ordered_changes(events: DataFrame, delay: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """job_id, event_id, event of a stream(job_id, event_id, ts, event): rows whose state differs from the job's last one in order of time.

    Rows wait until the watermark has passed them, so they may arrive in any order within the
    delay; later ones are dropped. A job holds the rows that wait and its last state, and is
    forgotten when it was idle for idle_ms; what comes then counts as its first.
    """

    def step(key: tuple, batches, state):
        last, known_at, waiting = (None, 0, []) if not state.exists else (state.get[0], state.get[1], list(zip(*state.get[2:], strict=True)))
        for rows in batches:
            at = pd.to_datetime(rows["ts"]).astype("datetime64[us]").astype("int64")
            waiting += zip(at.tolist(), rows["event_id"].tolist(), rows["event"].tolist(), strict=True)
        now, out = state.getCurrentWatermarkMs(), []
        waiting.sort(key=lambda x: x[:2])
        ready = bisect_right(waiting, now * 1000, key=lambda x: x[0])
        for at, event_id, event in waiting[:ready]:
            if event != last:
                out.append((key[0], event_id, event))
                last = event
            known_at = max(known_at, at // 1000)
        waiting = waiting[ready:]
        if not waiting and known_at + idle_ms <= now:
            if state.exists:
                state.remove()
        else:
            state.update((last, known_at, *([list(x) for x in zip(*waiting, strict=True)] or [[], [], []])))
            state.setTimeoutTimestamp(max(now + 1, waiting[0][0] // 1000 if waiting else known_at + idle_ms))
        yield pd.DataFrame(out, columns=["job_id", "event_id", "event"])

    dated = events.withWatermark("ts", delay)
    return dated.groupBy("job_id").applyInPandasWithState(step, "job_id long, event_id long, event string", "last string, known_at long, ts array<long>, event_id array<long>, event array<string>", "append", "EventTimeTimeout")


def run_once(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Runs a stream over all that is there and writes it to path."""
    out = each(stream) if each else stream
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
