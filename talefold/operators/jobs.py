"""Queue, lease and recovery views over job, event and tombstone tables. The time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ["stt", "correction", "semantic", "reduce"]
WAITING = ["queued", "retry_wait"]
#: How many jobs a stage takes at once.
SLOTS = {"stt": 1, "correction": 2, "semantic": 2, "reduce": 1}


def live(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """rows of recordings that are not deleted."""
    return rows.join(tombstones.select("recording_id").distinct(), "recording_id", "left_anti")


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """One new job per recording that has none; of several requests the first."""
    new = requests.join(jobs.select("recording_id"), "recording_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("recording_id").orderBy("requested_at", "request_id"))
    return new.withColumn("n", first).where("n = 1").select("recording_id", "request_id", F.lit("queued").alias("status"))


def current(jobs: DataFrame, generations: DataFrame) -> DataFrame:
    """jobs with is_current; a recording without a generation row is current."""
    g = generations.select("recording_id", "current_generation")
    return jobs.join(g, "recording_id", "left").withColumn("is_current", F.coalesce(F.col("generation") == F.col("current_generation"), F.lit(True))).drop("current_generation")


def eligible(jobs: DataFrame, generations: DataFrame, tombstones: DataFrame, top: int) -> DataFrame:
    """The oldest `top` jobs that may be claimed."""
    rows = live(current(jobs, generations), tombstones).where(F.col("is_current") & F.col("status").isin(WAITING) & (F.col("attempts") < F.col("max_attempts")) & ~F.col("cancel_requested"))
    return rows.orderBy("created_at", "job_id").limit(top).select("job_id", "recording_id", "created_at")


def recover_stale(jobs: DataFrame, now: Column) -> DataFrame:
    """job_id, status, attempts, event of active jobs whose lease has run out."""
    more = F.col("attempts") + 1
    status = F.when(more >= F.col("max_attempts"), "failed").otherwise("retry_wait")
    return jobs.where(F.col("status").isin(ACTIVE) & (F.col("lease_expires_at") < now)).select("job_id", status.alias("status"), more.alias("attempts"), F.lit("stale_recovery").alias("event"))


def cancel_superseded(jobs: DataFrame, generations: DataFrame) -> DataFrame:
    """job_id of active jobs that are cancelled or of an older generation."""
    return current(jobs, generations).where(F.col("status").isin(ACTIVE) & (F.col("cancel_requested") | ~F.col("is_current"))).select("job_id", F.lit("cancelled").alias("status"))


def cancel_deleted(jobs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The update and the event of each job of a deleted recording that is not cancelled yet."""
    rows = jobs.join(tombstones.select("recording_id").distinct(), "recording_id", "left_semi").where("status <> 'cancelled'")
    told = {"status": "cancelled", "step": "deleted", "error_code": "deleted", "event": "cancelled_by_delete"}
    return rows.select("job_id", "recording_id", *(F.lit(v).alias(k) for k, v in told.items()))


def occupancy(jobs: DataFrame, now: Column, slots: dict[str, int] = SLOTS) -> DataFrame:
    """stage, n_live, slots, is_full."""
    held = jobs.where(F.col("status").isin(ACTIVE) & (F.col("lease_expires_at") >= now)).groupBy(F.col("status").alias("stage")).agg(F.count("*").alias("n_live"))
    limits = jobs.sparkSession.createDataFrame(list(slots.items()), "stage string, slots long")
    n = F.coalesce("n_live", F.lit(0).cast("long"))
    return limits.join(held, "stage", "left").select("stage", n.alias("n_live"), "slots", (n >= F.col("slots")).alias("is_full"))


def error_class(message: Column) -> Column:
    """code of an error message: the first rule with one of its words."""
    rules = {"timeout": ["timed out", "timeout"], "network": ["connection", "unreachable"], "bad_audio": ["invalid data", "corrupt"], "quota": ["rate limit", "quota"]}
    out = F.lit("unknown")
    for code, cues in reversed(rules.items()):
        hit = F.lit(False)
        for c in cues:
            hit = hit | F.contains(F.lower(message), F.lit(c))
        out = F.when(hit, code).otherwise(out)
    return out


def retry_triage(jobs: DataFrame, tombstones: DataFrame, files: DataFrame, least_bytes: int = 10_000, top: int = 50) -> DataFrame:
    """job_id, verdict of the newest failed jobs: requeue, or why not."""
    audio = files.groupBy("recording_id").agg(F.max("bytes").alias("audio"))
    rows = live(jobs.where("status = 'failed'"), tombstones).join(audio, "recording_id", "left").withColumn("code", error_class(F.coalesce("error_message", F.lit(""))))
    verdict = F.when(F.col("audio").isNull(), "no_audio").when(F.col("audio") < least_bytes, "audio_too_small").when(F.col("code") == "bad_audio", "not_retryable").otherwise("requeue")
    return rows.orderBy(F.desc("updated_at"), "job_id").limit(top).select("job_id", "code", verdict.alias("verdict"))


def reconcile(jobs: DataFrame, files: DataFrame, now: Column, grace_s: int = 300) -> DataFrame:
    """recording_id, next_stage, action from the artifacts there are and the job's state."""
    has = lambda role: F.max((F.col("role") == role).cast("int")) == 1
    flags = files.where("bytes > 0").groupBy("recording_id").agg(has("audio").alias("audio"), has("segments").alias("segments"), has("final").alias("final"))
    rows = flags.join(jobs.select("recording_id", "status", F.greatest("heartbeat_at", "updated_at", "lease_expires_at").alias("seen")), "recording_id", "full")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    stage = F.when(flag("final"), "done").when(flag("segments"), "correction").when(flag("audio"), "stt").otherwise("none")
    fresh = F.coalesce(F.col("status").isin(ACTIVE) & (F.col("seen") >= now - F.expr(f"INTERVAL {grace_s} SECONDS")), F.lit(False))
    action = F.when(fresh, "skip_active").when(flag("final"), "already_final").when(~flag("audio"), "unrecoverable").when(F.coalesce(F.col("status").isin("failed", "cancelled"), F.lit(False)), "skip_terminal").otherwise("enqueue_resume")
    return rows.select("recording_id", stage.alias("next_stage"), action.alias("action"))


def listing(jobs: DataFrame, tombstones: DataFrame, top: int) -> DataFrame:
    """The newest `top` jobs of recordings that are not deleted."""
    return live(jobs, tombstones).orderBy(F.desc("created_at"), "job_id").limit(top).select("job_id", "recording_id", "status", "created_at")


def event_listing(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, n, event_id, event: the events of the given jobs, numbered in order."""
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    return events.join(jobs.select("job_id").distinct(), "job_id", "left_semi").select("job_id", n.alias("n"), "event_id", "event")


def chunk_times(spans: DataFrame) -> DataFrame:
    """key, n, elapsed_ms, longest_ms of spans(key, start_at, end_at)."""
    ms = F.floor((F.unix_micros(F.col("end_at").cast("timestamp")) - F.unix_micros(F.col("start_at").cast("timestamp"))) / 1000)
    return spans.groupBy("key").agg(F.count("*").alias("n"), F.sum(ms).alias("elapsed_ms"), F.max(ms).alias("longest_ms"))


def event_profile(events: DataFrame) -> DataFrame:
    """job_id with counts of claims, failures and completions; heartbeats, the bulk, are dropped first."""
    return events.where("event <> 'heartbeat'").groupBy("job_id").agg(F.count_if(F.col("event") == "claim").alias("n_claims"), F.count_if(F.col("event") == "failure").alias("n_failures"), F.count_if(F.col("event") == "completed").alias("n_completed")).withColumn("recovered", F.expr("n_claims >= 2 AND n_failures >= 1 AND n_completed >= 1"))


def fenced(updates: DataFrame, jobs: DataFrame, generations: DataFrame) -> DataFrame:
    """job_id, seq, verdict: updates count where owner and token match and the job's generation is the current one; of these the last per job is applied."""
    j = current(jobs, generations).select("job_id", "claimed_by", F.col("claim_token").alias("token"), "cancel_requested", "is_current")
    rows = updates.join(j, "job_id", "left")
    own = F.coalesce((F.col("worker_id") == F.col("claimed_by")) & (F.col("claim_token") == F.col("token")) & ~F.col("cancel_requested") & F.col("is_current"), F.lit(False))
    last = F.max(F.when(own, F.col("seq"))).over(Window.partitionBy("job_id"))
    return rows.select("job_id", "seq", F.when(~own, "ownership_lost").when(F.col("seq") == last, "applied").otherwise("overwritten").alias("verdict"))


def peak_concurrency(spans: DataFrame) -> DataFrame:
    """key, peak: most spans(key, start_at, end_at) that run at once; one that ends frees its place first."""
    steps = spans.select("key", F.explode(F.array(F.struct(F.col("start_at").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_at").alias("at"), F.lit(-1).alias("d")))).alias("s")).select("key", "s.*")
    running = F.sum("d").over(Window.partitionBy("key").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("n", running).groupBy("key").agg(F.max("n").alias("peak"))


def lease_episodes(events: DataFrame, lease_s: int) -> DataFrame:
    """job_id, episode, first_at, last_at, n: runs of events without a gap over the lease."""
    by = Window.partitionBy("job_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by)) > lease_s * 1_000_000).cast("int"), F.lit(0))
    rows = events.withColumn("gap", gap).withColumn("episode", F.sum("gap").over(by) + 1)
    return rows.groupBy("job_id", "episode").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n"))


def progress_changes(events: DataFrame) -> DataFrame:
    """Events whose state differs from the one before."""
    by = Window.partitionBy("job_id").orderBy("ts", "event_id")
    return events.withColumn("before", F.lag("event").over(by)).where(~F.col("event").eqNullSafe(F.col("before"))).select("job_id", "event_id", "event")
