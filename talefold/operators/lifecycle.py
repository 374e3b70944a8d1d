"""Deletion, file generations, purge plans, ingest and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recordings import is_placeholder
from ..functions.text import strip
from .records import PLACEHOLDERS

UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
DEFAULTS = {"language": "ko", "type": "meeting"}
ALLOWED = ["m4a", "mp3", "wav", "aac", "ogg", "flac"]


def tombstone_state(requests: DataFrame) -> DataFrame:
    """One row per recording: the last state, the last reason given, the first request."""
    order = F.struct("requested_at", "seq")
    return requests.groupBy("recording_id").agg(
        F.max_by("delete_state", order).alias("delete_state"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), order)).alias("reason"),
        F.min("requested_at").alias("requested_at"),
        F.count("*").alias("n_requests"),
    )


def live_references(files: DataFrame, refs: DataFrame) -> DataFrame:
    """file_id, n_live of every file."""
    return files.join(refs, "file_id", "left").groupBy("file_id").agg(F.count_if(F.coalesce("active", F.lit(False))).alias("n_live"))


def orphan_files(files: DataFrame, refs: DataFrame, now, age_s: int = 300) -> DataFrame:
    """file_id of finished files(file_id, finished_at) that nothing refers to and that are older than age_s."""
    return files.where(F.col("finished_at") < now - F.expr(f"INTERVAL {age_s} SECONDS")).join(refs.select("file_id"), "file_id", "left_anti").select("file_id")


def purge_status(plan: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """purge_id, server, device, overall of a plan and reports(purge_id, server, device); and the purge_id that wait for the device."""
    rows = plan.select("purge_id", "ready").join(reports, "purge_id", "left")
    server = F.when(~F.col("ready"), "blocked").otherwise(F.coalesce("server", F.lit("pending")))
    device = F.coalesce("device", F.lit("pending"))
    overall = F.when(server == "blocked", "blocked").when((server == "done") & (device == "done"), "done").when((server == "failed") | (device == "failed"), "failed").otherwise("pending")
    out = rows.select("purge_id", server.alias("server"), device.alias("device"), overall.alias("overall"))
    return out, out.where("server = 'done' AND device = 'pending'").select("purge_id")


def purge_plan(intents: DataFrame, refs: DataFrame) -> DataFrame:
    """purge_id, n_files, n_purgeable, ready: a file may go if nothing live refers to it."""
    n = refs.groupBy("file_id").agg(F.count_if("active").alias("n_live"))
    rows = intents.select("purge_id", F.explode(F.array_distinct("file_ids")).alias("file_id")).join(n, "file_id", "left")
    free = F.coalesce("n_live", F.lit(0)) == 0
    return rows.groupBy("purge_id").agg(F.count("*").alias("n_files"), F.count_if(free).alias("n_purgeable"), F.bool_and(free).alias("ready"))


def carry_forward(refs: DataFrame, recordings: DataFrame) -> DataFrame:
    """References after a switch to the next generation: old ones inactive, all but the canonical ones again."""
    rows = refs.join(recordings.select("recording_id", "current_generation"), "recording_id")
    now = F.col("active") & (F.col("generation") == F.col("current_generation"))
    old = rows.select("file_id", "recording_id", "generation", "role", F.when(now, F.lit(False)).otherwise(F.col("active")).alias("active"))
    new = rows.where(now & (F.col("role") != "canonical")).select("file_id", "recording_id", (F.col("generation") + 1).alias("generation"), "role", F.lit(True).alias("active"))
    return old.unionByName(new)


def register_artifacts(offers: DataFrame, recordings: DataFrame, refs: DataFrame, roles: list[str]) -> DataFrame:
    """file_id, recording_id, generation, role of new artifacts: known role, current generation, not there yet."""
    g = recordings.select("recording_id", F.col("current_generation").alias("generation"))
    key = ["file_id", "recording_id", "generation", "role"]
    rows = offers.where(F.col("role").isin(roles)).join(g, ["recording_id", "generation"]).select(*key).distinct()
    return rows.join(refs.select(*key), key, "left_anti").join(refs.where("role = 'canonical'").select("file_id"), "file_id", "left_anti").select(*key)


def mentions(rows: DataFrame, ids: DataFrame, pattern: str = UUID) -> DataFrame:
    """recording_id, n_rows: how many other rows(row_id, recording_id, text) name it; ids are cut out once and joined."""
    named = rows.select("row_id", F.col("recording_id").alias("own"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("recording_id"))
    return named.where("own <> recording_id").join(ids.select("recording_id"), "recording_id").groupBy("recording_id").agg(F.count("*").alias("n_rows"))


def safe_to_delete(recordings: DataFrame, mentioned: DataFrame, files: DataFrame, harmless: list[str], corrupt: DataFrame | None = None) -> DataFrame:
    """recording_id that nothing names and whose audio is corrupt or whose files are of harmless roles alone."""
    roles = files.groupBy("recording_id").agg(F.collect_set("role").alias("roles"))
    rows = recordings.select("recording_id").join(roles, "recording_id", "left").join(mentioned, "recording_id", "left_anti")
    only = F.size(F.array_except(F.coalesce("roles", F.array().cast("array<string>")), F.array(*map(F.lit, harmless)))) == 0
    if corrupt is None:
        return rows.where(only).select("recording_id")
    rows = rows.join(corrupt.select("recording_id").distinct().withColumn("corrupt", F.lit(True)), "recording_id", "left")
    return rows.where(only | F.coalesce("corrupt", F.lit(False))).select("recording_id")


def sweep_edit_leases(edits: DataFrame, now) -> DataFrame:
    """edit_id, state of edits(edit_id, state, lease_expires_at, grace_until): leases that ran out, and edits whose time to object is over."""
    state = F.when((F.col("state") == "EDITING") & (F.col("lease_expires_at") <= now), "EDIT_RECOVERY_REQUIRED").when((F.col("state") == "EDIT_PENDING") & (F.col("grace_until") <= now), "CONFIRMED").otherwise(F.col("state"))
    return edits.select("edit_id", state.alias("state"))


def visible_children(recordings: DataFrame) -> DataFrame:
    """recording_id, n_children: visible recordings(recording_id, parent_id, visible) that were cut out of each one."""
    return recordings.where("visible AND parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("recording_id")).agg(F.count("*").alias("n_children"))


def accept_uploads(uploads: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """uploads with a verdict: accepted, or why not. Titles that say nothing become null, and a missing language or type its default."""
    kind = F.lower(F.substring_index("file_name", ".", -1))
    verdict = F.when(~kind.isin(ALLOWED), "bad_type").when(F.col("bytes") > most_bytes, "too_large").when(F.col("bytes") <= 0, "empty").otherwise("accepted")
    out = uploads.withColumn("verdict", verdict)
    if "title" in uploads.columns:
        out = out.withColumn("title", F.when(~is_placeholder(F.col("title"), PLACEHOLDERS), strip("title")))
    for name, value in DEFAULTS.items():
        if name in uploads.columns:
            out = out.withColumn(name, F.coalesce(F.nullif(name, F.lit("")), F.lit(value)))
    return out


def ingest_once(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads whose client key is new: of one key the earliest."""
    first = F.row_number().over(Window.partitionBy("client_key").orderBy("uploaded_at", "upload_id"))
    return uploads.join(known.select("client_key"), "client_key", "left_anti").withColumn("n", first).where("n = 1").drop("n")


def archive_key(recorded_at) -> object:
    """year/month of a date written as text, else 'unknown'."""
    return F.when(F.length(recorded_at) >= 7, F.concat_ws("/", F.substring(recorded_at, 1, 4), F.substring(recorded_at, 6, 2))).otherwise("unknown")


def verify_archive(local: DataFrame, remote: DataFrame) -> DataFrame:
    """recording_id, verdict: size first, then checksum."""
    r = remote.select("recording_id", F.col("size").alias("rs"), F.col("md5").alias("rm"))
    verdict = F.when(F.col("rs").isNull(), "missing").when(F.col("rs") != F.col("size"), "size_differs").when(F.col("rm") != F.col("md5"), "md5_differs").otherwise("ok")
    return local.join(r, "recording_id", "left").select("recording_id", verdict.alias("verdict"))
