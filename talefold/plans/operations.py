"""Queries over jobs, deletion, files, archives and recognition quality, on shapes derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evalstt as E
from ..operators import jobs as J
from ..operators import lifecycle as L
from ..operators.outputs import gold_skeleton as skeleton
from ..sources.tables import flat_files
from .shapes import table

NOW = "2024-01-31 00:00:00"
FILLERS = ["the", "and", "of", "a"]


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _events(spark, d):
    kind = F.element_at(F.create_map(*(F.lit(x) for x in ("signup", "enqueue", "view", "claim", "click", "heartbeat", "error", "failure", "purchase", "completed"))), F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), kind.alias("event"), "value")


def _jobs(spark, d):
    last = F.max_by("event", F.struct("ts", "event_id"))
    status = F.element_at(F.create_map(*(F.lit(x) for x in ("enqueue", "queued", "claim", "stt", "heartbeat", "semantic", "failure", "failed", "completed", "completed"))), F.col("last"))
    rows = _events(spark, d).groupBy("job_id").agg(last.alias("last"), F.count_if(F.col("event") == "claim").alias("claims"), F.count("*").alias("n"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max(F.when(F.col("event") == "heartbeat", F.col("ts"))).alias("heartbeat_at"))
    messages = F.array(*map(F.lit, ("Connection reset", "ran into timeout", "invalid data found", "quota is used up", "something else")))
    return rows.select(
        "job_id",
        F.col("job_id").alias("recording_id"),
        status.alias("status"),
        (F.col("claims") % 4).alias("attempts"),
        F.lit(3).alias("max_attempts"),
        "created_at",
        "updated_at",
        "heartbeat_at",
        (F.col("updated_at") + F.expr("INTERVAL 6 HOURS")).alias("lease_expires_at"),
        (F.col("n") % 2).alias("generation"),
        (F.col("job_id") % 11 == 0).alias("cancel_requested"),
        F.element_at(messages, (F.col("job_id") % 5 + 1).cast("int")).alias("error_message"),
        F.concat(F.lit("w"), F.col("job_id") % 3).alias("claimed_by"),
        F.concat(F.lit("t"), F.col("job_id") % 4).alias("claim_token"),
    )


def _generations(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("recording_id"), (F.col("user_id") % 2).alias("current_generation")).distinct().where("recording_id % 3 <> 0")


def _requests(spark, d):
    n = F.col("event_id")
    return _events(spark, d).where("event = 'failure' AND value > 90").select(F.col("job_id").alias("recording_id"), F.col("ts").alias("requested_at"), n.alias("seq"), F.when(n % 3 == 0, "requested").when(n % 3 == 1, "confirmed").otherwise("failed").alias("delete_state"), F.when(n % 2 == 0, F.concat(F.lit("r"), n.cast("string"))).alias("reason"))


def _artifacts(spark, d):
    role = F.when(F.col("event") == "enqueue", "audio").when(F.col("event") == "claim", "segments").when(F.col("event") == "completed", "final")
    return _events(spark, d).where("job_id % 7 <> 3").select(F.col("job_id").alias("recording_id"), role.alias("role"), F.floor(F.col("value") * 100).alias("bytes")).where("role IS NOT NULL AND (role <> 'final' OR recording_id % 2 = 0)")


def queue_eligible(spark, d):
    return J.eligible(_jobs(spark, d), _generations(spark, d), _requests(spark, d), 20)


def stale_recovery(spark, d):
    return J.recover_stale(_jobs(spark, d), _now())


def superseded_jobs(spark, d):
    return J.cancel_superseded(_jobs(spark, d), _generations(spark, d))


def cancel_deleted(spark, d):
    return J.cancel_deleted(_jobs(spark, d), _requests(spark, d))


def stage_occupancy(spark, d):
    return J.occupancy(_jobs(spark, d), F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"))


def retry_triage(spark, d):
    return J.retry_triage(_jobs(spark, d), _requests(spark, d), _artifacts(spark, d), 9000)


def reconcile_actions(spark, d):
    return J.reconcile(_jobs(spark, d), _artifacts(spark, d), _now())


def event_profile(spark, d):
    return J.event_profile(_events(spark, d))


def fenced_updates(spark, d):
    n = F.col("event_id")
    updates = _events(spark, d).where("event = 'completed'").select("job_id", n.alias("seq"), F.concat(F.lit("w"), n % 3).alias("worker_id"), F.concat(F.lit("t"), n % 4).alias("claim_token"))
    return J.fenced(updates, _jobs(spark, d), _generations(spark, d))


def peak_concurrency(spark, d):
    rows = _events(spark, d).where("event = 'claim'").select(F.col("job_id").alias("key"), F.col("ts").alias("start_at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("end_at"))
    return J.peak_concurrency(rows)


def lease_episodes(spark, d):
    return J.lease_episodes(_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), 12 * 3600).select("job_id", "episode", "n")


def progress_changes(spark, d):
    return J.progress_changes(_events(spark, d))


def live_only(spark, d):
    return J.live(_jobs(spark, d), _requests(spark, d)).select("job_id", "status")


def tombstone_state(spark, d):
    return L.tombstone_state(_requests(spark, d))


def _refs(spark, d):
    x = table(spark, d, "lineitem")
    role = F.when(F.col("l_linenumber") == 1, "canonical").when(F.col("l_linenumber") < 4, "audio").otherwise("note")
    return x.select(F.col("l_partkey").alias("file_id"), F.col("l_orderkey").alias("recording_id"), (F.col("l_linenumber") % 2).alias("generation"), role.alias("role"), (F.col("l_linestatus") == "O").alias("active"))


def _recordings(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("recording_id"), (F.col("o_orderkey") % 2).cast("int").alias("current_generation"))


def file_refs(spark, d):
    return L.live_references(table(spark, d, "part").select(F.col("p_partkey").alias("file_id")), _refs(spark, d))


def purge_plan(spark, d):
    intents = _refs(spark, d).groupBy(F.col("recording_id").alias("purge_id")).agg(F.collect_list("file_id").alias("file_ids"))
    # In use are the active notes of the second generation.
    return L.purge_plan(intents, _refs(spark, d).withColumn("active", F.col("active") & (F.col("generation") == 1) & (F.col("role") == "note")))


def carry_forward(spark, d):
    return L.carry_forward(_refs(spark, d), _recordings(spark, d))


def register_artifacts(spark, d):
    refs = _refs(spark, d)
    return L.register_artifacts(refs.where("active"), _recordings(spark, d), refs.where("NOT active AND file_id % 2 = 0"), ["audio", "note"])


def reference_scan(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").cast("string").alias("recording_id"), F.col("props").alias("text"))
    ids = rows.select("recording_id").distinct()
    return L.mentions(rows, ids, r"\d+")


def safe_delete(spark, d):
    ids = _jobs(spark, d).select("recording_id")
    named = reference_scan(spark, d).select(F.col("recording_id").cast("long").alias("recording_id"))
    return L.safe_to_delete(ids, named, _artifacts(spark, d), ["audio", "segments"], ids.where("recording_id % 4 = 1"))


def upload_verdicts(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("m4a", "MP3", "txt", "wav"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("upload_id"), F.concat(F.lit("a.b."), kind).alias("file_name"), F.floor(F.col("o_totalprice") * 3000).alias("bytes"))
    return L.accept_uploads(rows).select("upload_id", "verdict")


def ingest_once(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("upload_id"), F.col("o_custkey").alias("client_key"), F.col("o_orderdate").alias("uploaded_at"))
    return L.ingest_once(rows, table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("client_key"))).select("upload_id", "client_key")


def archive_verify(spark, d):
    local = table(spark, d, "orders").select(F.col("o_orderkey").alias("recording_id"), F.floor("o_totalprice").alias("size"), F.md5(F.col("o_orderpriority").cast("binary")).alias("md5"))
    n = F.col("recording_id")
    remote = local.where(n % 9 != 0).select("recording_id", (F.col("size") + F.when(n % 7 == 0, 1).otherwise(0)).alias("size"), F.when(n % 5 == 0, "x").otherwise(F.col("md5")).alias("md5"))
    return L.verify_archive(local, remote)


def archive_keys(spark, d):
    day = F.when(F.col("o_orderkey") % 10 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("n/a"))
    return table(spark, d, "orders").groupBy(L.archive_key(day).alias("archive_key")).agg(F.count("*").alias("n"))


def _cases(spark, d):
    words = F.filter(F.split("text", r"[ \n]+"), lambda x: F.length(x) > 6)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.slice(words, 1, 3).alias("must"), F.slice(words, 4, 2).alias("bad"))


def _runs(spark, d):
    # The divisor follows the benchmark's ids, which count from 0, so that every case gets runs at every size.
    cases = table(spark, d, "benchmark").agg((F.max("item_id") + 1).alias("n"))
    return table(spark, d, "documents").crossJoin(F.broadcast(cases)).select((F.col("doc_id") % F.col("n")).alias("case_id"), F.col("source").alias("model"), "text")


def stt_case_hits(spark, d):
    return E.case_hits(_cases(spark, d), _runs(spark, d))


def stt_seconds(spark, d):
    """The report by model with seconds; a run takes a second per 500 characters of audio at 15 characters a second, and some lengths are not known."""
    n = F.col("n_chars")
    runs = table(spark, d, "documents").select(F.col("source").alias("model"), (F.floor(n / 500) + 1).alias("elapsed_sec"), F.when(F.col("doc_id") % 4 != 1, F.floor(n / 15) + 1).alias("audio_sec"))
    return E.timed_report(stt_case_hits(spark, d), runs).withColumn("model", F.coalesce("model", F.lit("all")))


def stt_report(spark, d):
    return E.report(stt_case_hits(spark, d)).withColumn("model", F.coalesce("model", F.lit("all")))


def enqueue(spark, d):
    """Requests from orders; recordings below a number have their job already."""
    requests = table(spark, d, "orders").select(F.col("o_custkey").alias("recording_id"), F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("requested_at"))
    return J.enqueue(_jobs(spark, d), requests)


def job_listing(spark, d):
    return J.listing(_jobs(spark, d), _requests(spark, d), 50)


def event_listing(spark, d):
    return J.event_listing(_events(spark, d), _jobs(spark, d).where("status = 'failed'"))


def chunk_times(spark, d):
    rows = _events(spark, d).where("event = 'claim'").select(F.col("job_id").alias("key"), F.col("ts").alias("start_at"), (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, CAST(job_id AS DECIMAL(18, 6)))")).alias("end_at"))
    return J.chunk_times(rows)


def orphan_files(spark, d):
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("finished_at"))
    return L.orphan_files(files, _refs(spark, d).where("active"), F.lit("1995-06-01 00:00:00").cast("timestamp_ntz"))


def _reports(spark, d):
    n = F.col("o_orderkey")
    return table(spark, d, "orders").where(n % 5 != 0).select(n.alias("purge_id"), F.when(n % 3 != 0, "done").when(n % 2 == 0, "failed").alias("server"), F.when(n % 4 != 0, "done").alias("device"))


def purge_status(spark, d):
    return L.purge_status(purge_plan(spark, d), _reports(spark, d))[0]


def device_pending(spark, d):
    return L.purge_status(purge_plan(spark, d), _reports(spark, d))[1]


def edit_leases(spark, d):
    n = F.col("o_orderkey")
    state = F.when(n % 3 == 0, "EDITING").when(n % 3 == 1, "EDIT_PENDING").otherwise("FINAL")
    rows = table(spark, d, "orders").select(n.alias("edit_id"), state.alias("state"), F.when(n % 4 != 0, F.col("o_orderdate")).cast("timestamp_ntz").alias("lease_expires_at"), F.col("o_orderdate").cast("timestamp_ntz").alias("grace_until"))
    return L.sweep_edit_leases(rows, F.lit("1995-06-01 00:00:00").cast("timestamp_ntz"))


def visible_children(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("recording_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("parent_id"), (F.col("o_orderstatus") != "P").alias("visible"))
    return L.visible_children(rows)


def upload_defaults(spark, d):
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select(n.alias("upload_id"), F.lit("a.m4a").alias("file_name"), F.col("n_chars").alias("bytes"), F.when(n % 3 == 0, " untitled ").when(n % 3 == 1, F.concat(F.lit(" t"), n.cast("string"))).alias("title"), F.when(n % 2 == 0, F.col("lang")).otherwise("").alias("language"), F.lit(None).cast("string").alias("type"))
    return L.accept_uploads(rows).select("upload_id", "verdict", "title", "language", "type")


def flat_catalog(spark, d):
    """Flat files of older recordings, their names made of the order lines."""
    role = F.element_at(F.array(*map(F.lit, ("raw", "clean", "summary", "analysis", "other"))), F.col("l_linenumber") % 5 + 1)
    return flat_files(table(spark, d, "lineitem").select(F.concat(F.lit("/data/2024_talk"), F.col("l_orderkey").cast("string"), F.lit("_"), role, F.lit(".txt")).alias("path")))


def gold_skeleton(spark, d):
    out = skeleton(_cases(spark, d))
    return out.select("case_id", "transcript", "status", F.transform("must_correct", lambda x: x["wrong"]).alias("wrong"), "expected")


def keyword_quality(spark, d):
    words = F.transform(F.slice(F.split("text", " "), 1, (F.col("doc_id") % 12 + 1).cast("int")), lambda w: F.concat(F.lit(" #"), w))
    return E.keyword_quality(table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), words.alias("keywords")), FILLERS)


QUERIES = {
    f.__name__: f
    for f in (queue_eligible, stale_recovery, superseded_jobs, stage_occupancy, retry_triage, reconcile_actions, event_profile, fenced_updates, peak_concurrency, lease_episodes, progress_changes, live_only, tombstone_state, file_refs, purge_plan, carry_forward, register_artifacts, reference_scan, safe_delete, upload_verdicts, ingest_once, archive_verify, archive_keys, stt_case_hits, stt_report, stt_seconds, cancel_deleted, keyword_quality)
    + (enqueue, job_listing, event_listing, chunk_times, orphan_files, purge_status, device_pending, edit_leases, visible_children, upload_defaults, flat_catalog, gold_skeleton)
}

_E = "e AS (SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'completed' END AS event, value FROM events)"
_J = f"""{_E}, j AS (
  SELECT job_id, job_id AS recording_id, CASE arg_max(event, (ts, event_id)) WHEN 'enqueue' THEN 'queued' WHEN 'claim' THEN 'stt' WHEN 'heartbeat' THEN 'semantic' WHEN 'failure' THEN 'failed' ELSE 'completed' END AS status,
    count(*) FILTER (event = 'claim') % 4 AS attempts, 3 AS max_attempts, min(ts) AS created_at, max(ts) AS updated_at, max(ts) FILTER (event = 'heartbeat') AS heartbeat_at, max(ts) + INTERVAL 6 HOUR AS lease_expires_at,
    count(*) % 2 AS generation, job_id % 11 = 0 AS cancel_requested, ['Connection reset', 'ran into timeout', 'invalid data found', 'quota is used up', 'something else'][job_id % 5 + 1] AS error_message,
    'w' || (job_id % 3) AS claimed_by, 't' || (job_id % 4) AS claim_token FROM e GROUP BY job_id),
  g AS (SELECT DISTINCT user_id AS recording_id, user_id % 2 AS current_generation FROM events WHERE user_id % 3 <> 0),
  c AS (SELECT j.*, coalesce(generation = current_generation, true) AS is_current FROM j LEFT JOIN g USING (recording_id)),
  q AS (SELECT job_id AS recording_id, ts AS requested_at, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'requested' WHEN 1 THEN 'confirmed' ELSE 'failed' END AS delete_state, CASE WHEN event_id % 2 = 0 THEN 'r' || event_id END AS reason FROM e WHERE event = 'failure' AND value > 90),
  a AS (SELECT job_id AS recording_id, CASE event WHEN 'enqueue' THEN 'audio' WHEN 'claim' THEN 'segments' WHEN 'completed' THEN 'final' END AS role, CAST(floor(value * 100) AS BIGINT) AS bytes
    FROM e WHERE job_id % 7 <> 3 AND event IN ('enqueue', 'claim', 'completed') AND (event <> 'completed' OR job_id % 2 = 0))"""
_ACTIVE = "('stt', 'correction', 'semantic', 'reduce')"
_R = """r AS (SELECT l_partkey AS file_id, l_orderkey AS recording_id, l_linenumber % 2 AS generation, CASE WHEN l_linenumber = 1 THEN 'canonical' WHEN l_linenumber < 4 THEN 'audio' ELSE 'note' END AS role, l_linestatus = 'O' AS active FROM lineitem),
  o AS (SELECT o_orderkey AS recording_id, CAST(o_orderkey % 2 AS INTEGER) AS current_generation FROM orders)"""
_M = r"""m AS (SELECT id AS recording_id, count(*) AS n_rows FROM (SELECT DISTINCT event_id, CAST(user_id AS VARCHAR) AS own, unnest(regexp_extract_all(props, '\d+')) AS id FROM events)
  WHERE own <> id AND id IN (SELECT CAST(user_id AS VARCHAR) FROM events) GROUP BY 1)"""
_H = r"""k AS (SELECT item_id, list_filter(string_split_regex(text, '[ \n]+'), lambda x: length(x) > 6) AS w FROM benchmark),
  h AS (SELECT item_id AS case_id, source AS model, list_filter(w[1:3], lambda x: NOT contains(text, x)) AS misses, len(w[1:3]) AS n_must, len(list_filter(w[4:5], lambda x: contains(text, x))) AS n_bad FROM documents JOIN k ON item_id = doc_id % (SELECT max(item_id) + 1 FROM benchmark)),
  hits AS (SELECT case_id, model, n_must, n_must - len(misses) AS n_hits, misses, n_bad FROM h)"""
SQL = {
    "queue_eligible": f"WITH {_J} SELECT job_id, recording_id, created_at FROM c WHERE is_current AND status IN ('queued', 'retry_wait') AND attempts < max_attempts AND NOT cancel_requested AND recording_id NOT IN (SELECT recording_id FROM q) ORDER BY created_at, job_id LIMIT 20",
    "stale_recovery": f"WITH {_J} SELECT job_id, CASE WHEN attempts + 1 >= max_attempts THEN 'failed' ELSE 'retry_wait' END AS status, attempts + 1 AS attempts, 'stale_recovery' AS event FROM j WHERE status IN {_ACTIVE} AND lease_expires_at < TIMESTAMP '{NOW}'",
    "superseded_jobs": f"WITH {_J} SELECT job_id, 'cancelled' AS status FROM c WHERE status IN {_ACTIVE} AND (cancel_requested OR NOT is_current)",
    "enqueue": f"WITH {_J} SELECT recording_id, request_id, 'queued' AS status FROM (SELECT o_custkey AS recording_id, o_orderkey AS request_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1 AND recording_id NOT IN (SELECT recording_id FROM j)",
    "job_listing": f"WITH {_J} SELECT job_id, recording_id, status, created_at FROM j WHERE recording_id NOT IN (SELECT recording_id FROM q) ORDER BY created_at DESC, job_id LIMIT 50",
    "event_listing": f"WITH {_J} SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS INTEGER) AS n, event_id, event FROM e WHERE job_id IN (SELECT job_id FROM j WHERE status = 'failed')",
    "chunk_times": "SELECT user_id AS key, count(*) AS n, CAST(count(*) * user_id * 1000 AS BIGINT) AS elapsed_ms, CAST(user_id * 1000 AS BIGINT) AS longest_ms FROM events WHERE event_type = 'view' GROUP BY user_id",
    "orphan_files": f"WITH {_R} SELECT o_orderkey AS file_id FROM orders WHERE o_orderdate < TIMESTAMP '1995-05-31 23:55:00' AND o_orderkey NOT IN (SELECT file_id FROM r WHERE active)",
    "edit_leases": "SELECT o_orderkey AS edit_id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 4 <> 0 AND o_orderdate <= TIMESTAMP '1995-06-01 00:00:00' THEN 'EDIT_RECOVERY_REQUIRED' ELSE 'EDITING' END WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderdate <= TIMESTAMP '1995-06-01 00:00:00' THEN 'CONFIRMED' ELSE 'EDIT_PENDING' END ELSE 'FINAL' END AS state FROM orders",
    "visible_children": "SELECT o_custkey AS recording_id, count(*) AS n_children FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' GROUP BY 1",
    "upload_defaults": "SELECT doc_id AS upload_id, CASE WHEN n_chars > 1073741824 THEN 'too_large' WHEN n_chars <= 0 THEN 'empty' ELSE 'accepted' END AS verdict, CASE WHEN doc_id % 3 = 1 THEN 't' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 AND lang <> '' THEN lang ELSE 'ko' END AS language, 'meeting' AS type FROM documents",
    "flat_catalog": "SELECT '2024_talk' || l_orderkey AS prefix, list_sort(list(DISTINCT ['raw', 'clean', 'summary', 'analysis'][l_linenumber % 5 + 1])) AS roles FROM lineitem WHERE l_linenumber % 5 < 4 GROUP BY 1",
    "gold_skeleton": r"SELECT item_id AS case_id, '' AS transcript, 'needs_transcription' AS status, w[4:5] AS wrong, w[1:3] AS expected FROM (SELECT item_id, list_filter(string_split_regex(text, '[ \n]+'), lambda x: length(x) > 6) AS w FROM benchmark)",
    "cancel_deleted": f"WITH {_J} SELECT job_id, recording_id, 'cancelled' AS status, 'deleted' AS step, 'deleted' AS error_code, 'cancelled_by_delete' AS event FROM j WHERE status <> 'cancelled' AND recording_id IN (SELECT recording_id FROM q)",
    "keyword_quality": f"""WITH k AS (SELECT doc_id AS recording_id, list_transform(string_split(text, ' ')[1:doc_id % 12 + 1], lambda w: ' #' || w) AS w FROM documents), h AS (SELECT *, list_filter(w, lambda x: ltrim(trim(x), '#') IN {tuple(FILLERS)}) AS filler_hits FROM k)
      SELECT recording_id, len(w) AS n_keywords, filler_hits, len(filler_hits) = 0 AND len(w) <= 8 AS passed FROM h""",
    "stage_occupancy": f"""WITH {_J}, s AS (SELECT * FROM (VALUES ('stt', 1), ('correction', 2), ('semantic', 2), ('reduce', 1)) AS t(stage, slots)),
      n AS (SELECT status AS stage, count(*) AS n FROM j WHERE status IN {_ACTIVE} AND lease_expires_at >= TIMESTAMP '2024-01-30 20:00:00' GROUP BY 1)
      SELECT stage, coalesce(n, 0) AS n_live, CAST(slots AS BIGINT) AS slots, coalesce(n, 0) >= slots AS is_full FROM s LEFT JOIN n USING (stage)""",
    "retry_triage": f"""WITH {_J}, f AS (SELECT recording_id, max(bytes) AS audio FROM a GROUP BY 1),
      x AS (SELECT *, CASE WHEN contains(lower(error_message), 'timed out') OR contains(lower(error_message), 'timeout') THEN 'timeout' WHEN contains(lower(error_message), 'connection') OR contains(lower(error_message), 'unreachable') THEN 'network'
        WHEN contains(lower(error_message), 'invalid data') OR contains(lower(error_message), 'corrupt') THEN 'bad_audio' WHEN contains(lower(error_message), 'rate limit') OR contains(lower(error_message), 'quota') THEN 'quota' ELSE 'unknown' END AS code
        FROM j LEFT JOIN f USING (recording_id) WHERE status = 'failed' AND recording_id NOT IN (SELECT recording_id FROM q))
      SELECT job_id, code, CASE WHEN audio IS NULL THEN 'no_audio' WHEN audio < 9000 THEN 'audio_too_small' WHEN code = 'bad_audio' THEN 'not_retryable' ELSE 'requeue' END AS verdict FROM x ORDER BY updated_at DESC, job_id LIMIT 50""",
    "reconcile_actions": f"""WITH {_J}, f AS (SELECT recording_id, bool_or(role = 'audio') AS audio, bool_or(role = 'segments') AS segments, bool_or(role = 'final') AS final FROM a WHERE bytes > 0 GROUP BY 1),
      x AS (SELECT recording_id, coalesce(audio, false) AS audio, coalesce(segments, false) AS segments, coalesce(final, false) AS final, status,
        coalesce(status IN {_ACTIVE} AND greatest(heartbeat_at, updated_at, lease_expires_at) >= TIMESTAMP '{NOW}' - INTERVAL 300 SECOND, false) AS fresh FROM f FULL JOIN j USING (recording_id))
      SELECT recording_id, CASE WHEN final THEN 'done' WHEN segments THEN 'correction' WHEN audio THEN 'stt' ELSE 'none' END AS next_stage,
        CASE WHEN fresh THEN 'skip_active' WHEN final THEN 'already_final' WHEN NOT audio THEN 'unrecoverable' WHEN coalesce(status IN ('failed', 'cancelled'), false) THEN 'skip_terminal' ELSE 'enqueue_resume' END AS action FROM x""",
    "event_profile": f"WITH {_E} SELECT job_id, count(*) FILTER (event = 'claim') AS n_claims, count(*) FILTER (event = 'failure') AS n_failures, count(*) FILTER (event = 'completed') AS n_completed, count(*) FILTER (event = 'claim') >= 2 AND count(*) FILTER (event = 'failure') >= 1 AND count(*) FILTER (event = 'completed') >= 1 AS recovered FROM e WHERE event <> 'heartbeat' GROUP BY 1",
    "fenced_updates": f"""WITH {_J}, u AS (SELECT e.job_id, event_id AS seq, 'w' || (event_id % 3) = claimed_by AND 't' || (event_id % 4) = claim_token AND NOT cancel_requested AND is_current AS own FROM e JOIN c USING (job_id) WHERE event = 'completed')
      SELECT job_id, seq, CASE WHEN NOT own THEN 'ownership_lost' WHEN seq = max(seq) FILTER (own) OVER (PARTITION BY job_id) THEN 'applied' ELSE 'overwritten' END AS verdict FROM u""",
    "peak_concurrency": f"""WITH {_E}, s AS (SELECT job_id AS key, ts AS moment, 1 AS d FROM e WHERE event = 'claim' UNION ALL SELECT job_id, ts + INTERVAL 1 DAY, -1 FROM e WHERE event = 'claim')
      SELECT key, CAST(max(n) AS BIGINT) AS peak FROM (SELECT key, sum(d) OVER (PARTITION BY key ORDER BY moment, d ROWS UNBOUNDED PRECEDING) AS n FROM s) GROUP BY 1""",
    "lease_episodes": f"""WITH {_E}, x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS gap FROM e),
      y AS (SELECT *, sum(gap) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1 AS episode FROM x) SELECT job_id, CAST(episode AS BIGINT) AS episode, count(*) AS n FROM y GROUP BY 1, 2""",
    "progress_changes": f"WITH {_E} SELECT job_id, event_id, event FROM (SELECT *, lag(event) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before FROM e) WHERE event IS DISTINCT FROM before",
    "live_only": f"WITH {_J} SELECT job_id, status FROM j WHERE recording_id NOT IN (SELECT recording_id FROM q)",
    "tombstone_state": f"WITH {_J} SELECT recording_id, arg_max(delete_state, (requested_at, seq)) AS delete_state, arg_max(reason, (requested_at, seq)) FILTER (reason IS NOT NULL) AS reason, min(requested_at) AS requested_at, count(*) AS n_requests FROM q GROUP BY 1",
    "file_refs": f"WITH {_R} SELECT p_partkey AS file_id, count(*) FILTER (active) AS n_live FROM part LEFT JOIN r ON file_id = p_partkey GROUP BY 1",
    "purge_plan": f"""WITH {_R}, n AS (SELECT file_id, count(*) FILTER (active AND generation = 1 AND role = 'note') AS n FROM r GROUP BY 1), i AS (SELECT DISTINCT recording_id AS purge_id, file_id FROM r)
      SELECT purge_id, count(*) AS n_files, count(*) FILTER (coalesce(n, 0) = 0) AS n_purgeable, bool_and(coalesce(n, 0) = 0) AS ready FROM i LEFT JOIN n USING (file_id) GROUP BY 1""",
    "carry_forward": f"""WITH {_R}, x AS (SELECT r.*, active AND generation = current_generation AS now FROM r JOIN o USING (recording_id))
      SELECT file_id, recording_id, generation, role, active AND NOT now AS active FROM x UNION ALL SELECT file_id, recording_id, generation + 1, role, true FROM x WHERE now AND role <> 'canonical'""",
    "register_artifacts": f"""WITH {_R}, old AS (SELECT * FROM r WHERE NOT active AND file_id % 2 = 0)
      SELECT DISTINCT file_id, recording_id, generation, role FROM r JOIN o USING (recording_id) WHERE active AND role IN ('audio', 'note') AND generation = current_generation
        AND (file_id, recording_id, generation, role) NOT IN (SELECT file_id, recording_id, generation, role FROM old) AND file_id NOT IN (SELECT file_id FROM old WHERE role = 'canonical')""",
    "reference_scan": f"WITH {_M} SELECT * FROM m",
    "safe_delete": f"WITH {_J}, {_M} SELECT recording_id FROM j WHERE CAST(recording_id AS VARCHAR) NOT IN (SELECT recording_id FROM m) AND (recording_id % 4 = 1 OR recording_id NOT IN (SELECT recording_id FROM a WHERE role NOT IN ('audio', 'segments')))",
    "upload_verdicts": "SELECT o_orderkey AS upload_id, CASE WHEN o_orderkey % 4 = 2 THEN 'bad_type' WHEN floor(o_totalprice * 3000) > 1073741824 THEN 'too_large' WHEN floor(o_totalprice * 3000) <= 0 THEN 'empty' ELSE 'accepted' END AS verdict FROM orders",
    "ingest_once": "SELECT upload_id, client_key FROM (SELECT o_orderkey AS upload_id, o_custkey AS client_key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) WHERE n = 1",
    "archive_verify": "SELECT o_orderkey AS recording_id, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'size_differs' WHEN o_orderkey % 5 = 0 THEN 'md5_differs' ELSE 'ok' END AS verdict FROM orders",
    "archive_keys": "SELECT CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y/%m') ELSE 'unknown' END AS archive_key, count(*) AS n FROM orders GROUP BY 1",
    "stt_case_hits": f"WITH {_H} SELECT * FROM hits",
    "stt_report": f"WITH {_H} SELECT coalesce(model, 'all') AS model, count(*) AS n_cases, CAST(sum(n_must) AS BIGINT) AS n_must, CAST(sum(n_hits) AS BIGINT) AS n_hits, CAST(sum(n_bad) AS BIGINT) AS n_bad, CASE WHEN sum(n_must) > 0 THEN CAST(sum(n_hits) * 1000 // sum(n_must) AS BIGINT) END AS hit_permille FROM hits GROUP BY ROLLUP (model)",
}
_STATUS = f"""{SQL["purge_plan"].replace("SELECT purge_id, count(*)", ", p AS (SELECT purge_id, count(*)", 1)}), t AS (
    SELECT p.purge_id, CASE WHEN NOT ready THEN 'blocked' WHEN p.purge_id % 5 = 0 THEN 'pending' WHEN p.purge_id % 3 <> 0 THEN 'done' WHEN p.purge_id % 2 = 0 THEN 'failed' ELSE 'pending' END AS server, CASE WHEN p.purge_id % 5 <> 0 AND p.purge_id % 4 <> 0 THEN 'done' ELSE 'pending' END AS device FROM p)"""
SQL["purge_status"] = f"{_STATUS} SELECT *, CASE WHEN server = 'blocked' THEN 'blocked' WHEN server = 'done' AND device = 'done' THEN 'done' WHEN server = 'failed' THEN 'failed' ELSE 'pending' END AS overall FROM t"
SQL["device_pending"] = f"{_STATUS} SELECT purge_id FROM t WHERE server = 'done' AND device = 'pending'"
SQL["stt_seconds"] = f"""WITH r AS ({SQL["stt_report"]}), t AS (
      SELECT coalesce(source, 'all') AS model, CAST(sum(n_chars // 500 + 1) AS BIGINT) AS seconds, max(n_chars // 500 + 1) AS slowest_sec,
        CAST(sum(n_chars // 500 + 1) FILTER (doc_id % 4 <> 1) * 1000 // sum(n_chars // 15 + 1) FILTER (doc_id % 4 <> 1) AS BIGINT) AS real_time_permille FROM documents GROUP BY ROLLUP (source))
      SELECT r.*, seconds, slowest_sec, real_time_permille FROM r JOIN t USING (model)"""
