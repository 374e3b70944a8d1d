"""Queries over the list of recordings, model outputs and notes, on shapes derived from the given tables.

Shapes are written once, in expressions that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recordings as X
from ..functions import text as W
from ..operators import chunking as C
from ..operators import outputs as O
from ..operators import records as R
from ..operators import segments as S
from .shapes import LONG, STRIP, long_segments, short_segments, table

_DAY = "lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')"
_RECORDED = f"CASE doc_id % 6 WHEN 0 THEN '2024-03-' || {_DAY} || ' 10:20:30' WHEN 1 THEN '2024-03-' || {_DAY} || ' 08:05' WHEN 2 THEN '2024-03-' || {_DAY} || 'T10:20:30+09:00' WHEN 3 THEN '2024-03-' || {_DAY} || 'T23:59:59Z' WHEN 4 THEN '' ELSE 'unknown' END"
_UPLOADED = "CASE WHEN doc_id % 12 = 4 THEN '2024-04-01 00:00:00' ELSE '' END"
_PREFIX = f"CASE WHEN doc_id % 2 = 0 THEN '2023-12-' || {_DAY} || '_talk' ELSE 'talk' END"


def _docs(spark, d, **columns):
    return table(spark, d, "documents").select("doc_id", *(F.expr(x).alias(n) for n, x in columns.items()))


def _pick(values, n):
    """The n-th of some texts, counted from 0, in either engine."""
    return "CASE " + n + " " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for k, v in enumerate(values)) + " END"


def recording_times(spark, d):
    rows = _docs(spark, d, r=_RECORDED, u=_UPLOADED, p=_PREFIX)
    at = X.recorded_at(F.col("r"), F.lit("1970-01-01 00:00:00").cast("timestamp"))
    return rows.select("doc_id", F.unix_seconds(at).alias("recorded_s"), X.date_key(F.col("r"), F.col("u"), F.col("p"), F.lit("700101")).alias("date_key"), X.date_label(F.col("r")).alias("label"))


STATUS = ["completed", "fast_ready", "failed", "retry_wait", "stt_running", "stt", "correction", "semantic_running", "rendering", "odd", ""]
STEPS = ["stt", "correction", "render", "reduce", "", "semantic", None]
_STATUS, _STEP = _pick(STATUS, "CAST(event_id % 11 AS INT)"), _pick(STEPS, "CAST(user_id % 7 AS INT)")


def content_states(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_STATUS).alias("s"), F.expr(_STEP).alias("p"))
    return rows.select("event_id", X.content_state(F.col("s"), F.col("p")).alias("state"))


MESSAGES = ["No such file or directory: ''ffmpeg''".replace("''", "'"), "moov atom not found", "Google said no", "HttpError 500", "Temporarily away", "ValidationError", "no audio, it is missing", "No such file x", "other", None]
_MESSAGE, _KIND = _pick(MESSAGES, "CAST(event_id % 10 AS INT)"), _pick(["deleted", "timeout"], "CAST(user_id % 9 AS INT)")


def error_classes(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_KIND).alias("k"), F.expr(_MESSAGE).alias("m"))
    return rows.select("event_id", X.error_class(F.col("k"), F.col("m")).alias("e")).select("event_id", "e.*")


NAMES = ["status.json", "x/fast/metadata.json", "stt_raw.json", "fast/transcript_raw.txt", "segments_clean.json", "fast/snapshot.txt", "transcript_clean.txt", "correction_chunks/a.json", "semantic_final.json", "Summary.md", "result.validated.json", "manifest.json", "audio.m4a"]
_PATH = "'/data/' || " + _pick(NAMES, "CAST((l_orderkey + l_linenumber) % 13 AS INT)")


def artifact_roles(spark, d):
    rows = table(spark, d, "lineitem").select(F.expr(_PATH).alias("path"))
    return rows.groupBy("path", X.artifact_role(F.col("path")).alias("role")).agg(F.count("*").alias("n"))


_SUMMARY = "CASE WHEN doc_id % 4 = 0 THEN '# Date: today' || chr(10) || '- ' || substring(text, 1, 40) END"
_CLEAN = "CASE WHEN doc_id % 7 <> 0 THEN substring(text, 11, 200) END"


def record_list(spark, d):
    rows = table(spark, d, "documents").withColumnRenamed("doc_id", "recording_id").withColumn("doc_id", F.col("recording_id"))
    pick = lambda **c: rows.where("recording_id % 5 <> 4").select("recording_id", *(F.expr(x).alias(n) for n, x in c.items()))
    meta = pick(title="CASE WHEN doc_id % 3 = 1 THEN ' Talk ' || CAST(doc_id AS STRING) ELSE 'untitled' END", recorded_at=_RECORDED)
    status = pick(status=_pick(["completed", "failed", "stt_running"], "CAST(doc_id % 4 AS INT)"), step="'stt'", human="doc_id % 11 = 0", final="doc_id % 3 = 0", fast="doc_id % 2 = 0")
    results = pick(result_title="CASE doc_id % 6 WHEN 0 THEN 'Title ' || CAST(doc_id AS STRING) WHEN 3 THEN 'meeting' END")
    texts = pick(summary=_SUMMARY, fast_text="substring(text, 1, 50)", clean_text=_CLEAN, raw_text="CAST(NULL AS STRING)")
    legacy = rows.where("recording_id % 5 IN (0, 4)").select("recording_id", F.lit("old talk").alias("title"), F.lit("2020-01-01 00:00").alias("recorded_at"))
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("recording_id"))
    return R.record_list(meta, status, results, texts, legacy, gone, ["Date", "Type"])


def page_slugs(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("t"))
    return rows.select("page_id", W.slug(F.col("t"), 30).alias("slug"), W.occurrences(F.col("t"), "e").alias("n_e"), F.length("t").cast("long").alias("n_chars"))


_LOG = "CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE CAST(doc_id % 50 AS STRING) || '.5 real   ' || CAST(doc_id % 40 AS STRING) || '.25 user  0.5 sys' || chr(10) || CAST(n_chars * 1000 AS STRING) || '  peak memory footprint' END"


def speed_figures(spark, d):
    rows = _docs(spark, d, t=_LOG, n="n_chars", s="doc_id % 10 * 30").select("doc_id", X.time_figures(F.col("t")).alias("f"), "s")
    rtf = F.round(X.real_time_factor(F.col("f.real"), F.col("s").cast("double")) * 10_000).cast("long")
    return rows.select("doc_id", (F.col("f.real") * 100).cast("long").alias("real_cs"), (F.col("f.user") * 100).cast("long").alias("user_cs"), "f.peak_bytes", rtf.alias("rtf_e4"))


def storage_preflight(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 1000).alias("source"), (F.col("o_orderkey") % 4 * 500).alias("total"), F.array(F.lit(125), F.lit(250)).alias("kept"))
    rows = rows.select("o_orderkey", X.storage_estimate(F.col("source"), F.col("total"), F.col("kept")).alias("e"))
    return rows.select("o_orderkey", "e.*", (F.col("e.required") <= 500_000_000).alias("ok"))


def redacted_texts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.split("text", "\n").alias("lines"))
    out = R.redacted(rows, ["example.com", "555-"])
    return out.select("doc_id", F.sha2("text", 256).alias("sha"), F.array_join("lines", "\n").eqNullSafe(F.col("text")).alias("same"))


FIXES = [("$$$", ""), ("the ", "teh "), ("teh ", "The "), ("###", " ?")]


def dictionary_fixes(spark, d):
    out = R.corrected_texts(table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), "text"), FIXES)
    return out.select("recording_id", F.sha2("text", 256).alias("sha"))


_ANSWER = """CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN '{"a": ' || CAST(doc_id AS STRING) || '}' WHEN 1 THEN 'session_id: 9' || chr(10) || '{"b": [1, 2]}' WHEN 2 THEN 'so:' || chr(10) || '```json' || chr(10) || '{"c": {"d": 1}}' || chr(10) || '```' || chr(10) || 'done }'
  WHEN 3 THEN 'it is {"e": {"f": "' || source || '"}} I think' WHEN 4 THEN 'no object here' ELSE 'broken { "g": }' END"""


def json_recovery(spark, d):
    return _docs(spark, d, t=_ANSWER).select("doc_id", O.recovered_json(F.col("t"), ["session_id:"]).alias("json"))


_RAW = """CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '["plain", "  "]' WHEN 1 THEN '[{"text": "told", "source_segment_ids": [3, 1, 3]}]' WHEN 2 THEN '[{"warning": "w"}, "s", {"summary": "z"}]' WHEN 3 THEN '[]' ELSE '[7, "x"]' END"""


def coerced_warnings(spark, d):
    return O.coerced_warnings(_docs(spark, d, raw=_RAW).withColumnRenamed("doc_id", "recording_id"))


_UNCERTAIN = """CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '[3, 1, 3]' WHEN 1 THEN '[{"index": 4, "reason": "noise"}, 2]' WHEN 2 THEN '[{"index": 5, "note": "cut"}, {"index": 6}]' ELSE NULL END"""


def repaired_results(spark, d):
    rows = _docs(spark, d, uncertain_json=_UNCERTAIN, note_type=_pick(["meeting", "speech", None], "CAST(doc_id % 3 AS INT)"), content_type=_pick(["idea", "talk"], "CAST(doc_id % 2 AS INT)"), text="text")
    words = F.transform(F.slice(F.split(F.coalesce("text", F.lit("")), "[ \n]+"), 1, 12), lambda w: F.concat(F.lit(" #"), w))
    return O.repaired_results(rows.select(F.col("doc_id").alias("recording_id"), "uncertain_json", "note_type", "content_type", words.alias("keywords")), ["the", "and", "of"])


RULES = [("text", "required", None), ("text", "max_length", 5000), ("text", "min_length", 100), ("lang", "enum", ["en", "de"]), ("source", "pattern", "^[a-m]"), ("words", "max_items", 300), ("words", "unique", None)]


def schema_violations(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"), "lang", "source", F.split("text", " ").alias("words"))
    return O.violations(rows, "doc_id", RULES)


FIELDS = ["topics", "key_points", "decisions", "action_items", "questions"]


def _fields(spark, d):
    """Items of all five fields: each segment one item."""
    i = F.col("seg_idx")
    field = F.element_at(F.array(*map(F.lit, FIELDS)), i % 5 + 1)
    return long_segments(spark, d).select("recording_id", F.floor(i / 20 + 1).cast("int").alias("chunk_no"), field.alias("field"), i.alias("pos"), F.substring("text", 1, 300).alias("text"), F.array(i + 1, i, i + 1).alias("source_segment_ids"))


def _ranked(spark, d):
    return _fields(spark, d).withColumn("rank", F.expr("CAST(pos DIV 5 + 1 AS INT)"))


def compact_items(spark, d):
    return O.compact_items(_fields(spark, d))


def reduce_findings(spark, d):
    n = F.col("recording_id")
    items = _fields(spark, d).withColumn("group_id", n).withColumn("source_segment_ids", F.when(n % 6 == 1, F.array().cast("array<int>")).when(n % 6 == 2, F.transform("source_segment_ids", lambda x: x + 7)).otherwise(F.array("pos")))
    outputs = table(spark, d, "documents").select(F.col("doc_id").alias("recording_id")).select(n.alias("group_id"), "recording_id", F.when(n % 10 != 3, n).alias("told_recording"), F.lit("h").alias("input_hash"), F.when(n % 7 == 3, "x").otherwise("h").alias("told_hash"), F.lit(2).alias("n_chunks"), F.when(n % 8 == 3, 3).otherwise(2).alias("told_chunks"))
    return O.reduce_findings(outputs, items, long_segments(spark, d).select("recording_id", "seg_idx"))


def _outputs(spark, d, edit):
    rows = _fields(spark, d).select("recording_id", "chunk_no").distinct().withColumn("group_no", F.expr("CAST((chunk_no + 1) DIV 2 AS INT)"))
    return rows.withColumn("output_hash", F.when(edit & (F.col("recording_id") % 4 == 1) & (F.col("chunk_no") == 1), "edited").otherwise(F.sha2(F.concat_ws(":", "recording_id", "chunk_no"), 256)))


def reduce_reuse(spark, d):
    old = O.reduce_hashes(_outputs(spark, d, F.lit(False)), "v1").where("recording_id % 5 <> 2")
    n = F.col("recording_id")
    known = old.select("recording_id", "group_no", "input_hash", F.lit("o").alias("output_hash"), F.when(n % 3 == 2, "p").otherwise("o").alias("actual_hash"))
    return O.reduce_reuse(O.reduce_hashes(_outputs(spark, d, F.lit(True)), "v1"), known)


CONTEXT = [("situation", "site visit", ["tion"]), ("situation", "call", ["heit"]), ("actors", "the team", ["que", "sch"]), ("place", "the office", ["ent"]), ("agenda", "first point", ["en "]), ("agenda", "second point", ["ion "]), ("agenda", "third point", ["la "]), ("warnings", "doubtful", ["###"])]
OBSERVED, HYPOTHESES = ["tion", "heit"], ["que", "en"]


def context_flags(spark, d):
    return O.context(_fields(spark, d), CONTEXT)


def _summaries(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("About "), "source")).otherwise("").alias("summary"))


def result_notes(spark, d):
    return O.notes(_ranked(spark, d), _summaries(spark, d), context_flags(spark, d))


def result_sections(spark, d):
    return O.note_sections(_ranked(spark, d).where("recording_id % 17 <> 3"), _summaries(spark, d), context_flags(spark, d).where("recording_id % 17 <> 3"), OBSERVED, HYPOTHESES)


WEAK = ["the", "and", "note"]


def candidate_phrases(spark, d):
    rows = _ranked(spark, d).where("field IN ('topics', 'key_points', 'decisions')")
    source = F.expr("CASE field WHEN 'key_points' THEN 1 WHEN 'topics' THEN 2 ELSE 3 END")
    return R.candidate_phrases(rows.select("recording_id", source.alias("source"), "pos", F.substring("text", 1, 60).alias("text")), WEAK)


def short_keywords(spark, d):
    words = F.transform(F.slice(F.split(F.coalesce("text", F.lit("")), "[ \n]+"), 1, 15), lambda w: F.concat(F.lit("#"), w))
    return R.short_keywords(table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), words.alias("keywords")), ["the", "and"], {"that": "THAT"})


def title_phrases(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), F.lit(0).alias("pos"), F.substring("text", 1, 200).alias("text"))
    return R.title_phrases(rows, WEAK)


def short_titles(spark, d):
    kw = short_keywords(spark, d).withColumn("keywords", F.slice("keywords", 1, F.expr("CAST(recording_id % 3 AS INT)")))
    first = title_phrases(spark, d).where("rank = 1").select("recording_id", "phrase")
    rows = _docs(spark, d, title="CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN substring(text, 1, 12) WHEN 1 THEN 'untitled' WHEN 2 THEN '2024-03-05 talk' ELSE substring(text, 1, 21) END", status="CASE WHEN doc_id % 2 = 0 THEN 'Done' ELSE 'stt' END").withColumnRenamed("doc_id", "recording_id")
    rows = rows.join(kw, "recording_id").join(first, "recording_id", "left").withColumn("phrase", F.when(F.col("recording_id") % 5 != 0, F.col("phrase")))
    return R.short_titles(rows)


TITLES = [("A first kind", ["tion"], ["heit", "que"], None), ("A second kind", ["sch"], [], 2000), ("A third kind", ["ing", "la "], [], None)]
TOPICS = [("both", ["la ", "que"], []), ("either", [], ["ung", "thing"])]


def rule_titles(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), "text", F.col("n_chars").alias("duration_sec"), F.col("source").alias("fallback"))
    return R.rule_titles(rows, TITLES, table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("recording_id"), F.lit("by hand").alias("title")))


def topic_titles(spark, d):
    return R.topic_titles(table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), "text"), TOPICS)


def share_texts(spark, d):
    return R.share_texts(_docs(spark, d, title="source", line="substring(text, 1, 30)", points="'- ' || lang", summary="substring(text, 1, 50)", recorded_at=_RECORDED).withColumnRenamed("doc_id", "recording_id"))


def _renames(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("current_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("o"), (F.col("o_orderkey") % 500).cast("string")).alias("old_id"))


def alias_history(spark, d):
    return R.alias_history(_renames(spark, d))


def alias_lookup(spark, d):
    asked = table(spark, d, "customer").select(F.explode(F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("o"), F.col("c_custkey").cast("string")))).alias("id"))
    return R.resolve_ids(asked, R.alias_history(_renames(spark, d)))


def segment_fingerprints(spark, d):
    return R.segment_fingerprints(short_segments(spark, d).withColumn("speaker", F.when(F.col("seg_idx") % 3 == 0, "").otherwise(F.col("speaker"))))


def snapshot_digests(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("recording_id"), F.concat(F.lit("file"), F.col("l_linenumber").cast("string")).alias("name"), F.when(F.col("l_linenumber") != 3, F.md5(F.col("l_partkey").cast("string").cast("binary"))).alias("hash"))
    return R.snapshot_digests(rows)


def recognised_segments(spark, d):
    """Speech recognition results, nested again from the conversations, in two layouts."""
    piece = F.struct(F.when(F.col("turn") % 4 != 3, F.col("text")).otherwise("  ").alias("text"), F.when(F.col("conv_id") % 2 == 0, F.col("turn") * 1.5).alias("start"), F.when((F.col("conv_id") % 2 == 0) & (F.col("turn") % 2 == 0), F.col("turn") * 1.5 + 1).alias("end"), F.struct((F.col("turn") * 700).alias("from"), (F.col("turn") * 700 + 600).alias("to")).alias("offsets"))
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", piece.alias("s")))), lambda x: x["s"]).alias("s"))
    raw = nested.select(F.col("conv_id").alias("recording_id"), F.when(F.col("conv_id") % 3 != 0, F.col("s")).alias("transcription"), F.col("s").alias("segments"))
    return S.from_recogniser(raw).select("recording_id", "seg_idx", "start_ms", "end_ms", "text")


def index_ranges(spark, d):
    s = long_segments(spark, d)
    twice = s.select("recording_id", "seg_idx", F.lit(0).alias("pos"), "text").unionByName(s.where("seg_idx % 5 = 2").select("recording_id", "seg_idx", F.lit(1).alias("pos"), F.concat(F.lit("later "), "text").alias("text")))
    ranges = table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), F.lit(1).alias("chunk_no"), (F.col("doc_id") % 3).cast("int").alias("low"), (F.col("doc_id") % 3 + 6).cast("int").alias("high"))
    return C.index_ranges(ranges, twice)


QUERIES = {
    f.__name__: f
    for f in (recording_times, content_states, error_classes, artifact_roles, record_list, page_slugs, speed_figures, storage_preflight, redacted_texts, dictionary_fixes, json_recovery, coerced_warnings, repaired_results, schema_violations, compact_items, reduce_findings, reduce_reuse)
    + (context_flags, result_notes, result_sections, candidate_phrases, short_keywords, title_phrases, short_titles, rule_titles, topic_titles, share_texts, alias_history, alias_lookup, segment_fingerprints, snapshot_digests, recognised_segments, index_ranges)
}

_FIELDS = f"""{LONG}, f AS (SELECT recording_id, CAST(seg_idx // 20 + 1 AS INTEGER) AS chunk_no, {FIELDS}[seg_idx % 5 + 1] AS field, seg_idx AS pos, substring(text, 1, 300) AS text, [seg_idx + 1, seg_idx, seg_idx + 1] AS source_segment_ids, CAST(seg_idx // 5 + 1 AS INTEGER) AS rank FROM long_segments)"""
_any = lambda c, cues: "(" + " OR ".join(f"contains({c}, '{x}')" for x in cues) + ")"
_CTX = ", g AS (SELECT recording_id, " + ", ".join(f"bool_or({_any('text', cues)}) AS r{n}" for n, (_, _, cues) in enumerate(CONTEXT)) + " FROM f GROUP BY 1), c AS (SELECT recording_id, " + ", ".join(
    "CASE " + " ".join(f"WHEN r{n} THEN '{v}'" for n, (s, v, _) in enumerate(CONTEXT) if s == slot) + f" ELSE '' END AS {slot}" for slot in ("situation", "actors", "place")
) + ", " + ", ".join("list_filter([" + ", ".join(f"CASE WHEN r{n} THEN '{v}' END" for n, (s, v, _) in enumerate(CONTEXT) if s == slot) + f"], lambda x: x IS NOT NULL) AS {slot}" for slot in ("agenda", "warnings")) + " FROM g)"
_first = lambda f, n, w="": f"coalesce(list(t ORDER BY rank) FILTER (field = '{f}' AND t <> ''), [])[1:{n}] AS {f}"
_MADE = f""", y AS (SELECT *, {STRIP.format('text')} AS t FROM f), l AS (SELECT recording_id, {_first('topics', 8)}, {_first('key_points', 12)}, {_first('decisions', 12)}, {_first('action_items', 12)}, {_first('questions', 10)} FROM y GROUP BY 1),
  s AS (SELECT doc_id AS recording_id, CASE WHEN doc_id % 3 = 0 THEN 'About ' || source ELSE '' END AS summary FROM documents)"""
_JOINED = "s LEFT JOIN l USING (recording_id) LEFT JOIN c USING (recording_id)"
_none = lambda c: f"coalesce({c}, CAST([] AS VARCHAR[]))"
_NORM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]', '', 'g')"
_CLEANED = r"regexp_replace(substring(array_to_string(string_split(regexp_replace(trim(regexp_replace(regexp_replace({}, '[`#*_\[\]{{}}()<>|]', ' ', 'g'), '\s+', ' ', 'g')), '^[ .,:;·\-_/]+|[ .,:;·\-_/]+$', '', 'g'), ' ')[1:6], ' '), 1, 36), '^[ .,:;·\-_]+|[ .,:;·\-_]+$', '', 'g')"
_TOKEN = r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({}, '^#+', ''), '[`#*_\[\]{{}}()<>|]', ' ', 'g'), '\s+', ' ', 'g')), '^[ .,:;·\-_]+|[ .,:;·\-_]+$', '', 'g')"
_BAD = r"regexp_matches({}, '^\d{{4}}[.\-/]\d{{1,2}}[.\-/]\d{{1,2}}|(?i)^topic\s*\d+$')"
_KW = rf"""kw0 AS (SELECT doc_id AS recording_id, w, i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[ \n]+')[1:15] AS ws, unnest(range(1, len(ws) + 1)) AS i, ws[i] AS w FROM documents)),
  kw1 AS (SELECT recording_id, i, CASE WHEN lower({STRIP.format('w')}) = 'that' THEN 'THAT' ELSE {_TOKEN.format('w')} END AS word FROM kw0),
  kw2 AS (SELECT recording_id, arg_min(word, i) AS word, min(i) AS i FROM kw1 WHERE word <> '' AND length(word) <= 12 AND len(string_split(word, ' ')) <= 2 AND {_NORM.format('word')} NOT IN ('the', 'and') AND NOT {_BAD.format('word')} GROUP BY recording_id, {_NORM.format('word')}),
  kw AS (SELECT doc_id AS recording_id, coalesce(k, [])[1:4] AS keywords FROM documents LEFT JOIN (SELECT recording_id, list(word ORDER BY i) AS k FROM kw2 GROUP BY 1) z ON z.recording_id = doc_id)"""
_TP = rf"""tp0 AS (SELECT doc_id AS recording_id, string_split_regex(coalesce(substring(text, 1, 200), ''), '[,，;；·/]|\s+-\s+') AS ps, unnest(range(1, len(ps) + 1)) AS i FROM documents),
  tp1 AS (SELECT recording_id, i, {_TOKEN.format(_CLEANED.format('ps[i]'))} AS word FROM tp0),
  tp2 AS (SELECT recording_id, i, CASE WHEN length(word) > 18 THEN CASE WHEN contains(word, ' ') THEN array_to_string(string_split(word, ' ')[1:3], ' ') END ELSE word END AS word FROM tp1 WHERE length(word) >= 2 AND word NOT IN {tuple(WEAK)} AND NOT {_BAD.format('word')}),
  tp3 AS (SELECT recording_id, arg_min(word, i) AS phrase, min(i) AS i FROM tp2 WHERE length(word) <= 18 AND {_NORM.format('word')} NOT IN {tuple(R.GENERIC)} GROUP BY recording_id, {_NORM.format('word')}),
  tp AS (SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY i) AS INTEGER) AS rank, phrase FROM tp3)"""
_EDGE = r"regexp_replace({}, '^[#\-` ]+|[#\-` ]+$', '', 'g')"
_ALIAS = "h AS (SELECT current_id, list(old_id ORDER BY seq) AS old_ids FROM (SELECT 'c' || o_custkey AS current_id, 'o' || (o_orderkey % 500) AS old_id, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2) GROUP BY 1)"
_like = lambda *xs: " OR ".join(xs)
SQL = {
    "recording_times": f"""WITH m AS (SELECT doc_id, {_RECORDED} AS r, {_DAY} AS d FROM documents)
      SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CAST(epoch(try_strptime(r, '%Y-%m-%d %H:%M:%S')) AS BIGINT) - 32400 WHEN 1 THEN CAST(epoch(try_strptime(r, '%Y-%m-%d %H:%M')) AS BIGINT) - 32400
        WHEN 2 THEN CAST(epoch(try_strptime(r[1:19], '%Y-%m-%dT%H:%M:%S')) AS BIGINT) - 32400 WHEN 3 THEN CAST(epoch(try_strptime(r[1:19], '%Y-%m-%dT%H:%M:%S')) AS BIGINT) ELSE 0 END AS recorded_s,
        CASE WHEN doc_id % 6 < 2 THEN '2403' || d WHEN doc_id % 12 = 4 THEN '240401' WHEN doc_id % 2 = 0 THEN '2312' || d ELSE '700101' END AS date_key,
        CASE doc_id % 6 WHEN 0 THEN '3/' || (doc_id % 28 + 1) || ' 10:20' WHEN 1 THEN '3/' || (doc_id % 28 + 1) || ' 08:05' WHEN 2 THEN '3/' || (doc_id % 28 + 1) || ' 10:20' WHEN 3 THEN '3/' || (doc_id % 28 + 1) || ' 23:59' ELSE '' END AS label FROM m""",
    "content_states": f"""WITH m AS (SELECT event_id, coalesce({_STATUS}, '') AS s, coalesce({_STEP}, '') AS p FROM events)
      SELECT event_id, CASE WHEN s = 'completed' THEN 'FINAL_READY' WHEN s IN ('fast_ready', 'failed', 'retry_wait') THEN upper(s) WHEN s = 'stt_running' THEN 'STT_RUNNING' WHEN p = 'stt' OR s LIKE 'stt%' THEN 'STT_DONE'
        WHEN p = 'correction' OR s LIKE 'correction%' THEN 'CORRECTION_DONE' WHEN p = 'semantic' OR s LIKE 'semantic%' THEN 'SEMANTIC_RUNNING' WHEN p = 'reduce' THEN 'REDUCE_RUNNING' WHEN p = 'render' OR s = 'rendering' THEN 'RENDERING' WHEN s = '' THEN 'UNKNOWN' ELSE upper(s) END AS state FROM m""",
    "error_classes": f"""WITH m AS (SELECT event_id, {_KIND} AS k, {_MESSAGE} AS m FROM events), c AS (SELECT event_id, CASE WHEN k = 'deleted' THEN 'recording_deleted' WHEN k = 'timeout' THEN 'timeout' WHEN event_id % 10 = 0 THEN 'stt_failed_missing_ffmpeg' WHEN m LIKE 'moov%' THEN 'stt_failed_audio_invalid'
      WHEN m LIKE 'Google%' OR m LIKE 'Http%' THEN 'cloud_upload_failed' WHEN m LIKE 'Temp%' THEN 'temporary_worker_error' WHEN m LIKE 'Valid%' THEN 'json_invalid' WHEN m LIKE '%missing' OR m LIKE 'No such%' THEN 'permanent_file_error' ELSE 'worker_error' END AS code FROM m)
      SELECT event_id, code, code NOT IN ('recording_deleted', 'stt_failed_audio_invalid', 'permanent_file_error') AS retryable FROM c""",
    "artifact_roles": f"""WITH m AS (SELECT {_PATH} AS path FROM lineitem) SELECT path, CASE WHEN path LIKE '%/status.json' THEN 'STATUS' WHEN path LIKE '%/metadata.json' THEN 'METADATA' WHEN path LIKE '%stt_raw%' THEN 'RAW_STT' WHEN path LIKE '%transcript_raw%' THEN 'TRANSCRIPT_RAW'
      WHEN path LIKE '%segments!_%' ESCAPE '!' THEN 'SEGMENTS' WHEN path LIKE '%/fast/%' THEN 'FAST' WHEN path LIKE '%transcript_clean%' OR path LIKE '%correction!_%' ESCAPE '!' THEN 'CORRECTION' WHEN path LIKE '%semantic%' THEN 'SEMANTIC' WHEN path LIKE '%Summary.md' THEN 'SUMMARY' WHEN path LIKE '%result.%' THEN 'FINAL' WHEN path LIKE '%manifest%' THEN 'CHECKPOINT' ELSE 'JOB_ARTIFACT' END AS role, count(*) AS n FROM m GROUP BY 1, 2""",
    "record_list": rf"""WITH m AS (SELECT doc_id, doc_id AS recording_id, {_RECORDED} AS r, CASE WHEN doc_id % 11 = 0 THEN 'HUMAN' WHEN doc_id % 3 = 0 THEN 'FINAL' WHEN doc_id % 2 = 0 THEN 'FAST' ELSE 'PROCESSING' END AS v, {_SUMMARY} AS summary, {_CLEAN} AS clean, substring(text, 1, 50) AS fast FROM documents),
      n AS (SELECT *, coalesce(substring(list_filter(list_transform(string_split(summary, chr(10)), lambda x: {_EDGE.format('x')}), lambda x: x <> '' AND NOT starts_with(x, 'Date') AND NOT starts_with(x, 'Type'))[1], 1, 120),
        CASE WHEN v = 'FAST' THEN nullif(replace({STRIP.format('fast')}, chr(10), ' '), '') END, substring(nullif(replace({STRIP.format('clean')}, chr(10), ' '), ''), 1, 120), '') AS snippet FROM m),
      t AS (SELECT *, trim(substring(replace(replace(r, 'T', ' '), '+09:00', ''), 1, 16) || ' ' || coalesce(nullif(substring(trim(regexp_replace(snippet, '\s+', ' ', 'g')), 1, 28), ''), 'recording in work')) AS dated FROM n),
      a AS (SELECT recording_id, CASE WHEN v = 'FINAL' AND doc_id % 6 = 0 THEN 'Title ' || doc_id WHEN doc_id % 3 = 1 THEN 'Talk ' || doc_id ELSE dated END AS title, r AS recorded_at,
        CASE doc_id % 4 WHEN 0 THEN 'FINAL_READY' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'STT_RUNNING' ELSE 'STT_DONE' END AS state, v AS display_version, snippet, 'new' AS layout FROM t WHERE doc_id % 5 <> 4
        UNION ALL SELECT doc_id, 'old talk', '2020-01-01 00:00', NULL, NULL, NULL, 'legacy' FROM documents WHERE doc_id % 5 = 4)
      SELECT * FROM a WHERE recording_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "page_slugs": r"""WITH m AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages) SELECT page_id, coalesce(nullif(substring(regexp_replace(regexp_replace(t, '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30), ''), 'note') AS slug,
      CAST(len(string_split(t, 'e')) - 1 AS BIGINT) AS n_e, CAST(length(t) AS BIGINT) AS n_chars FROM m""",
    "speed_figures": """WITH m AS (SELECT doc_id, doc_id % 3 <> 0 AS told, doc_id % 10 * 30 AS s, n_chars FROM documents) SELECT doc_id, CASE WHEN told THEN CAST(doc_id % 50 * 100 + 50 AS BIGINT) END AS real_cs, CASE WHEN told THEN CAST(doc_id % 40 * 100 + 25 AS BIGINT) END AS user_cs,
      CASE WHEN told THEN CAST(n_chars * 1000 AS BIGINT) END AS peak_bytes, CASE WHEN told AND s > 0 THEN CAST(round((doc_id % 50 + 0.5) * 10000 / s) AS BIGINT) END AS rtf_e4 FROM m""",
    "storage_preflight": """WITH m AS (SELECT o_orderkey, CAST(floor(o_totalprice * 1000) AS BIGINT) AS src, o_orderkey % 4 * 500 AS total FROM orders), e AS (SELECT o_orderkey, CASE WHEN src > 0 AND total > 0 THEN greatest(1, CAST(floor(CAST(src AS DOUBLE) * (CAST(375 AS DOUBLE) / total) * CAST(1.10 AS DOUBLE)) AS BIGINT)) END AS output FROM m),
      x AS (SELECT *, CASE WHEN output IS NOT NULL THEN greatest(8388608, CAST(floor(output * CAST(0.05 AS DOUBLE)) AS BIGINT)) END AS overhead, CASE WHEN output IS NOT NULL THEN greatest(67108864, CAST(floor(output * CAST(0.10 AS DOUBLE)) AS BIGINT)) END AS margin FROM e)
      SELECT o_orderkey, output, overhead, margin, output + overhead + margin AS required, output + overhead + margin <= 500000000 AS ok FROM x""",
    "redacted_texts": "SELECT doc_id, sha256(replace(replace(text, 'example.com', '***REDACTED***'), '555-', '***REDACTED***')) AS sha, true AS same FROM documents",
    "dictionary_fixes": rf"""WITH m AS (SELECT doc_id, {"replace(" * len(FIXES)}coalesce(text, ''){"".join(f", '{a}', '{b}')" for a, b in FIXES)} AS t FROM documents)
      SELECT doc_id AS recording_id, sha256({STRIP.format(r"regexp_replace(replace(replace(regexp_replace(t, '\s+', ' ', 'g'), ' ?', '?'), ' .', '.'), '([.?!])\s+', '\1' || chr(10), 'g')")}) AS sha FROM m""",
    "json_recovery": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"a": ' || doc_id || '}' WHEN 1 THEN '{"b": [1, 2]}' WHEN 2 THEN '{"c": {"d": 1}}' WHEN 3 THEN '{"e": {"f": "' || source || '"}}' END AS json FROM documents""",
    "coerced_warnings": """SELECT doc_id AS recording_id, CASE doc_id % 5 WHEN 0 THEN ['plain'] WHEN 1 THEN ['told (source_segment_ids=[1, 3])'] WHEN 2 THEN ['w', 's', 'z'] WHEN 3 THEN [] ELSE ['7', 'x'] END AS warnings, CAST(CASE doc_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS BIGINT) AS n_changed FROM documents""",
    "repaired_results": rf"""WITH k AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[ \n]+')[1:12] AS ws FROM documents), e AS (SELECT doc_id, i, ltrim({STRIP.format('ws[i]')}, '#') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM k)),
      u AS (SELECT doc_id, w, min(i) AS i FROM e WHERE w <> '' AND w NOT IN ('the', 'and', 'of') GROUP BY 1, 2), g AS (SELECT doc_id, list(w ORDER BY i)[1:8] AS keywords FROM u GROUP BY 1)
      SELECT doc_id AS recording_id, CAST(CASE doc_id % 4 WHEN 0 THEN [1, 3] WHEN 1 THEN [2, 4] WHEN 2 THEN [5, 6] ELSE [] END AS INTEGER[]) AS uncertain, CASE doc_id % 4 WHEN 1 THEN ['segment 4: noise'] WHEN 2 THEN ['segment 5: cut'] ELSE [] END AS reasons,
        CASE WHEN doc_id % 3 = 0 THEN 'meeting' WHEN doc_id % 2 = 0 THEN 'idea' ELSE 'other' END AS note_type, coalesce(keywords, []) AS keywords FROM documents LEFT JOIN g USING (doc_id)""",
    "schema_violations": """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN text END AS t, lang, source, string_split(text, ' ') AS w FROM documents)
      SELECT doc_id, list_filter([CASE WHEN lang NOT IN ('en', 'de') THEN 'lang:enum' END, CASE WHEN NOT regexp_matches(source, '^[a-m]') THEN 'source:pattern' END, CASE WHEN length(t) > 5000 THEN 'text:max_length' END, CASE WHEN length(t) < 100 THEN 'text:min_length' END,
        CASE WHEN t IS NULL THEN 'text:required' END, CASE WHEN len(w) > 300 THEN 'words:max_items' END, CASE WHEN len(list_distinct(w)) < len(w) THEN 'words:unique' END], lambda x: x IS NOT NULL) AS violations FROM m""",
    "compact_items": f"""WITH {_FIELDS}, p AS (SELECT *, row_number() OVER (PARTITION BY recording_id, chunk_no, field ORDER BY pos) AS n FROM f)
      SELECT recording_id, chunk_no, field, pos, substring(text, 1, 260) AS text, [pos, pos + 1] AS source_segment_ids FROM p WHERE n <= CASE field WHEN 'topics' THEN 8 WHEN 'key_points' THEN 10 ELSE 4 END AND trim(text) <> ''""",
    "reduce_findings": f"""WITH {_FIELDS}, k AS (SELECT recording_id, max(seg_idx) AS top FROM long_segments GROUP BY 1)
      SELECT doc_id AS group_id, 'recording_mismatch' AS kind, '' AS field FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT doc_id, 'hash_mismatch', '' FROM documents WHERE doc_id % 7 = 3 UNION ALL SELECT doc_id, 'count_mismatch', '' FROM documents WHERE doc_id % 8 = 3
      UNION ALL SELECT DISTINCT recording_id, 'missing_ids', field FROM f WHERE recording_id % 6 = 1 UNION ALL SELECT DISTINCT recording_id, 'unknown_ids', field FROM f JOIN k USING (recording_id) WHERE recording_id % 6 = 2 AND pos + 8 > top""",
    "reduce_reuse": f"""WITH {_FIELDS}, o AS (SELECT DISTINCT recording_id, CAST((chunk_no + 1) // 2 AS INTEGER) AS group_no FROM f)
      SELECT recording_id, group_no, CASE WHEN recording_id % 5 = 2 THEN 'new' WHEN recording_id % 4 = 1 AND group_no = 1 THEN 'input_changed' WHEN recording_id % 3 = 2 THEN 'output_changed' ELSE 'reuse' END AS verdict FROM o""",
    "context_flags": f"WITH {_FIELDS} {_CTX} SELECT * FROM c",
    "result_notes": rf"""WITH {_FIELDS} {_CTX} {_MADE}, j AS (SELECT recording_id, summary, {_none('topics')} AS topics, {_none('key_points')} AS key_points, {_none('decisions')} AS decisions, {_none('action_items')} AS action_items, {_none('agenda')} AS agenda, {_none('warnings')} AS warnings, coalesce(situation, '') AS situation, coalesce(actors, '') AS actors, coalesce(place, '') AS place FROM {_JOINED}),
      k AS (SELECT *, CASE WHEN actors <> '' AND situation <> '' AND len(agenda) > 0 THEN 'actors_situation_agenda' WHEN place <> '' AND len(agenda) > 0 THEN 'place_situation_agenda' ELSE 'topic' END AS reason FROM j),
      t AS (SELECT *, substring(CASE reason WHEN 'actors_situation_agenda' THEN actors || ' ' || situation || '-' || array_to_string(agenda[1:3], '·') WHEN 'place_situation_agenda' THEN place || ' ' || situation || '-' || array_to_string(agenda[1:2], '·') ELSE coalesce(topics[1], key_points[1], 'voice note') END, 1, 80) AS title FROM k),
      u AS (SELECT *, coalesce(nullif(summary, ''), title) AS line, list_concat(CASE WHEN len(agenda) > 0 THEN ['agenda: ' || array_to_string(agenda[1:4], ', ')] ELSE [] END, list_concat(decisions, list_concat(action_items, key_points)))[1:10] AS fl FROM t)
      SELECT recording_id, title, reason, coalesce(nullif(substring(regexp_replace(regexp_replace(title, '[^\p{{L}}\p{{N}}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'note') AS slug, list_transform(topics, lambda x: substring(x, 1, 40)) AS keywords, line,
        CASE WHEN len(key_points) > 0 THEN key_points[1:8] ELSE [line] END AS core, CASE WHEN len(fl) > 0 THEN fl ELSE [line] END AS flow, warnings FROM u""",
    "result_sections": f"""WITH {_FIELDS} {_CTX} {_MADE}, l2 AS (SELECT * FROM l WHERE recording_id % 17 <> 3), c2 AS (SELECT * FROM c WHERE recording_id % 17 <> 3), j AS (SELECT recording_id, summary, {_none('key_points')} AS k, {_none('decisions')} AS d, {_none('action_items')} AS a, {_none('questions')} AS q, situation, actors, place, {_none('agenda')} AS agenda FROM s LEFT JOIN l2 USING (recording_id) LEFT JOIN c2 USING (recording_id)),
      p AS (SELECT recording_id, summary, list_filter([{{'h': 'identity', 'i': list_filter([CASE WHEN situation <> '' THEN 'situation: ' || situation END, CASE WHEN actors <> '' THEN 'actors: ' || actors END, CASE WHEN place <> '' THEN 'place: ' || place END, CASE WHEN len(agenda) > 0 THEN 'agenda: ' || array_to_string(agenda[1:4], ', ') END], lambda x: x IS NOT NULL)}},
        {{'h': 'observed', 'i': list_filter(k, lambda x: {_any('x', OBSERVED)})[1:8]}}, {{'h': 'hypotheses', 'i': list_filter(k, lambda x: {_any('x', HYPOTHESES)})[1:8]}}, {{'h': 'key points', 'i': list_filter(k, lambda x: NOT {_any('x', OBSERVED + HYPOTHESES)})[1:10]}},
        {{'h': 'decisions', 'i': d}}, {{'h': 'next actions', 'i': a}}, {{'h': 'questions', 'i': q}}], lambda z: len(z.i) > 0) AS s FROM j),
      w AS (SELECT recording_id, CASE WHEN len(s) > 0 THEN s ELSE [{{'h': 'summary', 'i': [summary]}}] END AS s FROM p)
      SELECT recording_id, CAST(n - 1 AS INTEGER) AS section_no, s[n].h AS heading, s[n].i AS items FROM (SELECT recording_id, s, unnest(range(1, len(s) + 1)) AS n FROM w)""",
    "candidate_phrases": f"""WITH {_FIELDS}, x AS (SELECT recording_id, CASE field WHEN 'key_points' THEN 1 WHEN 'topics' THEN 2 ELSE 3 END AS source, pos, {_CLEANED.format('substring(text, 1, 60)')} AS phrase FROM f WHERE field IN ('topics', 'key_points', 'decisions')),
      y AS (SELECT recording_id, arg_min(phrase, (source, pos)) AS phrase, min((source, pos)) AS o FROM x WHERE length(phrase) >= 2 AND phrase NOT IN {tuple(WEAK)} AND {_NORM.format('phrase')} <> '' GROUP BY recording_id, {_NORM.format('phrase')}),
      z AS (SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY o) AS INTEGER) AS rank, phrase FROM y) SELECT * FROM z WHERE rank <= 20""",
    "short_keywords": f"WITH {_KW} SELECT recording_id, keywords FROM kw",
    "title_phrases": f"WITH {_TP} SELECT recording_id, rank, phrase FROM tp",
    "short_titles": rf"""WITH {_KW}, {_TP}, m AS (SELECT doc_id AS recording_id, CASE doc_id % 4 WHEN 0 THEN substring(text, 1, 12) WHEN 1 THEN 'untitled' WHEN 2 THEN '2024-03-05 talk' ELSE substring(text, 1, 21) END AS t, doc_id % 2 = 0 AS done, keywords[1:doc_id % 3] AS k, CASE WHEN doc_id % 5 <> 0 THEN nullif(phrase, '') END AS p
        FROM documents JOIN kw ON kw.recording_id = doc_id LEFT JOIN tp ON tp.recording_id = doc_id AND rank = 1), n AS (SELECT *, {STRIP.format("coalesce(t, '')")} AS s, {_TOKEN.format("coalesce(t, '')")} AS c FROM m),
      b AS (SELECT *, s = '' OR s IN {tuple(R.PLACEHOLDERS)} OR length(s) > 22 OR {_BAD.format('s')} OR {_NORM.format('s')} IN {tuple(R.GENERIC)} AS bad FROM n)
      SELECT recording_id, CASE WHEN bad AND len(k) >= 2 THEN substring(k[1] || ' · ' || k[2], 1, 18) WHEN bad AND len(k) = 1 THEN k[1] WHEN bad AND p IS NOT NULL THEN p WHEN bad AND NOT done THEN 'title to come' WHEN bad THEN 'voice note' WHEN length(c) <= 18 THEN c WHEN len(k) >= 1 THEN k[1] WHEN p IS NOT NULL THEN p ELSE regexp_replace(substring(c, 1, 18), '[ ·\-_]+$', '') END AS title,
        CASE WHEN bad AND len(k) >= 2 THEN 'keywords' WHEN bad AND len(k) = 1 THEN 'keyword' WHEN bad AND p IS NOT NULL THEN 'phrase' WHEN bad AND NOT done THEN 'processing' WHEN bad THEN 'fallback' WHEN length(c) <= 18 THEN 'original_short' WHEN len(k) >= 1 THEN 'keyword_from_long_original' WHEN p IS NOT NULL THEN 'phrase_from_long_original' ELSE 'truncated' END AS reason FROM b""",
    "rule_titles": f"""WITH m AS (SELECT doc_id, coalesce(text, '') AS t, n_chars, source, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS hand FROM documents),
      r AS (SELECT *, CASE WHEN hand THEN 0 WHEN contains(substring(t, 1, 1500), 'tion') AND {_any('substring(t, 1, 6000)', ['heit', 'que'])} THEN 1 WHEN contains(substring(t, 1, 1500), 'sch') AND n_chars <= 2000 THEN 2 WHEN {_any('substring(t, 1, 1500)', ['ing', 'la '])} THEN 3 ELSE 4 END AS n FROM m)
      SELECT doc_id AS recording_id, CASE n WHEN 0 THEN 'by hand' WHEN 1 THEN 'A first kind' WHEN 2 THEN 'A second kind' WHEN 3 THEN 'A third kind' ELSE source END AS title, CASE n WHEN 0 THEN 'override' WHEN 4 THEN 'fallback' ELSE 'rule' END AS rule FROM r""",
    "topic_titles": rf"""SELECT doc_id AS recording_id, CASE WHEN contains(text, 'la ') AND contains(text, 'que') THEN 'both' WHEN {_any('text', ['ung', 'thing'])} THEN 'either' ELSE coalesce(nullif(regexp_replace(substring(regexp_replace(string_split_regex({STRIP.format("coalesce(text, '')")}, '[.!?。\n]')[1], '[^\p{{L}}\p{{N}} ]', '', 'g'), 1, 18), ' +$', ''), ''), 'note') END AS topic FROM documents""",
    "share_texts": f"""WITH m AS (SELECT doc_id AS recording_id, source, lang, substring(text, 1, 30) AS line, substring(text, 1, 50) AS summary, {_RECORDED} AS r FROM documents)
      SELECT recording_id, 'messenger' AS channel, '[' || source || ']' || chr(10) || line || chr(10) || chr(10) || 'Points:' || chr(10) || '- ' || lang AS text FROM m UNION ALL SELECT recording_id, 'mail', 'Subject: [Summary] ' || source || ' - ' || r || chr(10) || chr(10) || summary FROM m UNION ALL SELECT recording_id, 'chat', '*' || source || '*' || chr(10) || line || chr(10) || '• ' || lang FROM m""",
    "alias_history": f"WITH {_ALIAS} SELECT * FROM h",
    "alias_lookup": f"""WITH {_ALIAS}, o AS (SELECT id, min(current_id) AS c FROM (SELECT unnest(old_ids) AS id, current_id FROM h) GROUP BY 1), a AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'o' || c_custkey FROM customer)
      SELECT a.id, coalesce(h.current_id, o.c) AS current_id FROM a LEFT JOIN h ON h.current_id = a.id LEFT JOIN o ON o.id = a.id""",
    "segment_fingerprints": f"""SELECT conv_id AS recording_id, CAST(turn AS INTEGER) AS seg_idx, sha256(concat_ws(chr(31), turn, CASE WHEN turn % 3 = 0 OR coalesce(role, '') = '' THEN 'S1' ELSE role END, turn * 2400, turn * 2400 + 1800, {STRIP.format("coalesce(text, '')")})) AS fingerprint FROM conversations""",
    "snapshot_digests": "SELECT l_orderkey AS recording_id, sha256(string_agg('file' || l_linenumber || '=' || CASE WHEN l_linenumber = 3 THEN '-' ELSE md5(CAST(l_partkey AS VARCHAR)) END, chr(10) ORDER BY 'file' || l_linenumber, CASE WHEN l_linenumber = 3 THEN '-' ELSE md5(CAST(l_partkey AS VARCHAR)) END)) AS digest FROM lineitem GROUP BY 1",
    "recognised_segments": rf"""WITH m AS (SELECT conv_id, turn, {STRIP.format("coalesce(text, '')")} AS t, CASE WHEN conv_id % 2 = 0 THEN turn * 1500 WHEN turn * 700 > 1000 THEN turn * 700 ELSE turn * 700000 END AS s, CASE WHEN turn * 700 + 600 > 1000 THEN turn * 700 + 600 ELSE 600000 END AS e FROM conversations WHERE turn % 4 <> 3)
      SELECT conv_id AS recording_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seg_idx, CAST(s AS BIGINT) AS start_ms, CAST(CASE WHEN conv_id % 2 = 0 AND turn % 2 = 0 THEN turn * 1500 + 1000 ELSE e END AS BIGINT) AS end_ms, t AS text FROM m WHERE t <> ''""",
    "index_ranges": f"""WITH {LONG} SELECT recording_id, 1 AS chunk_no, seg_idx, CASE WHEN seg_idx % 5 = 2 THEN 'later ' || text ELSE text END AS text FROM long_segments WHERE seg_idx BETWEEN recording_id % 3 AND recording_id % 3 + 6""",
}
