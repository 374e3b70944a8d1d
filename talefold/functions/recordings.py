"""Column functions on a recording's times, states, files and titles."""

from __future__ import annotations

import re

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, strip

FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")


def _stamp(c: Column) -> Column:
    """The first 19 characters by the first format that fits."""
    return F.coalesce(*(F.try_to_timestamp(F.substring(c, 1, 19), F.lit(f)) for f in FORMATS))


def recorded_at(c: Column, fallback: Column, zone: str = "Asia/Seoul") -> Column:
    """The instant of a date written as text; without an offset it is local to zone. Sessions run in UTC."""
    text = strip(c)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    zoned = text.rlike(r"\d{2}:\d{2}\S*(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(F.to_utc_timestamp(_stamp(text), zone), F.when(zoned, iso).otherwise(F.to_utc_timestamp(iso, zone)), fallback)


def date_key(recorded: Column, uploaded: Column, prefix: Column, fallback: Column) -> Column:
    """yyMMdd of the first date there is, else of the date that a file prefix begins with."""
    blank = F.lit("")
    told = F.coalesce(F.nullif(recorded, blank), F.nullif(uploaded, blank), blank)
    found = F.regexp_extract(F.coalesce(prefix, blank), r"^(\d{4})-(\d{2})-(\d{2})", 0)
    return F.coalesce(F.date_format(_stamp(told), "yyMMdd"), F.when(found != "", F.substring(F.replace(found, F.lit("-"), blank), 3, 6)), fallback)


def date_label(c: Column) -> Column:
    """M/D and, if there is one, the time of day; '' without a date."""
    raw = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("T"), F.lit(" ")), F.lit("+09:00"), F.lit(""))
    pattern = r"(\d{4})-(\d{2})-(\d{2})\s*(\d{2}:\d{2})?"
    part = lambda n: F.regexp_extract(raw, pattern, n)
    day = F.concat(part(2).try_cast("int").cast("string"), F.lit("/"), part(3).try_cast("int").cast("string"))
    return F.when(part(0) == "", "").otherwise(F.concat(day, F.when(part(4) != "", F.concat(F.lit(" "), part(4))).otherwise("")))


def content_state(status: Column, step: Column) -> Column:
    """State shown for a job's status and step: the first rule that holds."""
    s, p = F.coalesce(status, F.lit("")), F.coalesce(step, F.lit(""))
    begins = lambda name: (p == name) | s.startswith(name)
    rules = [
        (s.isin("completed", "final_ready"), F.lit("FINAL_READY")),
        (s.isin("fast_ready", "fast_running", "final_running", "failed", "retry_wait"), F.upper(s)),
        (begins("stt"), F.when(s == "stt_running", "STT_RUNNING").otherwise("STT_DONE")),
        (begins("correction"), F.when(s == "correction_running", "CORRECTION_RUNNING").otherwise("CORRECTION_DONE")),
        (begins("semantic"), F.lit("SEMANTIC_RUNNING")),
        ((p == "reduce") | (s == "reduce_running"), F.lit("REDUCE_RUNNING")),
        (p.isin("render", "rendering") | (s == "rendering"), F.lit("RENDERING")),
    ]
    return first_rule(rules, F.upper(F.when(s == "", "UNKNOWN").otherwise(s)))


def first_rule(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    for holds, value in reversed(rules):
        otherwise = F.when(holds, value).otherwise(otherwise)
    return otherwise


#: Error codes, whether they may be retried, and the words that tell them; "a&b" asks for both.
ERRORS = [
    ("stt_failed_missing_ffmpeg", True, ["No such file or directory: 'ffmpeg'"]),
    ("stt_failed_audio_invalid", False, ["stt_audio_load_failed", "moov atom not found", "Invalid data found when processing input"]),
    ("cloud_upload_failed", True, ["~cloud", "~google", "HttpError", "Connection"]),
    ("temporary_worker_error", True, ["whisper failed", "~temporarily"]),
    ("json_invalid", True, ["ValidationError", "JSON"]),
    ("permanent_file_error", False, ["No such file", "audio&missing"]),
]


def error_class(kind: Column, message: Column, rules: list[tuple[str, bool, list[str]]] = ERRORS) -> Column:
    """code and retryable of an error's kind (deleted, timeout or other) and message; '~' marks words in any case."""
    text = F.coalesce(message, F.lit(""))

    def holds(cue: str) -> Column:
        out = F.lit(True)
        for word in cue.split("&"):
            out &= F.contains(F.lower(text), F.lit(word[1:])) if word[0] == "~" else F.contains(text, F.lit(word))
        return out

    told = lambda code, retryable: F.struct(F.lit(code).alias("code"), F.lit(retryable).alias("retryable"))
    found = [(kind == "deleted", told("recording_deleted", False)), (kind == "timeout", told("timeout", True))]
    for code, retryable, cues in rules:
        any_ = F.lit(False)
        for cue in cues:
            any_ |= holds(cue)
        found.append((any_, told(code, retryable)))
    return first_rule(found, told("worker_error", True))


def display_version(human: Column, final: Column, fast: Column) -> Column:
    """The best version there is."""
    return first_rule([(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in ((human, "HUMAN"), (final, "FINAL"), (fast, "FAST"))], F.lit("PROCESSING"))


def artifact_role(path: Column) -> Column:
    """Role of a file by its name and path; the first rule that holds."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    has = lambda c, word: F.contains(c, F.lit(word))
    rules = [
        (name == "status.json", "STATUS"),
        (name == "metadata.json", "METADATA"),
        (has(name, "stt_raw"), "RAW_STT"),
        (has(name, "transcript_raw"), "TRANSCRIPT_RAW"),
        (has(name, "segments_"), "SEGMENTS"),
        (has(low, "/fast/"), "FAST"),
        (has(name, "transcript_clean") | has(low, "correction_"), "CORRECTION"),
        (has(low, "semantic"), "SEMANTIC"),
        (name == "summary.md", "SUMMARY"),
        ((name == "analysis.md") | has(name, "result."), "FINAL"),
        (has(name, "manifest") | has(low, "checkpoint"), "CHECKPOINT"),
    ]
    return first_rule([(c, F.lit(v)) for c, v in rules], F.lit("JOB_ARTIFACT"))


def snippet(summary: Column, others: Iterable[Column], labels: list[str], chars: int = 120) -> Column:
    """Start of the first summary line that is not a label's, else of the first other text that is not blank."""
    lines = F.transform(F.split(F.coalesce(summary, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[#\-` ]+|[#\-` ]+$", ""))
    is_label = lambda x: F.exists(F.array(*map(F.lit, labels)), lambda y: F.startswith(x, y)) if labels else F.lit(False)
    first = F.get(F.filter(lines, lambda x: (x != "") & ~is_label(x)), F.lit(0))
    flat = [F.nullif(F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")), F.lit("")) for c in others]
    return F.coalesce(*(F.substring(c, 1, chars) for c in (first, *flat)), F.lit(""))


def is_placeholder(title: Column, names: list[str]) -> Column:
    """Whether a title says nothing: blank, or one of the names that stand for no title."""
    text = strip(F.coalesce(title, F.lit("")))
    return (text == "") | text.isin(names)


def fallback_title(title: Column, recorded: Column, told: Column, names: list[str], pending: str = "recording in work", chars: int = 28) -> Column:
    """The title if it says something, else the date and the start of what was said."""
    date = F.substring(F.replace(F.replace(F.coalesce(recorded, F.lit("")), F.lit("T"), F.lit(" ")), F.lit("+09:00"), F.lit("")), 1, 16)
    phrase = F.substring(squeeze(F.coalesce(told, F.lit(""))), 1, chars)
    return F.when(~is_placeholder(title, names), strip(title)).otherwise(strip(F.concat(date, F.lit(" "), F.when(phrase != "", phrase).otherwise(pending))))


def time_figures(log: Column) -> Column:
    """real, user, sys seconds and peak bytes out of a timing tool's report."""
    times = r"([0-9.]+) real\s+([0-9.]+) user\s+([0-9.]+) sys"
    part = lambda n: F.nullif(F.regexp_extract(log, times, n), F.lit("")).try_cast("double")
    peak = F.nullif(F.regexp_extract(log, r"(\d+)\s+peak memory footprint", 1), F.lit("")).try_cast("long")
    return F.struct(part(1).alias("real"), part(2).alias("user"), part(3).alias("sys"), peak.alias("peak_bytes"))


def real_time_factor(elapsed: Column, duration: Column) -> Column:
    return F.round(F.try_divide(elapsed, F.nullif(duration, F.lit(0))), 4)


#: Shares and least bytes of the output, of what is needed on the way, and of the margin.
MIB = 1 << 20
OUTPUT_SHARE, OVERHEAD, MARGIN = 1.10, (8 * MIB, 0.05), (64 * MIB, 0.10)


def storage_estimate(source: Column, total_s: Column, outputs_s: Column) -> Column:
    """output, overhead, margin, required bytes of an edit that keeps outputs_s (array of seconds) of total_s; null for no input."""
    kept = F.aggregate(outputs_s, F.lit(0.0), lambda a, x: a + x.cast("double"))
    output = F.greatest(F.lit(1).cast("long"), F.floor(source * (kept / total_s) * OUTPUT_SHARE).cast("long"))
    least = lambda rule: F.greatest(F.lit(rule[0]).cast("long"), F.floor(output * rule[1]).cast("long"))
    all_ = F.struct(output.alias("output"), least(OVERHEAD).alias("overhead"), least(MARGIN).alias("margin"), (output + least(OVERHEAD) + least(MARGIN)).alias("required"))
    return F.when((source > 0) & (total_s > 0), all_)


def redact(c: Column, secrets: list[str], mark: str = "***REDACTED***") -> Column:
    for s in secrets:
        if s:
            c = F.replace(c, F.lit(s), F.lit(mark))
    return c


#: Marks that phrases never hold, and what is cut off their ends.
MARKUP, EDGES = r"[`#*_\[\]{}()<>|]", r"^[ .,:;·\-_/]+|[ .,:;·\-_/]+$"


def clean_phrase(c: Column, words: int = 6, chars: int = 36) -> Column:
    """A short phrase without markup: at most so many words and characters."""
    text = F.regexp_replace(squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), MARKUP, " ")), EDGES, "")
    return F.regexp_replace(F.substring(F.array_join(F.slice(F.split(text, " "), 1, words), " "), 1, chars), r"^[ .,:;·\-_]+|[ .,:;·\-_]+$", "")


def clean_token(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """A keyword without '#' and markup; known spellings become their alias."""
    bare = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "^#+", "")
    text = F.regexp_replace(squeeze(F.regexp_replace(bare, MARKUP, " ")), r"^[ .,:;·\-_]+|[ .,:;·\-_]+$", "")
    return first_rule([(F.lower(F.regexp_replace(bare, r"(?U)\s+", "")) == k, F.lit(v)) for k, v in (aliases or {}).items()], text)


def without_endings(c: Column, endings: list[str], fillers: list[str] = (), from_: list[str] = (), keep: list[str] = ()) -> Column:
    """A title's word without what a language hangs on it: filler words and all from given patterns on are left out, then one of the endings.

    endings: literal suffixes, of which the longest that fits goes; fillers: literal words;
    from_: patterns behind which the rest goes; keep: titles that stay as they are.
    """
    told = strip(F.coalesce(c, F.lit("")))
    if fillers:
        told = F.regexp_replace(told, rf"(?U)(?<!\w)(?:{'|'.join(map(re.escape, fillers))})(?!\w)", " ")
    for pattern in from_:
        told = F.regexp_replace(told, rf"(?:{pattern}).*$", "")
    told = F.regexp_replace(squeeze(told), r"^[ .,:;·\-_]+|[ .,:;·\-_]+$", "")
    bare = strip(F.regexp_replace(told, rf"(?:{'|'.join(map(re.escape, sorted(endings, key=len, reverse=True)))})$", "")) if endings else told
    return F.when(told.isin(list(keep)), told).otherwise(bare) if keep else bare


def norm(c: Column) -> Column:
    """Letters, digits and underscores of a text, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", "")


def weak_phrase(c: Column, weak: list[str]) -> Column:
    return (F.length(squeeze(F.coalesce(c, F.lit("")))) < 2) | squeeze(F.coalesce(c, F.lit(""))).isin(weak)


#: Titles that are a date or a numbered topic.
BAD_TITLE = r"^\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}|(?i)^topic\s*\d+$"


def bad_title(c: Column, placeholders: list[str], generic: list[str], longest: int = 22) -> Column:
    """Whether a title should not be shown: it says nothing, is too long, a date, or a generic word."""
    text = strip(F.coalesce(c, F.lit("")))
    return is_placeholder(c, placeholders) | (F.length(text) > longest) | text.rlike(BAD_TITLE) | norm(text).isin(generic)
