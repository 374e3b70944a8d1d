"""The list of recordings, their titles and phrases, texts to share, and renamed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recordings as X
from ..functions.text import digest, first_filled, strip

PLACEHOLDERS, GENERIC = ["untitled", "recording", "meeting"], ["recording", "meeting", "note", "summary", "content", "untitled"]


def segment_fingerprints(segments: DataFrame) -> DataFrame:
    """recording_id, seg_idx, fingerprint over speaker, times and text, where what is missing counts as S1, 0 and ''."""
    ms = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return segments.select("recording_id", "seg_idx", digest(F.col("seg_idx"), F.coalesce(F.nullif("speaker", F.lit("")), F.lit("S1")), ms("start_ms"), ms("end_ms"), first_filled(F.col("text"))).alias("fingerprint"))


def snapshot_digests(files: DataFrame) -> DataFrame:
    """recording_id, digest over the names and hashes of files(recording_id, name, hash), in order of name; a missing file has a null hash."""
    pairs = F.array_sort(F.collect_list(F.struct("name", F.concat_ws("=", "name", F.coalesce("hash", F.lit("-"))).alias("told"))))
    return files.groupBy("recording_id").agg(F.sha2(F.array_join(F.transform(pairs, lambda p: p["told"]), "\n"), 256).alias("digest"))


def record_list(meta: DataFrame, status: DataFrame, results: DataFrame, texts: DataFrame, legacy: DataFrame, tombstones: DataFrame, labels: list[str], placeholders: list[str] = PLACEHOLDERS) -> DataFrame:
    """One row per live recording of both layouts, newest first: id, title, recorded_at, state, display_version, snippet, layout.

    meta(recording_id, title, recorded_at), status(recording_id, status, step, human, final, fast),
    results(recording_id, result_title), texts(recording_id, summary, fast_text, clean_text, raw_text),
    legacy(recording_id, title, recorded_at).
    """
    rows = meta
    for other in (status, results, texts):
        rows = rows.join(other, "recording_id", "left")
    rows = rows.withColumn("display_version", X.display_version(F.col("human"), F.col("final"), F.col("fast")))
    rows = rows.withColumn("snippet", X.snippet(F.col("summary"), [F.when(F.col("display_version") == "FAST", F.col("fast_text")), F.col("clean_text"), F.col("raw_text")], labels))
    from_result = (F.col("display_version") == "FINAL") & ~X.is_placeholder(F.col("result_title"), placeholders)
    title = F.when(from_result, F.col("result_title")).otherwise(X.fallback_title(F.col("title"), F.col("recorded_at"), F.col("snippet"), placeholders))
    new = rows.select("recording_id", title.alias("title"), "recorded_at", X.content_state(F.col("status"), F.col("step")).alias("state"), "display_version", "snippet", F.lit("new").alias("layout"))
    old = legacy.join(meta.select("recording_id"), "recording_id", "left_anti").select("recording_id", X.fallback_title(F.col("title"), F.col("recorded_at"), F.lit(None), placeholders).alias("title"), "recorded_at", F.lit("legacy").alias("layout"))
    both = new.unionByName(old, allowMissingColumns=True).join(tombstones.select("recording_id").distinct(), "recording_id", "left_anti")
    return both.orderBy(F.coalesce("recorded_at", F.col("recording_id").cast("string")).desc(), "recording_id")


def candidate_phrases(sources: DataFrame, weak: list[str], most: int = 20) -> DataFrame:
    """recording_id, rank, phrase: cleaned phrases of sources(recording_id, source, pos, text) in order, each once, the first `most`."""
    rows = sources.select("recording_id", "source", "pos", X.clean_phrase(F.col("text")).alias("phrase")).where(~X.weak_phrase(F.col("phrase"), weak)).withColumn("norm", X.norm(F.col("phrase"))).where("norm <> ''")
    first = rows.groupBy("recording_id", "norm").agg(F.min(F.struct("source", "pos", "phrase")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("recording_id").orderBy("f.source", "f.pos"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("recording_id", "rank", "f.phrase")


def short_keywords(rows: DataFrame, generic: list[str] = GENERIC, aliases: dict[str, str] | None = None, most: int = 4) -> DataFrame:
    """recording_id, keywords: of rows(recording_id, keywords array) those of at most 12 characters and two words that are not generic, each once."""
    each = rows.select("recording_id", F.posexplode_outer("keywords").alias("pos", "raw")).withColumn("word", X.clean_token(F.col("raw"), aliases)).withColumn("norm", X.norm(F.col("word")))
    good = (F.col("word") != "") & (F.length("word") <= 12) & (F.size(F.split("word", " ")) <= 2) & ~F.col("norm").isin(generic) & ~F.col("word").rlike(X.BAD_TITLE)
    first = each.withColumn("good", good).groupBy("recording_id", "norm").agg(F.min(F.when(F.col("good"), F.struct("pos", "word"))).alias("f"))
    words = F.slice(F.array_sort(F.collect_list("f")), 1, most)
    return first.groupBy("recording_id").agg(F.transform(words, lambda x: x["word"]).alias("keywords"))


def title_phrases(sources: DataFrame, weak: list[str], generic: list[str] = GENERIC, longest: int = 18) -> DataFrame:
    """recording_id, rank, phrase: parts of sources(recording_id, pos, text) between commas, dots and slashes, short enough for a title."""
    parts = sources.select("recording_id", "pos", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[,，;；·/]|\s+-\s+")).alias("at", "part"))
    word = X.clean_token(X.clean_phrase(F.col("part")))
    cut = F.when(F.length("word") > longest, F.when(F.size(F.split("word", " ")) >= 2, F.array_join(F.slice(F.split("word", " "), 1, 3), " "))).otherwise(F.col("word"))
    rows = parts.withColumn("word", word).where(~X.weak_phrase(F.col("word"), weak) & ~F.col("word").rlike(X.BAD_TITLE)).withColumn("word", cut).where(F.length("word") <= longest)
    rows = rows.withColumn("norm", X.norm(F.col("word"))).where(~F.col("norm").isin(generic))
    first = rows.groupBy("recording_id", "norm").agg(F.min(F.struct("pos", "at", "word")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("recording_id").orderBy("f.pos", "f.at"))
    return first.select("recording_id", rank.alias("rank"), F.col("f.word").alias("phrase"))


def short_titles(rows: DataFrame, placeholders: list[str] = PLACEHOLDERS, generic: list[str] = GENERIC, longest: int = 18) -> DataFrame:
    """recording_id, title, reason of rows(recording_id, title, status, keywords, phrase): title, keywords or phrase, whichever is short and says something."""
    title = X.clean_token(F.col("title"))
    n, kw, bad = F.size("keywords"), F.col("keywords"), X.bad_title(F.col("title"), placeholders, generic)
    one, phrase = F.get(kw, F.lit(0)), F.nullif("phrase", F.lit(""))
    done = F.lower(F.coalesce("status", F.lit(""))).isin("completed", "complete", "done")
    cut = F.regexp_replace(F.substring(title, 1, longest), r"[ ·\-_]+$", "")
    told = lambda c, reason: F.struct(c.alias("title"), F.lit(reason).alias("reason"))
    rules = [
        (bad & (n >= 2), told(F.substring(F.concat(one, F.lit(" · "), F.get(kw, F.lit(1))), 1, longest), "keywords")),
        (bad & (n == 1), told(one, "keyword")),
        (bad & phrase.isNotNull(), told(phrase, "phrase")),
        (bad & ~done, told(F.lit("title to come"), "processing")),
        (bad, told(F.lit("voice note"), "fallback")),
        (F.length(title) <= longest, told(title, "original_short")),
        (n >= 1, told(one, "keyword_from_long_original")),
        (phrase.isNotNull(), told(phrase, "phrase_from_long_original")),
    ]
    return rows.select("recording_id", X.first_rule(rules, told(cut, "truncated")).alias("t")).select("recording_id", "t.*")


def rule_titles(rows: DataFrame, rules: list[tuple[str, list[str], list[str], int | None]], overrides: DataFrame, early: int = 1500, head: int = 6000) -> DataFrame:
    """recording_id, title, rule of rows(recording_id, text, duration_sec, fallback).

    overrides(recording_id, title) come first. Then the first of rules (title, cues,
    second cues, longest duration) counts whose cues stand in the first `early`
    characters, second cues in the first `head`, for recordings not longer than it says.
    """
    text = F.coalesce("text", F.lit(""))
    has = lambda n, cues: F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(F.substring(text, 1, n), c))
    found = []
    for title, cues, second, longest in rules:
        holds = has(early, cues)
        holds = holds & has(head, second) if second else holds
        holds = holds & (F.coalesce("duration_sec", F.lit(0)) <= longest) if longest else holds
        found.append((holds, F.struct(F.lit(title).alias("title"), F.lit("rule").alias("rule"))))
    by_hand = overrides.select("recording_id", F.col("title").alias("by_hand"))
    other = F.struct(F.col("fallback").alias("title"), F.lit("fallback").alias("rule"))
    told = X.first_rule([(F.col("by_hand").isNotNull(), F.struct(F.col("by_hand").alias("title"), F.lit("override").alias("rule"))), *found], other)
    return rows.join(by_hand, "recording_id", "left").select("recording_id", told.alias("t")).select("recording_id", "t.*")


def topic_titles(rows: DataFrame, rules: list[tuple[str, list[str], list[str]]], longest: int = 18) -> DataFrame:
    """recording_id, topic: the first of rules (label, words of which all, words of which one must stand in the text), else the start of the first sentence."""
    text = F.coalesce("text", F.lit(""))
    found = []
    for label, all_of, any_of in rules:
        holds = F.lit(True)
        for word in all_of:
            holds &= F.contains(text, F.lit(word))
        if any_of:
            holds &= F.exists(F.array(*map(F.lit, any_of)), lambda c: F.contains(text, c))
        found.append((holds, F.lit(label)))
    first = F.regexp_replace(F.substring(F.regexp_replace(F.get(F.split(strip(text), r"[.!?。\n]"), F.lit(0)), r"[^\p{L}\p{N} ]", ""), 1, longest), " +$", "")
    return rows.select("recording_id", X.first_rule(found, F.coalesce(F.nullif(first, F.lit("")), F.lit("note"))).alias("topic"))


def share_texts(notes: DataFrame) -> DataFrame:
    """recording_id, channel, text for mail, a messenger and a chat with its own markup; notes(recording_id, title, line, points, summary, recorded_at)."""
    c = F.col
    join = lambda *parts: F.concat(*parts)
    kinds = {
        "messenger": join(F.lit("["), c("title"), F.lit("]\n"), c("line"), F.lit("\n\nPoints:\n"), c("points")),
        "mail": join(F.lit("Subject: [Summary] "), c("title"), F.lit(" - "), c("recorded_at"), F.lit("\n\n"), c("summary")),
        "chat": join(F.lit("*"), c("title"), F.lit("*\n"), c("line"), F.lit("\n"), F.replace(c("points"), F.lit("- "), F.lit("• "))),
    }
    each = F.array(*(F.struct(F.lit(k).alias("channel"), v.alias("text")) for k, v in kinds.items()))
    return notes.select("recording_id", F.inline(each))


def alias_history(renames: DataFrame) -> DataFrame:
    """current_id, old_ids (in order, each once) of renames(current_id, seq, old_id)."""
    first = renames.where("old_id <> ''").groupBy("current_id", "old_id").agg(F.min("seq").alias("seq"))
    return first.groupBy("current_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "old_id"))), lambda x: x["old_id"]).alias("old_ids"))


def resolve_ids(asked: DataFrame, history: DataFrame) -> DataFrame:
    """id, current_id: what an old or current id leads to; the least of several, itself if it is known as current, else null."""
    old = history.select(F.explode("old_ids").alias("id"), "current_id")
    own = history.select(F.col("current_id").alias("id"), "current_id")
    known = old.join(own.select("id"), "id", "left_anti").groupBy("id").agg(F.min("current_id").alias("current_id")).unionByName(own)
    return asked.select("id").join(known, "id", "left")


def corrected_texts(rows: DataFrame, replacements: list[tuple[str, str]], breaks: str = ".?!") -> DataFrame:
    """recording_id, text: literal replacements in order, blanks squeezed, a line per sentence; rows(recording_id, text)."""
    text = F.coalesce("text", F.lit(""))
    for wrong, right in replacements:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    text = F.replace(F.replace(text, F.lit(" ?"), F.lit("?")), F.lit(" ."), F.lit("."))
    return rows.select("recording_id", strip(F.regexp_replace(text, rf"([{breaks}])\s+", "$1\n")).alias("text"))


def redacted(rows: DataFrame, secrets: list[str], mark: str = "***REDACTED***") -> DataFrame:
    """rows with the secrets replaced in every text column and array of texts."""

    def of(name: str, kind: str) -> Column:
        if kind == "string":
            return X.redact(F.col(name), secrets, mark).alias(name)
        if kind == "array<string>":
            return F.transform(name, lambda x: X.redact(x, secrets, mark)).alias(name)
        return F.col(name)

    return rows.select(*(of(n, k) for n, k in rows.dtypes))
