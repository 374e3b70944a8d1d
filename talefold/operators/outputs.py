"""What models return: recovered, repaired, checked and cut down; and notes that are made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recordings import first_rule
from ..functions.text import digest, slug, strip

#: How many items of each field a merge is told, per chunk output or group output.
TOLD = {"chunk": {"topics": 8, "key_points": 10, "decisions": 4, "action_items": 4, "questions": 4}, "group": {"topics": 4, "key_points": 5, "decisions": 4, "action_items": 4, "questions": 4}}
SUMMARY_CHARS, TEXT_CHARS, MOST_IDS, WARNINGS, WARNING_CHARS = {"chunk": 260, "group": 320}, 260, 40, 2, 240
NOTE_TYPES = ["meeting", "lecture", "idea", "conversation", "test", "other"]


def recovered_json(text: Column, noise: list[str]) -> Column:
    """JSON in a model's answer: the whole without noise lines, else a fenced block, else from the first brace to the last; null if none parses."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    noisy = lambda x: F.exists(F.array(*map(F.lit, noise)), lambda n: F.startswith(F.trim(x), n)) if noise else F.lit(False)
    clean = strip(F.array_join(F.filter(lines, lambda x: ~noisy(x)), "\n"))
    fenced = F.regexp_extract(clean, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    first, last = F.instr(clean, "{"), F.length(clean) - F.instr(F.reverse(clean), "}") + 1
    braces = F.when((first > 0) & F.contains(clean, F.lit("}")) & (last > first), F.substring(clean, first, last - first + 1))
    # As the one element of an array, as a parser by itself ignores what follows the first value.
    parses = lambda c: F.when(F.size(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<variant>")) == 1, c)
    return F.when(fenced != "", F.coalesce(parses(clean), parses(fenced))).otherwise(F.coalesce(parses(clean), parses(braces)))


def coerced_warnings(rows: DataFrame) -> DataFrame:
    """recording_id, warnings, n_changed of rows(recording_id, raw): texts of a JSON array of strings or objects; what is no array gives none."""
    items = F.expr("from_json(raw, 'array<variant>')")
    kind = lambda x: F.schema_of_variant(x)
    part = lambda x, k: F.nullif(F.try_variant_get(x, f"$.{k}", "string"), F.lit(""))
    ids = lambda x: F.array_join(F.slice(F.array_sort(F.array_distinct(F.try_variant_get(x, "$.source_segment_ids", "array<int>"))), 1, 20), ", ")
    body = lambda x: F.coalesce(part(x, "text"), part(x, "warning"), part(x, "summary"), F.lit(""))
    of_object = lambda x: F.when((F.coalesce(ids(x), F.lit("")) != "") & (body(x) != ""), F.concat(body(x), F.lit(" (source_segment_ids=["), ids(x), F.lit("])"))).otherwise(body(x))
    told = lambda x: F.when(kind(x).startswith("OBJECT"), of_object(x)).otherwise(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
    each = rows.select("recording_id", F.posexplode_outer(items).alias("pos", "x"))
    each = each.select("recording_id", "pos", strip(told(F.col("x"))).alias("text"), F.coalesce(kind(F.col("x")) != "STRING", F.lit(False)).alias("changed"))
    text = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text"))))
    return each.groupBy("recording_id").agg(F.transform(text, lambda t: t["text"]).alias("warnings"), F.count_if("changed").alias("n_changed"))


def repaired_results(rows: DataFrame, fillers: list[str], most: int = 8) -> DataFrame:
    """recording_id, uncertain, reasons, note_type, keywords of rows(recording_id, uncertain_json, note_type, content_type, keywords).

    Uncertain segments are numbers or objects with an index and a reason; a note type that
    is unknown becomes the content type or 'other'; keywords lose '#', fillers and repeats.
    """
    items = F.coalesce(F.expr("from_json(uncertain_json, 'array<variant>')"), F.expr("CAST(array() AS array<variant>)"))
    index = lambda x: F.coalesce(F.try_variant_get(x, "$", "int"), F.try_variant_get(x, "$.index", "int"))
    why = lambda x: F.coalesce(F.nullif(F.try_variant_get(x, "$.reason", "string"), F.lit("")), F.nullif(F.try_variant_get(x, "$.note", "string"), F.lit("")))
    numbers = F.array_sort(F.array_distinct(F.array_compact(F.transform(items, index))))
    reasons = F.array_compact(F.transform(items, lambda x: F.when(index(x).isNotNull(), F.concat(F.lit("segment "), index(x).cast("string"), F.lit(": "), why(x)))))
    known = lambda c: F.col(c).isin(NOTE_TYPES)
    note_type = F.when(known("note_type"), F.col("note_type")).when(known("content_type"), F.col("content_type")).otherwise("other")
    words = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.regexp_replace(strip(F.coalesce(k, F.lit(""))), "^#+", ""))
    words = F.slice(F.array_distinct(F.filter(words, lambda k: (k != "") & ~k.isin(fillers))), 1, most)
    return rows.select("recording_id", numbers.alias("uncertain"), reasons.alias("reasons"), note_type.alias("note_type"), words.alias("keywords"))


def violations(rows: DataFrame, key: str, rules: list[tuple[str, str, object]]) -> DataFrame:
    """key, violations (sorted) of rows against rules (column, kind, argument).

    Kinds: required, enum, min_length, max_length, pattern, max_items, unique. A null
    breaks `required` alone.
    """

    def broken(c: Column, kind: str, arg) -> Column:
        return {
            "required": lambda: c.isNull(),
            "enum": lambda: ~c.isin(arg),
            "min_length": lambda: F.length(c) < arg,
            "max_length": lambda: F.length(c) > arg,
            "pattern": lambda: ~c.rlike(arg),
            "max_items": lambda: F.size(c) > arg,
            "unique": lambda: F.size(F.array_distinct(c)) < F.size(c),
        }[kind]()

    found = F.array(*(F.when(F.coalesce(broken(F.col(c), kind, arg), F.lit(False)), F.lit(f"{c}:{kind}")) for c, kind, arg in rules))
    return rows.select(key, F.array_sort(F.array_compact(found)).alias("violations"))


def compact_items(items: DataFrame, kind: str = "chunk") -> DataFrame:
    """recording_id, chunk_no, field, pos, text, source_segment_ids as a merge is told them.

    The first items of each field are taken, then blank ones dropped; texts and id lists are cut.
    """
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in TOLD[kind].items() for x in kv)), F.col("field"))
    place = F.row_number().over(Window.partitionBy("recording_id", "chunk_no", "field").orderBy("pos"))
    ids = F.slice(F.array_sort(F.array_distinct("source_segment_ids")), 1, MOST_IDS)
    rows = items.withColumn("place", place).where((F.col("place") <= cap) & (strip(F.coalesce("text", F.lit(""))) != ""))
    return rows.select("recording_id", "chunk_no", "field", "pos", F.substring("text", 1, TEXT_CHARS).alias("text"), ids.alias("source_segment_ids"))


def reduce_findings(outputs: DataFrame, items: DataFrame, segments: DataFrame) -> DataFrame:
    """group_id, kind, field of what is wrong with merged outputs; all of it is fatal.

    outputs(group_id, recording_id, told_recording, input_hash, told_hash, n_chunks, told_chunks),
    items(group_id, recording_id, field, pos, source_segment_ids).
    """
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    kinds = F.array_compact(F.array(F.when(differs("recording_id", "told_recording"), "recording_mismatch"), F.when(differs("input_hash", "told_hash"), "hash_mismatch"), F.when(differs("n_chunks", "told_chunks"), "count_mismatch")))
    whole = outputs.select("group_id", F.explode(kinds).alias("kind"), F.lit("").alias("field"))
    none = items.where(F.coalesce(F.size("source_segment_ids"), F.lit(0)) <= 0).select("group_id", F.lit("missing_ids").alias("kind"), "field")
    ids = items.select("group_id", "recording_id", "field", F.explode("source_segment_ids").alias("seg_idx"))
    unknown = ids.join(segments.select("recording_id", "seg_idx"), ["recording_id", "seg_idx"], "left_anti").select("group_id", F.lit("unknown_ids").alias("kind"), "field")
    return whole.unionByName(none.distinct()).unionByName(unknown.distinct())


def reduce_hashes(outputs: DataFrame, settings: str) -> DataFrame:
    """recording_id, group_no, input_hash over the ordered hashes of outputs(recording_id, group_no, chunk_no, output_hash)."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "output_hash")))
    return outputs.groupBy("recording_id", "group_no").agg(digest(F.array_join(F.transform(ordered, lambda x: x["output_hash"]), ","), F.lit(settings), F.max("group_no")).alias("input_hash"))


def reduce_reuse(hashes: DataFrame, known: DataFrame) -> DataFrame:
    """recording_id, group_no, verdict against known(recording_id, group_no, input_hash, output_hash, actual_hash): reuse, or why not."""
    k = known.select("recording_id", "group_no", F.col("input_hash").alias("old"), "output_hash", "actual_hash")
    verdict = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("input_hash"), "input_changed").when(~F.col("output_hash").eqNullSafe(F.col("actual_hash")), "output_changed").otherwise("reuse")
    return hashes.join(k, ["recording_id", "group_no"], "left").select("recording_id", "group_no", verdict.alias("verdict"))


def context(items: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """recording_id, situation, actors, place, agenda, warnings inferred from all items of a recording.

    rules: (slot, label, cues); a rule holds if any item has any of its cues. The first
    rule gives situation, actors and place; all give agenda and warnings, in order.
    """
    hit = lambda cues: F.coalesce(F.bool_or(F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(F.col("text"), c))), F.lit(False))
    flags = items.groupBy("recording_id").agg(*(hit(cues).alias(f"r{n}") for n, (_, _, cues) in enumerate(rules)))
    of = lambda slot: [(F.col(f"r{n}"), label) for n, (s, label, _) in enumerate(rules) if s == slot]
    one = lambda slot: first_rule([(c, F.lit(v)) for c, v in of(slot)], F.lit("")).alias(slot)
    all_ = lambda slot: F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(v)) for c, v in of(slot)), F.lit(None).cast("string")))).alias(slot)
    return flags.select("recording_id", one("situation"), one("actors"), one("place"), all_("agenda"), all_("warnings"))


def _lists(items: DataFrame, fields: dict[str, int], width: int | None = None) -> DataFrame:
    """recording_id and an array per field with the first filled texts by rank."""
    text = F.substring(strip("text"), 1, width) if width else strip(F.col("text"))
    rows = items.select("recording_id", "field", "rank", text.alias("text")).where("text <> ''")
    pick = lambda f, n: F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("rank", "text")))), 1, n), lambda x: x["text"]).alias(f)
    return rows.groupBy("recording_id").agg(*(pick(f, n) for f, n in fields.items()))


def notes(merged: DataFrame, summaries: DataFrame, contexts: DataFrame) -> DataFrame:
    """recording_id, title, reason, slug, keywords, line, core, flow, warnings of a recording's merged items.

    The title names actors, situation and agenda if these are known, else place and
    agenda, else the first topic or key point.
    """
    fields = {"topics": 8, "key_points": 12, "decisions": 12, "action_items": 12}
    rows = summaries.select("recording_id", "summary").join(_lists(merged, fields), "recording_id", "left").join(contexts, "recording_id", "left")
    rows = rows.select("recording_id", "summary", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in (*fields, "agenda", "warnings")), *(F.coalesce(c, F.lit("")).alias(c) for c in ("situation", "actors", "place")))
    c = F.col
    agenda = lambda n: F.array_join(F.slice("agenda", 1, n), "·")
    told = lambda text, why: F.struct(F.substring(text, 1, 80).alias("title"), F.lit(why).alias("reason"))
    some = F.size("agenda") > 0
    base = F.coalesce(F.get("topics", F.lit(0)), F.get("key_points", F.lit(0)), F.lit("voice note"))
    title = first_rule(
        [
            ((c("actors") != "") & (c("situation") != "") & some, told(F.concat("actors", F.lit(" "), "situation", F.lit("-"), agenda(3)), "actors_situation_agenda")),
            ((c("place") != "") & some, told(F.concat("place", F.lit(" "), "situation", F.lit("-"), agenda(2)), "place_situation_agenda")),
        ],
        told(base, "topic"),
    )
    rows = rows.withColumn("t", title)
    line = F.coalesce(F.nullif("summary", F.lit("")), c("t.title"))
    head = F.when(some, F.array(F.concat(F.lit("agenda: "), F.array_join(F.slice("agenda", 1, 4), ", ")))).otherwise(F.array().cast("array<string>"))
    flow = F.slice(F.concat(head, "decisions", "action_items", "key_points"), 1, 10)
    filled = lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(line))
    return rows.select("recording_id", "t.title", "t.reason", slug(c("t.title")).alias("slug"), F.transform("topics", lambda x: F.substring(x, 1, 40)).alias("keywords"), line.alias("line"), filled(F.slice("key_points", 1, 8)).alias("core"), filled(flow).alias("flow"), "warnings")


def note_sections(merged: DataFrame, summaries: DataFrame, contexts: DataFrame, observed: list[str], hypotheses: list[str]) -> DataFrame:
    """recording_id, section_no, heading, items of a note: identity, observed, hypotheses, key points of neither, decisions, actions, questions, else the summary."""
    fields = {"key_points": 12, "decisions": 12, "action_items": 12, "questions": 10}
    rows = summaries.select("recording_id", "summary").join(_lists(merged, fields), "recording_id", "left").join(contexts, "recording_id", "left")
    none = F.array().cast("array<string>")
    points = F.coalesce("key_points", none)
    has = lambda x, cues: F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(x, c))
    named = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    agenda = F.array_join(F.slice(F.coalesce("agenda", none), 1, 4), ", ")
    parts = [
        ("identity", F.array_compact(F.array(*(named(n, F.col(n)) for n in ("situation", "actors", "place")), named("agenda", agenda)))),
        ("observed", F.slice(F.filter(points, lambda x: has(x, observed)), 1, 8)),
        ("hypotheses", F.slice(F.filter(points, lambda x: has(x, hypotheses)), 1, 8)),
        ("key points", F.slice(F.filter(points, lambda x: ~has(x, observed) & ~has(x, hypotheses)), 1, 10)),
        ("decisions", F.coalesce("decisions", none)),
        ("next actions", F.coalesce("action_items", none)),
        ("questions", F.coalesce("questions", none)),
    ]
    all_ = F.filter(F.array(*(F.struct(F.lit(n).alias("heading"), x.alias("items")) for n, x in parts)), lambda s: F.size(s["items"]) > 0)
    last = F.array(F.struct(F.lit("summary").alias("heading"), F.array(F.coalesce("summary", F.lit(""))).alias("items")))
    return rows.select("recording_id", F.posexplode(F.when(F.size(all_) > 0, all_).otherwise(last)).alias("section_no", "s")).select("recording_id", "section_no", "s.*")


def gold_skeleton(cases: DataFrame) -> DataFrame:
    """case_id, transcript, status, must_correct, expected of cases(case_id, must, bad): what people have to fill in."""
    wrong = F.transform("bad", lambda x: F.struct(x.alias("wrong"), F.lit("").alias("correct")))
    return cases.select("case_id", F.lit("").alias("transcript"), F.lit("needs_transcription").alias("status"), wrong.alias("must_correct"), F.col("must").alias("expected"))
