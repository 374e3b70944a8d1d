"""Queries over items, notes, checks and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import diffing as D
from ..operators import reduce as R
from ..operators import validate as V
from ..operators.kept import kept
from ..operators.reduce_tree import reduce_tree, union_reducer
from . import transcripts as T
from .shapes import LONG, SHORT, STRIP, long_segments, short_segments, table

RULES = {"identity": (["sch", "que"], 4), "observed": (["tion"], 5), "remaining": (["en"], 3)}
TOPICS = [(1, "first", ["heit"]), (2, "second", ["tion", "que"]), (3, "third", ["e"])]


def _items(spark, d):
    return T.extract_items(spark, d)


def union_items(spark, d):
    return R.union_items(_items(spark, d), "recording_id")


def capped_items(spark, d):
    return R.capped(union_items(spark, d), {"topics": 3, "key_points": 4})


def reduce_summary(spark, d):
    x = _items(spark, d).where("field = 'topics'")
    return R.merge_summaries(x.select("recording_id", "chunk_no", F.col("text").alias("summary"), F.when(F.length("text") >= 60, "long line").alias("warning")))


def reduce_mode(spark, d):
    return R.mode(R.sizes(_items(spark, d)), 1000)


def _groups(spark, d):
    return C.pack_groups(R.sizes(_items(spark, d)), 500)


def pack_groups(spark, d):
    return _groups(spark, d)


def two_level_reduce(spark, d):
    items = kept(_items(spark, d))
    return R.two_levels(items, C.pack_groups(R.sizes(items), 500))


def tree_reduce(spark, d):
    """All items merged by a reducer without caps, over as many levels as it takes."""
    return reduce_tree(_items(spark, d), union_reducer(None), 1000, 1500).drop("level")


def note_sections(spark, d):
    return R.sections(union_items(spark, d), RULES)


def topic_rule(spark, d):
    return R.matched_rules(table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), "text"), TOPICS)


def render_note(spark, d):
    return R.render(R.capped(union_items(spark, d)))


def note_flagship(spark, d):
    """Conversations to segments, chunks, items, one merged note each."""
    s = short_segments(spark, d)
    covered = C.overlap(C.manifest(s, C.semantic_chunks(s, 600, 800, sized=True), 800), s)
    return R.render(R.capped(R.union_items(C.extract_items(covered), "recording_id")))


def _expected(spark, d):
    s = long_segments(spark, d)
    rows = s.join(C.correction_chunks(s), ["recording_id", "seg_idx"])
    first = rows.groupBy("recording_id", "chunk_no").agg(F.min("seg_idx").alias("low"))
    return rows.join(first, ["recording_id", "chunk_no"]).select("recording_id", "chunk_no", (F.col("seg_idx") - F.col("low")).alias("pos"), "seg_idx", "start_ms", "end_ms", "text")


def _corrected(rows):
    """A corrected version with planted faults."""
    n = F.col("recording_id") + F.col("seg_idx")
    out = rows.where(~((F.col("recording_id") % 13 == 5) & (F.col("seg_idx") == 1)))
    return out.select(
        "recording_id",
        "chunk_no",
        "pos",
        F.when((n % 17 == 3) & (F.col("seg_idx") > 0), F.col("seg_idx") - 1).otherwise(F.col("seg_idx")).alias("seg_idx"),
        (F.col("start_ms") + F.when(n % 19 == 4, 5).otherwise(0)).alias("start_ms"),
        "end_ms",
        F.when(n % 23 == 6, "").when(n % 29 == 7, F.repeat("text", 4)).otherwise(F.col("text")).alias("text"),
    )


def correction_findings(spark, d):
    rows = _expected(spark, d)
    return V.correction_findings(rows, _corrected(rows))


def correction_merge(spark, d):
    return V.merge_outputs(_corrected(_expected(spark, d)))[0].select("recording_id", "seg_idx", "chunk_no", F.length("text").alias("n_chars"))


def conservation(spark, d):
    rows = _expected(spark, d)
    return V.conservation(rows, _corrected(rows))


def _bad_items(spark, d):
    n = F.col("recording_id") + F.col("chunk_no")
    ids = F.when(n % 5 == 1, F.array().cast("array<int>")).when(n % 5 == 2, F.transform("source_segment_ids", lambda x: x + 1)).when(n % 5 == 3, F.transform("source_segment_ids", lambda x: x + 1000)).otherwise(F.col("source_segment_ids"))
    return _items(spark, d).withColumn("source_segment_ids", ids)


def item_findings(spark, d):
    return V.item_findings(_bad_items(spark, d), T._covered(spark, d))


def output_findings(spark, d):
    n = F.col("recording_id") + F.col("chunk_no")
    expected = T.chunk_hash(spark, d).join(T.chunk_manifest(spark, d).select("recording_id", "chunk_no", "chars"), ["recording_id", "chunk_no"])
    outputs = expected.select("recording_id", "chunk_no", F.when(n % 5 == 2, F.lit(0)).otherwise(F.col("chunk_no")).alias("told_chunk"), F.when(n % 7 == 3, "x").otherwise(F.col("input_hash")).alias("told_hash"), F.when(n % 2 == 0, "said").otherwise(" ").alias("summary"))
    return V.output_findings(expected, outputs, _items(spark, d).where((F.col("recording_id") + F.col("chunk_no")) % 3 != 0))


def provenance_samples(spark, d):
    return V.provenance(_bad_items(spark, d), long_segments(spark, d))


def completeness(spark, d):
    return V.completeness(T._state(T.chunk_hash(spark, d)), _files(spark, d), ["audio", "note"])


def long_completeness(spark, d):
    lengths = table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), F.col("n_chars").alias("duration_sec"))
    return V.completeness(T._state(T.chunk_hash(spark, d)), _files(spark, d), ["audio", "note"], lengths, 1000)


def _files(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), F.explode(F.array(F.lit("audio"), F.lit("note"))).alias("role"), F.col("n_chars").alias("bytes"))
    return files.where("NOT (role = 'note' AND recording_id % 3 = 0)")


def _versions(spark, d):
    s = long_segments(spark, d)
    final = s.where("(recording_id + seg_idx) % 31 <> 9").withColumn("text", F.regexp_replace("text", r"[#%$&*]{3}", ""))
    return s, final


def version_diff(spark, d):
    fast, final = _versions(spark, d)
    return D.version_diff(fast, final, C.correction_chunks(fast))


def _reviewed(spark, d):
    """The fast and the final version: junk taken out, words changed, an end added."""
    fast, final = _versions(spark, d)
    text = F.replace(F.replace("text", F.lit("er "), F.lit("or ")), F.lit(" in"), F.lit(" on in"))
    return fast, final.withColumn("text", F.when((F.col("recording_id") + F.col("seg_idx")) % 7 == 3, F.concat(text, F.lit(" end"))).when(F.col("seg_idx") % 3 == 1, text).otherwise(F.concat(F.lit(" "), F.col("text"))))


def version_report(spark, d):
    fast, final = _reviewed(spark, d)
    raw = fast.where("seg_idx % 5 <> 2").select("recording_id", "seg_idx", (F.col("start_ms") + 1).alias("start_ms"), "end_ms", F.when(F.col("seg_idx") % 4 != 0, F.concat(F.lit("raw "), "text")).otherwise("").alias("text"))
    plan = C.manifest(fast, C.correction_chunks(fast)).where("(recording_id + chunk_no) % 9 <> 4")
    report = D.version_report(fast.withColumn("raw_text", F.lit("as heard")), final, raw, plan)
    return report.select("recording_id", "seg_idx", "chunk_no", "start_ms", "end_ms", F.sha2("raw_text", 256).alias("raw_sha"), "mapped", "changed")


def version_totals(spark, d):
    fast, final = _reviewed(spark, d)
    return D.report_totals(D.version_report(fast, final, fast, C.manifest(fast, C.correction_chunks(fast)))).drop("distance")


def edit_distances(spark, d):
    """The least number of token edits of every changed segment."""
    fast, final = _reviewed(spark, d)
    rows = fast.select("recording_id", "seg_idx", "text").join(final.select("recording_id", "seg_idx", F.col("text").alias("final")), ["recording_id", "seg_idx"]).where("seg_idx % 3 = 1 AND text <> final")
    return rows.select("recording_id", "seg_idx", D.least_edits("text", "final").alias("distance"))


def token_edits(spark, d):
    return D.edits(*_versions(spark, d))


QUERIES = {
    f.__name__: f
    for f in (union_items, capped_items, reduce_summary, reduce_mode, pack_groups, two_level_reduce, tree_reduce, note_sections, topic_rule, render_note, note_flagship, correction_findings, correction_merge, conservation, item_findings, provenance_samples, completeness, version_diff, version_report, version_totals, edit_distances, token_edits, output_findings, long_completeness)
}

_EXTRACT = "items AS (" + T.SQL["extract_items"].split("own AS", 1)[1].split("\n", 1)[1] + ")"
_OWN = "own AS" + T.SQL["extract_items"].split("own AS", 1)[1].split("\n", 1)[0]
_ITEMS = f"{T._CHUNKS}, {_OWN}, {_EXTRACT}"


def _union(name: str, source: str, by: str, order: str = "chunk_no, pos") -> str:
    return f"""{name} AS (SELECT {by}, field, CAST(row_number() OVER (PARTITION BY {by}, field ORDER BY ids[1], text) AS INTEGER) AS rank, text, ids AS source_segment_ids FROM (
      SELECT {by}, field, arg_min(text, ({order})) AS text, list_sort(list_distinct(flatten(list(source_segment_ids)))) AS ids
      FROM {source} WHERE trim(text) <> '' GROUP BY {by}, field, lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))))"""


_CAP = "CASE field WHEN 'topics' THEN 20 ELSE 40 END"
_RENDER = """SELECT recording_id, string_agg('## ' || field || chr(10) || list, chr(10) || chr(10) ORDER BY field) AS markdown
  FROM (SELECT recording_id, field, string_agg('- ' || text, chr(10) ORDER BY rank) AS list FROM u WHERE rank <= """ + _CAP + """ GROUP BY 1, 2) GROUP BY 1"""
_CORRECTION = T.SQL["chunk_correction"].removesuffix("SELECT recording_id, seg_idx, chunk_no FROM chunked").rstrip()
_EXPECTED = f"""{_CORRECTION}, expected AS (
  SELECT recording_id, chunk_no, seg_idx - min(seg_idx) OVER (PARTITION BY recording_id, chunk_no) AS pos, seg_idx, s.start_ms, s.end_ms, s.text
  FROM chunked c JOIN long_segments s USING (recording_id, seg_idx)
), output AS (
  SELECT recording_id, chunk_no, pos, CASE WHEN (recording_id + seg_idx) % 17 = 3 AND seg_idx > 0 THEN seg_idx - 1 ELSE seg_idx END AS seg_idx,
    start_ms + CASE WHEN (recording_id + seg_idx) % 19 = 4 THEN 5 ELSE 0 END AS start_ms, end_ms,
    CASE WHEN (recording_id + seg_idx) % 23 = 6 THEN '' WHEN (recording_id + seg_idx) % 29 = 7 THEN repeat(text, 4) ELSE text END AS text
  FROM expected WHERE NOT (recording_id % 13 = 5 AND seg_idx = 1))"""
_BAD = """bad AS (SELECT recording_id, chunk_no, field, pos, CASE (recording_id + chunk_no) % 5 WHEN 1 THEN CAST([] AS INTEGER[]) WHEN 2 THEN [source_segment_ids[1] + 1] WHEN 3 THEN [source_segment_ids[1] + 1000] ELSE source_segment_ids END AS ids FROM items)"""
SQL = {
    "union_items": f"{_ITEMS}, {_union('u', 'items', 'recording_id')} SELECT * FROM u",
    "capped_items": f"{_ITEMS}, {_union('u', 'items', 'recording_id')} SELECT * FROM u WHERE rank <= CASE field WHEN 'topics' THEN 3 ELSE 4 END",
    "reduce_summary": f"""{_ITEMS}, t AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY chunk_no) AS n FROM items WHERE field = 'topics')
      SELECT recording_id, string_agg(text, ' / ' ORDER BY chunk_no) FILTER (n <= 6) AS summary, coalesce(list(DISTINCT 'long line') FILTER (length(text) >= 60), []) AS warnings FROM t GROUP BY 1""",
    "reduce_mode": f"""{_ITEMS}, s AS (SELECT recording_id, CAST(sum(length(text) + 1) + 1 AS BIGINT) AS size FROM items GROUP BY 1) SELECT *, CASE WHEN size <= 1000 THEN 'direct' ELSE 'group' END AS mode FROM s""",
    "note_sections": f"""{_ITEMS}, {_union('u', 'items', 'recording_id')}, s AS ({' UNION ALL '.join(f"SELECT recording_id, '{n}' AS section, {cap} AS cap, field, rank, text FROM u WHERE " + ' OR '.join(f"contains(lower(text), '{c}')" for c in cues) for n, (cues, cap) in RULES.items())})
      SELECT recording_id, section, place AS rank, text FROM (SELECT *, CAST(row_number() OVER (PARTITION BY recording_id, section ORDER BY field, rank) AS INTEGER) AS place FROM s) WHERE place <= cap""",
    "topic_rule": "SELECT doc_id AS recording_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{c}')" for c in cues) + f" THEN '{label}'" for _, label, cues in TOPICS) + " END AS label FROM documents",
    "render_note": f"{_ITEMS}, {_union('u', 'items', 'recording_id')} {_RENDER}",
    "note_flagship": (f"{_ITEMS}, {_union('u', 'items', 'recording_id')} {_RENDER}").replace(LONG, SHORT).replace("long_segments", "short_segments"),
    "pack_groups": f"""{_ITEMS}, z AS (SELECT recording_id, chunk_no, CAST(sum(length(text) + 1) AS BIGINT) AS size FROM items GROUP BY 1, 2), packed AS (
      SELECT recording_id, chunk_no, 1 AS group_no, size AS total FROM z WHERE chunk_no = 1 UNION ALL
      SELECT z.recording_id, z.chunk_no, CASE WHEN total + z.size > 500 THEN group_no + 1 ELSE group_no END, CASE WHEN total + z.size > 500 THEN z.size ELSE total + z.size END
      FROM packed p JOIN z ON z.recording_id = p.recording_id AND z.chunk_no = p.chunk_no + 1) SELECT recording_id, chunk_no, group_no FROM packed""",
    "correction_findings": f"""{_EXPECTED}, n AS (SELECT recording_id, chunk_no, count(*) AS want FROM expected GROUP BY 1, 2), m AS (SELECT recording_id, chunk_no, count(*) AS have FROM output GROUP BY 1, 2),
      short AS (SELECT recording_id, chunk_no FROM n LEFT JOIN m USING (recording_id, chunk_no) WHERE want <> coalesce(have, 0)),
      o AS (SELECT * FROM output ANTI JOIN short USING (recording_id, chunk_no)),
      p AS (SELECT e.recording_id, e.chunk_no, e.seg_idx, o.seg_idx AS idx, abs(e.start_ms - o.start_ms) > 1 OR abs(e.end_ms - o.end_ms) > 1 AS moved, e.text, o.text AS t FROM expected e JOIN o USING (recording_id, chunk_no, pos)),
      f AS (SELECT recording_id, chunk_no, 'count_mismatch' AS kind, -1 AS seg_idx FROM short
        UNION ALL SELECT recording_id, chunk_no, 'duplicate', seg_idx FROM o GROUP BY 1, 2, 4 HAVING count(*) > 1
        UNION ALL SELECT recording_id, chunk_no, 'index_mismatch', seg_idx FROM p WHERE seg_idx <> idx
        UNION ALL SELECT recording_id, chunk_no, 'time_moved', seg_idx FROM p WHERE moved
        UNION ALL SELECT recording_id, chunk_no, 'text_emptied', seg_idx FROM p WHERE trim(t) = '' AND trim(text) <> ''
        UNION ALL SELECT recording_id, chunk_no, 'length_ratio', seg_idx FROM p WHERE trim(t) <> '' AND trim(text) <> '' AND (length(t) > 3 * length(text) OR length(t) * 5 < length(text)))
      SELECT *, kind <> 'length_ratio' AS fatal FROM f""",
    "correction_merge": f"{_EXPECTED} SELECT recording_id, seg_idx, chunk_no, CAST(length(text) AS INTEGER) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, seg_idx ORDER BY chunk_no, pos) AS n FROM output) WHERE n = 1",
    "conservation": f"""{_EXPECTED}, c AS (SELECT recording_id, seg_idx, count(*) AS copies, max(trim(text)) AS t FROM output GROUP BY 1, 2),
      j AS (SELECT recording_id, seg_idx, trim(e.text) AS r, copies, t FROM expected e FULL JOIN c USING (recording_id, seg_idx)),
      g AS (SELECT recording_id, count(r) AS n_raw, CAST(coalesce(sum(copies), 0) AS BIGINT) AS n_clean, count(*) FILTER (copies IS NULL) AS n_missing, count(*) FILTER (r IS NULL) AS n_added,
        CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS n_duplicates, count(*) FILTER (r <> '' AND t = '') AS n_emptied FROM j GROUP BY 1),
      m AS (SELECT recording_id, count(*) FILTER (seg_idx < b) AS n_moved FROM (SELECT recording_id, seg_idx, lag(seg_idx) OVER (PARTITION BY recording_id ORDER BY chunk_no, pos) AS b FROM output) GROUP BY 1),
      w AS (SELECT g.*, coalesce(n_moved, 0) AS n_moved FROM g LEFT JOIN m USING (recording_id))
      SELECT *, n_missing + n_added + n_duplicates + n_emptied + n_moved = 0 AS ok FROM w""",
    "item_findings": f"""{_ITEMS}, {_BAD}, e AS (SELECT recording_id, chunk_no, field, pos, unnest(ids) AS seg_idx FROM bad)
      SELECT recording_id, chunk_no, field, pos, 'no_ids' AS kind FROM bad WHERE len(ids) = 0
      UNION ALL SELECT DISTINCT recording_id, chunk_no, field, pos, CASE WHEN is_primary IS NULL THEN 'unknown_id' ELSE 'overlap_only' END
      FROM e LEFT JOIN covered USING (recording_id, chunk_no, seg_idx) WHERE is_primary IS NULL OR NOT is_primary""",
    "provenance_samples": f"""{_ITEMS}, {_BAD}, e AS (SELECT recording_id, chunk_no, field, pos, unnest(ids) AS seg_idx FROM bad)
      SELECT recording_id, chunk_no, field, pos, coalesce(string_agg(substring(s.text, 1, 160), ' / '), '') AS sample, bool_and(s.text IS NOT NULL) AS all_known
      FROM e LEFT JOIN long_segments s USING (recording_id, seg_idx) GROUP BY 1, 2, 3, 4""",
    "completeness": T.SQL["chunk_run_plan"].split("\n      SELECT h.recording_id")[0] + """, c AS (SELECT recording_id, count(*) AS n_chunks, count(*) FILTER (status = 'completed') AS n_completed FROM s GROUP BY 1),
      f AS (SELECT doc_id AS recording_id, CASE WHEN n_chars > 0 THEN CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END ELSE 0 END AS n_artifacts FROM documents)
      SELECT recording_id, n_chunks, n_completed, CAST(coalesce(n_artifacts, 0) AS BIGINT) AS n_artifacts, n_chunks = n_completed AND coalesce(n_artifacts, 0) = 2 AS complete FROM c LEFT JOIN f USING (recording_id)""",
    "version_diff": f"""{_CORRECTION}, final AS (SELECT recording_id, seg_idx, regexp_replace(text, '[#%$&*]{{3}}', '', 'g') AS final FROM long_segments WHERE (recording_id + seg_idx) % 31 <> 9)
      SELECT recording_id, seg_idx, final IS NOT NULL AND coalesce(final <> text, false) AS changed, final IS NOT NULL AS mapped, chunk_no
      FROM long_segments LEFT JOIN final USING (recording_id, seg_idx) LEFT JOIN chunked USING (recording_id, seg_idx)""",
}
SQL["long_completeness"] = f"""WITH w AS ({SQL["completeness"]}) SELECT recording_id, n_chunks, n_completed, n_artifacts, complete AND n_chars >= 1000 AS complete FROM w JOIN documents ON doc_id = recording_id"""
SQL["output_findings"] = f"""{_ITEMS}, {T._hashes('h', 'covered')}, x AS (SELECT h.recording_id, h.chunk_no, h.recording_id + h.chunk_no AS n, m.chars FROM h JOIN manifest m USING (recording_id, chunk_no))
  SELECT recording_id, chunk_no, 'chunk_mismatch' AS kind FROM x WHERE n % 5 = 2 UNION ALL SELECT recording_id, chunk_no, 'hash_mismatch' FROM x WHERE n % 7 = 3 UNION ALL SELECT recording_id, chunk_no, 'empty_output' FROM x WHERE n % 2 <> 0 AND n % 3 = 0 AND chars > 40"""
_PACKED = SQL["pack_groups"].removesuffix("SELECT recording_id, chunk_no, group_no FROM packed").rstrip()
_INNER = "(SELECT recording_id, group_no AS chunk_no, field, rank AS pos, text, source_segment_ids FROM inner_ WHERE rank <= " + _CAP + ")"
SQL["two_level_reduce"] = f"""{_PACKED}, grouped AS (SELECT items.*, group_no FROM items JOIN packed USING (recording_id, chunk_no)), {_union('inner_', 'grouped', 'recording_id, group_no')}, {_union('outer_', _INNER, 'recording_id')}
  SELECT * FROM outer_ WHERE rank <= {_CAP}"""
SQL["tree_reduce"] = SQL["union_items"]
_REVIEWED = f"""{_CORRECTION}, final AS (
  SELECT recording_id, seg_idx, CASE WHEN (recording_id + seg_idx) % 7 = 3 THEN t || ' end' WHEN seg_idx % 3 = 1 THEN t ELSE ' ' || x END AS final
  FROM (SELECT *, replace(replace(x, 'er ', 'or '), ' in', ' on in') AS t FROM (SELECT recording_id, seg_idx, regexp_replace(text, '[#%$&*]{{3}}', '', 'g') AS x FROM long_segments WHERE (recording_id + seg_idx) % 31 <> 9))
), both_ AS (
  SELECT l.*, final, final IS NOT NULL AS mapped, coalesce({STRIP.format("text")} <> {STRIP.format("final")}, false) AS changed FROM long_segments l LEFT JOIN final USING (recording_id, seg_idx))"""
SQL["version_report"] = f"""{_REVIEWED} SELECT recording_id, seg_idx, CASE WHEN (recording_id + chunk_no) % 9 <> 4 THEN chunk_no END AS chunk_no,
      CASE WHEN seg_idx % 5 <> 2 THEN start_ms + 1 ELSE start_ms END AS start_ms, end_ms, sha256(CASE WHEN seg_idx % 5 <> 2 AND seg_idx % 4 <> 0 THEN 'raw ' || text ELSE 'as heard' END) AS raw_sha, mapped, changed
      FROM both_ JOIN chunked USING (recording_id, seg_idx)"""
SQL["version_totals"] = f"{_REVIEWED} SELECT recording_id, count(*) AS n_segments, count(*) FILTER (changed) AS changed_segments, count(*) FILTER (NOT mapped) AS mapping_failures FROM both_ GROUP BY 1"
_FIND = "regexp_extract_all({}, '[0-9A-Za-z가-힣]+|[^0-9A-Za-z가-힣\\s]+')"
#: Least edits row by row of the table of all prefixes; an insertion adds one to the place before, so a row is a running least.
SQL["edit_distances"] = f"""{_REVIEWED}, x AS (SELECT recording_id, seg_idx, {_FIND.format("text")} AS a, {_FIND.format("final")} AS b FROM both_ WHERE mapped AND seg_idx % 3 = 1 AND text <> final),
      steps AS (
        SELECT recording_id, seg_idx, a, b, 0 AS i, CAST(range(0, len(b) + 1) AS BIGINT[]) AS line FROM x
        UNION ALL SELECT recording_id, seg_idx, a, b, i, list_transform(range(1, len(b) + 2), lambda j: CAST(j + list_min(least_[1 : j]) AS BIGINT)) FROM (
          SELECT recording_id, seg_idx, a, b, i + 1 AS i, list_prepend(i + 1 - 1, list_transform(range(1, len(b) + 1), lambda j: least(line[j + 1] + 1, line[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END) - (j + 1))) AS least_
          FROM steps WHERE i < len(a)))
      SELECT recording_id, seg_idx, line[len(b) + 1] AS distance FROM steps WHERE i = len(a)"""
