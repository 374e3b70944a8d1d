"""Queries over transcripts: segments, terms, chunks and their items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import keywords as K
from ..operators import long_chunks as L
from ..operators import segments as S
from ..operators import sketches as Q
from ..operators.kept import kept
from .shapes import LINES, LONG, SHORT, SQUEEZE, long_segments, short_segments, table

CUES = ["tion", "heit", "que"]


def segments_short(spark, d):
    return short_segments(spark, d)


def segments_long(spark, d):
    return long_segments(spark, d)


def transcript_text(spark, d):
    return S.transcript(short_segments(spark, d))


def clean_lines(spark, d):
    return S.clean_lines(table(spark, d, "documents"))


def fallback_segments(spark, d):
    return S.even_segments(table(spark, d, "documents"), F.col("n_chars") * 60)


def sentences(spark, d):
    return S.sentences(table(spark, d, "documents"))


def action_sentences(spark, d):
    return S.action_sentences(sentences(spark, d), CUES)


def keyword_topk(spark, d):
    return K.top_terms(short_segments(spark, d), "recording_id")


def glossary_topk(spark, d):
    return K.top_terms(short_segments(spark, d), "recording_id", 20, fold=False)


def corpus_terms(spark, d):
    return K.collection_terms(short_segments(spark, d), "recording_id")


def _daily_terms(spark, d):
    """Terms of conversations, each dealt to one of seven days."""
    rows = short_segments(spark, d).select("recording_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term"))
    return rows.select((F.col("recording_id") % 7).alias("day"), "recording_id", "term")


def term_sketches(spark, d):
    """What merged daily states tell, against the exact numbers: whether recordings and terms are within 3 %, and the ten most frequent terms within 1 %."""
    terms = _daily_terms(spark, d)
    whole = Q.merged(Q.day_states(terms))
    exact = terms.agg(F.count("*").alias("n"), F.count_distinct("recording_id").alias("n_recordings"), F.count_distinct("term").alias("n_terms"))
    near = lambda a, b, part: F.abs(a - b) <= F.ceil(b * part)
    told = Q.counts(whole).select(F.col("n").alias("m"), F.col("n_recordings").alias("r"), F.col("n_terms").alias("t"))
    top = Q.frequent(whole, 10).join(terms.groupBy("term").agg(F.count("*").alias("true_n")), "term").agg(F.count("*").alias("n_top"), F.bool_and(near(F.col("n"), F.col("true_n"), 0.01)).alias("top_close"))
    one = exact.join(told, exact["n"] == told["m"]).select("n", "n_recordings", "n_terms", near(F.col("r"), F.col("n_recordings"), 0.03).alias("recordings_close"), near(F.col("t"), F.col("n_terms"), 0.03).alias("terms_close"), F.lit(1).alias("one"))
    return one.join(top.withColumn("one", F.lit(1)), "one").drop("one")


def extractive_memo(spark, d):
    docs = table(spark, d, "documents")
    terms = K.top_terms(docs.select("doc_id", F.lit(0).alias("seg_idx"), "text"), "doc_id", 3)
    return K.memo(terms, S.sentences(docs))


def chunk_correction(spark, d):
    return C.correction_chunks(long_segments(spark, d))


def chunk_semantic(spark, d):
    return C.semantic_chunks(long_segments(spark, d), 600, 800)


def _joined(spark, d):
    """Four recordings that hold all lines of all documents."""
    s = L.joined(long_segments(spark, d), F.col("recording_id") % 4)
    return s.select("*", (F.col("seg_idx").cast("long") * 2400).alias("start_ms"), (F.col("seg_idx").cast("long") * 2400 + 1800).alias("end_ms"))


def chunk_long(spark, d):
    return L.semantic_chunks(_joined(spark, d), 600)


def chunk_long_correction(spark, d):
    return L.correction_chunks(_joined(spark, d))


def pack_long(spark, d):
    """Chunks of the long recordings packed into groups."""
    s = _joined(spark, d)
    sized = C.manifest(s, L.semantic_chunks(s, 600), 800).select("recording_id", "chunk_no", F.col("chars").alias("size"))
    return L.pack_groups(sized, 2400)


def chunk_manifest(spark, d):
    s = long_segments(spark, d)
    return C.manifest(s, C.semantic_chunks(s, 600, 800, sized=True), 800, ids=True)


def _covered(spark, d):
    s = long_segments(spark, d)
    return C.overlap(C.manifest(s, C.semantic_chunks(s, 600, 800, sized=True), 800), s)


def chunk_overlap(spark, d):
    return _covered(spark, d).drop("text")


def gappy_overlap(spark, d):
    """The same on segments that keep their gaps."""
    s = long_segments(spark, d).withColumn("seg_idx", F.expr("CAST(seg_idx * 3 + seg_idx % 2 AS INT)"))
    return C.overlap(C.manifest(s, C.semantic_chunks(s, 600, 800, sized=True), 800), s, dense=False).drop("text")


def chunk_hash(spark, d):
    return C.chunk_hashes(_covered(spark, d), "v1")


def _edited(covered):
    edit = (F.col("recording_id") % 7 == 0) & (F.col("seg_idx") == 3)
    return covered.where("recording_id % 11 <> 5").withColumn("text", F.when(edit, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


def chunk_changes(spark, d):
    covered = _covered(spark, d)
    return C.changes(C.chunk_hashes(covered.where("recording_id % 11 <> 4"), "v1"), C.chunk_hashes(_edited(covered), "v1"))


def _state(hashes):
    n = F.col("recording_id") + F.col("chunk_no")
    return hashes.where("recording_id % 5 <> 0").select(
        "recording_id",
        "chunk_no",
        F.when(n % 4 == 0, "processing").when(n % 4 == 1, "failed").otherwise("completed").alias("status"),
        (n % 5).cast("int").alias("attempts"),
        F.when(n % 6 == 2, F.lit("stale")).otherwise(F.col("input_hash")).alias("input_hash"),
        F.when(n % 3 != 0, F.lit("out")).alias("output_hash"),
        ((n % 2) * 1_000_000).alias("started_ms"),
    )


def chunk_run_plan(spark, d):
    hashes = chunk_hash(spark, d)
    return C.run_plan(hashes, _state(hashes), 1_500_000)


def extract_items(spark, d):
    return C.extract_items(_covered(spark, d))


def reuse_verdicts(spark, d):
    hashes = kept(chunk_hash(spark, d))  # used four times; else each builds all chunks anew
    n = F.col("recording_id") + F.col("chunk_no")
    state = _state(hashes).withColumnRenamed("input_hash", "known_hash").select("recording_id", "chunk_no", "status", "known_hash", "output_hash")
    outputs = hashes.where(n % 7 != 6).select("recording_id", "chunk_no", (n % 9 != 4).alias("parses"), (F.col("chunk_no") + F.when(n % 10 == 7, 1).otherwise(0)).alias("told_chunk"), F.when(n % 11 != 8, F.col("input_hash")).otherwise("other").alias("told_hash"), F.when(n % 13 != 9, "out").otherwise("edited").alias("actual_hash"))
    return C.reuse_verdicts(hashes, state, outputs, hashes.where(n % 17 == 3))


def run_statistics(spark, d):
    return C.run_statistics(chunk_run_plan(spark, d))


def _count_words(batches):
    """An extractor as a user would bring it."""
    for batch in batches:
        yield batch.assign(n_words=[len(t.split()) for t in batch["text"]])[["recording_id", "chunk_no", "seg_idx", "n_words"]]


def mapped_chunks(spark, d):
    return C.map_chunks(_covered(spark, d), _count_words, "recording_id long, chunk_no int, seg_idx int, n_words long")


QUERIES = {
    f.__name__: f
    for f in (segments_short, segments_long, transcript_text, clean_lines, fallback_segments, sentences, action_sentences, keyword_topk, glossary_topk, corpus_terms, term_sketches, extractive_memo, chunk_correction, chunk_semantic, chunk_long, chunk_long_correction, pack_long, chunk_manifest, chunk_overlap, chunk_hash, chunk_changes, chunk_run_plan, extract_items, reuse_verdicts, run_statistics, mapped_chunks, gappy_overlap)
}

_STOP = ", ".join(f"'{w}'" for w in K.STOP)
_SENTENCES = rf"""sentences AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?。요다])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: {SQUEEZE.format('x')}), lambda x: length(x) >= 3) AS s FROM documents)))"""


def _tokens(source: str, key: str) -> str:
    return f"""tokens AS (
  SELECT {key}, CAST(seg_idx AS BIGINT) * 1000000 + i - 1 AS pos, t[i] AS surface FROM (SELECT {key}, seg_idx, t, unnest(range(1, len(t) + 1)) AS i FROM (
    SELECT {key}, seg_idx, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM {source})))"""


def _top(key: str, term: str, k: int) -> str:
    return f"""top AS (SELECT * FROM (
  SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY n DESC, folded) AS INTEGER) AS rank, term, n FROM (
    SELECT {key}, {term} AS folded, count(*) AS n, arg_min(surface, pos) AS term FROM tokens WHERE {term} NOT IN ({_STOP}) GROUP BY 1, 2)) WHERE rank <= {k})"""


_SEMANTIC = """chunked AS (
  SELECT recording_id, seg_idx, 1 AS chunk_no, length(text) AS size FROM long_segments WHERE seg_idx = 0
  UNION ALL
  SELECT s.recording_id, s.seg_idx, CASE WHEN size + length(s.text) + (CASE WHEN size > 0 THEN 1 ELSE 0 END) > 600 THEN chunk_no + 1 ELSE chunk_no END,
    CASE WHEN size + length(s.text) + (CASE WHEN size > 0 THEN 1 ELSE 0 END) > 600 THEN length(s.text) ELSE size + length(s.text) + (CASE WHEN size > 0 THEN 1 ELSE 0 END) END
  FROM chunked c JOIN long_segments s ON s.recording_id = c.recording_id AND s.seg_idx = c.seg_idx + 1)"""
_MANIFEST = """manifest AS (
  SELECT recording_id, chunk_no, min(seg_idx) AS p_start, max(seg_idx) AS p_end, count(*) AS n_segments, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) > 800 AS too_long, list(seg_idx ORDER BY seg_idx) AS segment_ids
  FROM chunked JOIN long_segments USING (recording_id, seg_idx) GROUP BY 1, 2)"""
_COVERED = """covered AS (
  SELECT m.recording_id, chunk_no, seg_idx, seg_idx BETWEEN p_start AND p_end AS is_primary, text
  FROM manifest m JOIN long_segments s ON s.recording_id = m.recording_id AND s.seg_idx BETWEEN greatest(0, p_start - 2) AND p_end + 2)"""
_CHUNKS = f"WITH RECURSIVE {LONG}, {_SEMANTIC}, {_MANIFEST}, {_COVERED}"


def _hashes(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT recording_id, chunk_no, sha256(string_agg(CAST(seg_idx AS VARCHAR) || chr(30) || (CASE WHEN is_primary THEN 'p' ELSE 'o' END) || chr(30) || text, chr(29) ORDER BY seg_idx) || chr(31) || 'v1') AS input_hash
  FROM {source} GROUP BY 1, 2)"""


SQL = {
    "segments_short": f"WITH {SHORT} SELECT * FROM short_segments",
    "segments_long": f"WITH {LONG} SELECT * FROM long_segments",
    "transcript_text": f"WITH {SHORT} SELECT recording_id, coalesce(string_agg(text, chr(10) ORDER BY seg_idx) FILTER (text <> ''), '{S.NO_RESULT}') AS text FROM short_segments GROUP BY 1",
    "clean_lines": f"""WITH l AS (SELECT doc_id, {LINES} AS l FROM documents),
      k AS (SELECT doc_id, list_transform(list_filter(range(1, len(l) + 1), lambda i: i = 1 OR l[i] <> l[i - 1]), lambda i: l[i]) AS l FROM l)
      SELECT doc_id, array_to_string(l, chr(10)) AS text, len(l) AS n_lines FROM k""",
    "fallback_segments": f"""WITH l AS (SELECT doc_id, n_chars * 60 AS d, {LINES} AS l FROM documents),
      s AS (SELECT doc_id, l, greatest(2000, d // len(l)) AS step, unnest(range(1, len(l) + 1)) AS i FROM l WHERE len(l) > 0)
      SELECT doc_id AS recording_id, CAST(i - 1 AS INTEGER) AS seg_idx, (i - 1) * step AS start_ms, i * step AS end_ms, l[i] AS text FROM s""",
    "sentences": f"WITH {_SENTENCES} SELECT * FROM sentences",
    "action_sentences": f"""WITH {_SENTENCES}, h AS (SELECT *, {' OR '.join(f"contains(lower(sentence), '{c}')" for c in CUES)} AS hit FROM sentences),
      a AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS some_hit FROM h),
      r AS (SELECT doc_id, some_hit, sentence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS rank FROM a WHERE hit OR NOT some_hit)
      SELECT doc_id, rank, sentence FROM r WHERE rank <= CASE WHEN some_hit THEN 6 ELSE 4 END""",
    "keyword_topk": f"WITH {SHORT}, {_tokens('short_segments', 'recording_id')}, {_top('recording_id', 'lower(surface)', 8)} SELECT * FROM top",
    "glossary_topk": f"WITH {SHORT}, {_tokens('short_segments', 'recording_id')}, {_top('recording_id', 'surface', 20)} SELECT * FROM top",
    "corpus_terms": f"""WITH {SHORT}, {_tokens('short_segments', 'recording_id')}
      SELECT surface AS term, count(*) AS n, count(DISTINCT recording_id) AS n_recordings FROM tokens WHERE surface NOT IN ({_STOP}) GROUP BY 1 ORDER BY n DESC, term LIMIT 100""",
    "extractive_memo": f"""WITH {_SENTENCES}, d AS (SELECT doc_id, 0 AS seg_idx, text FROM documents), {_tokens('d', 'doc_id')}, {_top('doc_id', 'lower(surface)', 3)},
      t AS (SELECT doc_id, string_agg(term, ' · ' ORDER BY rank) AS topic FROM top GROUP BY 1)
      SELECT s.doc_id, coalesce(any_value(topic), '') AS topic, substring(string_agg(sentence, ' ' ORDER BY pos) FILTER (pos < 3), 1, 180) AS core, string_agg(substring(sentence, 1, 90), ' / ' ORDER BY pos) AS flow
      FROM sentences s LEFT JOIN t USING (doc_id) WHERE pos < 4 GROUP BY 1""",
    "chunk_correction": f"""WITH RECURSIVE {LONG}, chunked AS (
      SELECT recording_id, seg_idx, 1 AS chunk_no, length(text) + 1 AS chars, 1 AS n, start_ms AS first FROM long_segments WHERE seg_idx = 0
      UNION ALL
      SELECT recording_id, seg_idx, CASE WHEN stop THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN stop THEN 0 ELSE chars END + size + 1, CASE WHEN stop THEN 0 ELSE n END + 1, CASE WHEN stop THEN start_ms ELSE first END
      FROM (SELECT s.recording_id, s.seg_idx, chunk_no, chars, n, first, s.start_ms, length(s.text) AS size, chars >= 1200 OR s.end_ms - first >= 60000 OR n >= 35 AS stop
        FROM chunked c JOIN long_segments s ON s.recording_id = c.recording_id AND s.seg_idx = c.seg_idx + 1))
      SELECT recording_id, seg_idx, chunk_no FROM chunked""",
    "chunk_semantic": f"WITH RECURSIVE {LONG}, {_SEMANTIC} SELECT recording_id, seg_idx, chunk_no FROM chunked",
    "chunk_manifest": f"{_CHUNKS} SELECT * FROM manifest",
    "chunk_overlap": f"{_CHUNKS} SELECT recording_id, chunk_no, seg_idx, is_primary FROM covered",
    "chunk_hash": f"{_CHUNKS}, {_hashes('h', 'covered')} SELECT * FROM h",
    "chunk_changes": f"""{_CHUNKS}, old AS (SELECT * FROM covered WHERE recording_id % 11 <> 4),
      new AS (SELECT recording_id, chunk_no, seg_idx, is_primary, CASE WHEN recording_id % 7 = 0 AND seg_idx = 3 THEN text || '!' ELSE text END AS text FROM covered WHERE recording_id % 11 <> 5),
      {_hashes('o', 'old')}, {_hashes('n', 'new')}
      SELECT recording_id, chunk_no, CASE WHEN o.input_hash IS NULL THEN 'new' WHEN n.input_hash IS NULL THEN 'gone' WHEN o.input_hash = n.input_hash THEN 'same' ELSE 'changed' END AS verdict
      FROM o FULL JOIN n USING (recording_id, chunk_no)""",
    "chunk_run_plan": f"""{_CHUNKS}, {_hashes('h', 'covered')}, s AS (
      SELECT recording_id, chunk_no, CASE WHEN n % 4 = 0 THEN 'processing' WHEN n % 4 = 1 THEN 'failed' ELSE 'completed' END AS status, n % 5 AS attempts,
        CASE WHEN n % 6 = 2 THEN 'stale' ELSE input_hash END AS known, CASE WHEN n % 3 <> 0 THEN 'out' END AS output_hash, (n % 2) * 1000000 AS started_ms
      FROM (SELECT *, recording_id + chunk_no AS n FROM h) WHERE recording_id % 5 <> 0)
      SELECT h.recording_id, h.chunk_no, CASE WHEN status = 'completed' AND output_hash IS NOT NULL AND known = input_hash THEN 'reuse'
        WHEN status = 'processing' AND 1500000 - started_ms <= 900000 THEN 'wait' WHEN coalesce(attempts, 0) >= 3 THEN 'failed' ELSE 'execute' END AS action
      FROM h LEFT JOIN s USING (recording_id, chunk_no)""",
    "extract_items": f"""{_CHUNKS}, own AS (SELECT recording_id, chunk_no, min(seg_idx) AS a, max(seg_idx) AS b, arg_min(text, seg_idx) AS ta, arg_max(text, seg_idx) AS tb FROM covered WHERE is_primary GROUP BY 1, 2)
      SELECT recording_id, chunk_no, 'topics' AS field, 0 AS pos, substring(ta, 1, 60) AS text, [a] AS source_segment_ids FROM own
      UNION ALL SELECT recording_id, chunk_no, 'key_points', 0, substring(ta, 1, 60), [a] FROM own
      UNION ALL SELECT recording_id, chunk_no, 'key_points', 1, substring(tb, 1, 60), [b] FROM own""",
}
_JOINED = f"""{LONG}, j AS (
  SELECT recording_id % 4 AS recording_id, CAST(row_number() OVER (PARTITION BY recording_id % 4 ORDER BY recording_id, seg_idx) - 1 AS INTEGER) AS seg_idx, length(text) AS size FROM long_segments
), q AS (SELECT *, sum(size + 1) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS upto FROM j)"""
#: A chunk's first rows by pointers: each row's is the first that doesn't fit a chunk that begins with it.
_WALK = """walk AS (
  SELECT recording_id, 0 AS at FROM q WHERE seg_idx = 0 UNION ALL SELECT w.recording_id, p.next FROM walk w JOIN p ON p.recording_id = w.recording_id AND p.seg_idx = w.at
), chunked AS (
  SELECT q.recording_id, q.seg_idx, size, CAST(count(w.at) OVER (PARTITION BY q.recording_id ORDER BY q.seg_idx) AS INTEGER) AS chunk_no
  FROM q LEFT JOIN walk w ON w.recording_id = q.recording_id AND w.at = q.seg_idx)"""
_LONG_SIZES = f"""{_JOINED}, p AS MATERIALIZED (
  SELECT a.recording_id, a.seg_idx, greatest(a.seg_idx + 1, b.seg_idx) AS next FROM q a ASOF JOIN q b ON a.recording_id = b.recording_id AND b.upto > a.upto - a.size + 600
), {_WALK}"""
SQL["chunk_long"] = f"WITH RECURSIVE {_LONG_SIZES} SELECT recording_id, seg_idx, chunk_no FROM chunked"
SQL["chunk_long_correction"] = f"""WITH RECURSIVE {_JOINED}, p AS MATERIALIZED (
  SELECT a.recording_id, a.seg_idx, min(b.seg_idx) AS next FROM q a JOIN q b ON a.recording_id = b.recording_id AND b.seg_idx BETWEEN a.seg_idx + 1 AND a.seg_idx + 35
  WHERE b.upto - b.size - (a.upto - a.size) >= 1200 OR (b.seg_idx - a.seg_idx) * 2400 + 1800 >= 60000 OR b.seg_idx - a.seg_idx >= 35 GROUP BY 1, 2
), {_WALK} SELECT recording_id, seg_idx, chunk_no FROM chunked"""
SQL["pack_long"] = f"""WITH RECURSIVE {_LONG_SIZES}, m AS (SELECT recording_id, chunk_no, sum(size) AS size FROM chunked GROUP BY 1, 2),
      g AS (SELECT recording_id, chunk_no, 1 AS group_no, size AS filled FROM m WHERE chunk_no = 1
        UNION ALL SELECT m.recording_id, m.chunk_no, CASE WHEN filled + size > 2400 THEN group_no + 1 ELSE group_no END, CASE WHEN filled + size > 2400 THEN size ELSE filled + size END
        FROM g JOIN m ON m.recording_id = g.recording_id AND m.chunk_no = g.chunk_no + 1)
      SELECT recording_id, chunk_no, group_no FROM g"""
_STATES = SQL["chunk_run_plan"].split("\n      SELECT h.recording_id")[0]
SQL["run_statistics"] = f"""WITH p AS ({SQL["chunk_run_plan"]}) SELECT recording_id, count(*) FILTER (action = 'reuse') AS n_reuse, count(*) FILTER (action = 'wait') AS n_wait, count(*) FILTER (action = 'failed') AS n_failed, count(*) FILTER (action = 'execute') AS n_execute, count(*) AS n_chunks FROM p GROUP BY 1"""
SQL["reuse_verdicts"] = f"""{_STATES}, x AS (SELECT h.recording_id, h.chunk_no, h.recording_id + h.chunk_no AS n, h.input_hash, status, known, output_hash FROM h LEFT JOIN s USING (recording_id, chunk_no))
      SELECT recording_id, chunk_no, CASE WHEN status IS DISTINCT FROM 'completed' THEN 'not_completed' WHEN n % 7 = 6 THEN 'output_missing' WHEN known IS DISTINCT FROM input_hash THEN 'input_changed' WHEN n % 9 = 4 THEN 'output_invalid' WHEN n % 10 = 7 THEN 'chunk_mismatch'
        WHEN n % 11 = 8 THEN 'output_of_other_input' WHEN output_hash IS DISTINCT FROM CASE WHEN n % 13 <> 9 THEN 'out' ELSE 'edited' END THEN 'output_changed' WHEN n % 17 = 3 THEN 'provenance' ELSE 'reusable' END AS reason FROM x"""
SQL["mapped_chunks"] = rf"{_CHUNKS} SELECT recording_id, chunk_no, seg_idx, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM covered"
SQL["gappy_overlap"] = f"{_CHUNKS} SELECT recording_id, chunk_no, CAST(seg_idx * 3 + seg_idx % 2 AS INTEGER) AS seg_idx, is_primary FROM covered"
SQL["term_sketches"] = f"""WITH {SHORT}, {_tokens('short_segments', 'recording_id')}
      SELECT count(*) AS n, count(DISTINCT recording_id) AS n_recordings, count(DISTINCT surface) AS n_terms, true AS recordings_close, true AS terms_close, CAST(10 AS BIGINT) AS n_top, true AS top_close FROM tokens"""
