"""Invariants of the operators, and every query against its SQL."""

import difflib
import glob
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from talefold.operators import chunking as C
from talefold.operators import diffing, evalstt, jobs, lifecycle, titles
from talefold.operators import reduce as R
from talefold.operators import segments as S
from talefold.plans import registry
from talefold.sources import tables

DATA = "/root/testdata/sf0.001"
SEGMENTS = "recording_id long, seg_idx int, speaker string, start_ms long, end_ms long, text string"


def synthetic(spark, n=1000, edit=None):
    topics = ["budget", "hiring", "release", "support", "travel"]
    rows = [(1, i, "AB"[i % 2], 2400 * i, 2400 * i + 1800, f"Segment {i:04d} talks about {topics[i % 5]}" + " again" * (i % 3) + ("!" if i == edit else "")) for i in range(n)]
    return spark.createDataFrame(rows, SEGMENTS)


def covered(s, target=1000, hard=1200):
    return C.overlap(C.manifest(s, C.semantic_chunks(s, target, hard), hard), s)


def test_chunks_partition_a_transcript(spark):
    s = synthetic(spark)
    chunked = C.semantic_chunks(s, 1000, 1200)
    rows = sorted((r.seg_idx, r.chunk_no) for r in chunked.collect())
    assert [i for i, _ in rows] == list(range(1000)) and all(b - a in (0, 1) for (_, a), (_, b) in itertools.pairwise(rows)) and rows[0][1] == 1
    assert all(r.chars <= 1000 and not r.too_long for r in C.manifest(s, chunked, 1200).collect())


def test_an_edit_changes_its_chunk_alone(spark):
    old, new = (C.chunk_hashes(covered(synthetic(spark, edit=e)), "v1") for e in (None, 90))
    plan = C.manifest(synthetic(spark), C.semantic_chunks(synthetic(spark), 1000, 1200)).where("p_start <= 90 AND p_end >= 90").first()
    changed = {r.chunk_no for r in C.changes(old, new).where("verdict <> 'same'").collect()}
    near = {plan.chunk_no} | ({plan.chunk_no - 1} if 90 - plan.p_start < 2 else set()) | ({plan.chunk_no + 1} if plan.p_end - 90 < 2 else set())
    assert plan.chunk_no in changed <= near
    assert C.changes(old, C.chunk_hashes(covered(synthetic(spark)), "v2")).where("verdict = 'same'").count() == 0


def test_resume_leaves_what_is_done(spark):
    hashes = C.chunk_hashes(covered(synthetic(spark)), "v1")
    n = hashes.count()
    state = hashes.where("chunk_no <= 17").select("recording_id", "chunk_no", F.lit("completed").alias("status"), F.lit(1).alias("attempts"), "input_hash", F.lit("x").alias("output_hash"), F.lit(0).cast("long").alias("started_ms"))
    todo = sorted(r.chunk_no for r in C.run_plan(hashes, state, 0).where("action = 'execute'").collect())
    assert todo == list(range(18, n + 1))
    lost = state.withColumn("output_hash", F.when(F.col("chunk_no") != 5, F.col("output_hash")))
    assert 5 in {r.chunk_no for r in C.run_plan(hashes, lost, 0).where("action = 'execute'").collect()}


def test_fold_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(rec, i, "S", 2400 * i, 2400 * i + 1800, "x" * rng.randint(0, 300)) for rec in range(20) for i in range(rng.randint(1, 60))]
    got = {(r.recording_id, r.seg_idx): r.chunk_no for r in C.correction_chunks(spark.createDataFrame(rows, SEGMENTS), 500, 40_000, 9).collect()}
    for rec, group in itertools.groupby(rows, key=lambda r: r[0]):
        no, chars, count, first = 1, 0, 0, 0
        for _, i, _, begin, end, text in group:
            if count and (chars >= 500 or end - first >= 40_000 or count >= 9):
                no, chars, count = no + 1, 0, 0
            first = first if count else begin
            chars, count = chars + len(text) + 1, count + 1
            assert got[rec, i] == no


def test_union_keeps_all_provenance(spark):
    items = spark.createDataFrame([(1, 1, "topics", 0, " Big  Plan ", [3]), (1, 2, "topics", 0, "big plan", [9, 3]), (1, 2, "topics", 1, "", [1]), (1, 1, "topics", 1, "Other", [1])], "recording_id long, chunk_no int, field string, pos int, text string, source_segment_ids array<int>")
    assert [(r.rank, r.text, r.source_segment_ids) for r in R.union_items(items, "recording_id").orderBy("rank").collect()] == [(1, "Other", [1]), (2, " Big  Plan ", [3, 9])]


def test_recogniser_rows(spark):
    raw = spark.createDataFrame([("a", [("one", None, None, (0, 1500)), ("  ", None, None, (1500, 1600)), ("two", None, None, (2000, 900))], None), ("b", None, [("x", 1.5, 2.25, None)])], f"recording_id string, {tables.RECOGNISED}")
    got = [(r.recording_id, r.seg_idx, r.start_ms, r.end_ms, r.text) for r in S.from_recogniser(raw).orderBy("recording_id", "seg_idx").collect()]
    assert got == [("a", 0, 0, 1500, "one"), ("a", 1, 2000, 900_000, "two"), ("b", 0, 1500, 2250, "x")]
    assert [r.seg_idx for r in S.from_recogniser(raw, dense=False, offsets_ms=True).where("recording_id = 'a'").orderBy("seg_idx").collect()] == [0, 2]


def test_similar_titles_lose_no_pair(spark):
    rng = random.Random(4)
    words = ["team", "meeting", "budget", "회의", "주간", "plan", "Q3", "a", "ab"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(80)] + [(90, "weekly team sync notes"), (91, "weekly team sync note"), (92, None)]
    found = {(r.a, r.b) for r in titles.similar_titles(spark.createDataFrame(rows, "id long, title string")).collect()}
    first = {}
    for i, t in rows:
        key = "".join(c for c in (t or "").lower() if c.isalnum())
        if key:
            first.setdefault(key, i)
    reps = sorted((i, t) for t, i in first.items())
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(reps, 2) if x in y or y in x or difflib.SequenceMatcher(None, x, y).ratio() >= titles.RATIO}
    assert found == want and (90, 91) in found


def test_token_edits(spark):
    a = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "same")], "recording_id long, seg_idx int, text string")
    b = spark.createDataFrame([(1, 0, "a x y c d"), (1, 1, "same")], "recording_id long, seg_idx int, text string")
    assert [(r.seg_idx, r.inserted, r.deleted, r.replaced) for r in diffing.edits(a, b).collect()] == [(0, 1, 0, 2)]


def test_stale_owner_changes_nothing(spark):
    schema = "job_id long, recording_id long, generation int, claimed_by string, claim_token string, cancel_requested boolean"
    table = spark.createDataFrame([(1, 7, 1, "new", "t2", False), (3, 8, 1, "new", "t2", False)], schema)
    generations = spark.createDataFrame([(7, 1), (8, 2)], "recording_id long, current_generation int")
    updates = spark.createDataFrame([(1, 1, "old", "t1"), (1, 2, "new", "t2"), (1, 3, "new", "t2"), (1, 4, "old", "t2"), (2, 5, "new", "t2"), (3, 6, "new", "t2")], "job_id long, seq long, worker_id string, claim_token string")
    assert {r.seq: r.verdict for r in jobs.fenced(updates, table, generations).collect()} == {1: "ownership_lost", 2: "overwritten", 3: "applied", 4: "ownership_lost", 5: "ownership_lost", 6: "ownership_lost"}


def test_purge_keeps_what_is_referred_to(spark):
    refs = spark.createDataFrame([(1, 1, 0, "canonical", False), (2, 1, 0, "audio", True)], "file_id long, recording_id long, generation int, role string, active boolean")
    intents = spark.createDataFrame([("p", [1, 2]), ("q", [1, 3])], "purge_id string, file_ids array<long>")
    assert {r.purge_id: (r.n_purgeable, r.ready) for r in lifecycle.purge_plan(intents, refs).collect()} == {"p": (1, False), "q": (2, True)}


def test_every_benchmark_case_gets_runs(spark, tmp_path):
    spark.createDataFrame([(i, "some benchmark passage") for i in range(57)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "web", "benchmark") for i in range(114)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.case_id for r in registry.queries()["stt_case_hits"](spark, str(tmp_path)).collect()) == sorted([*range(57)] * 2)
    assert {r.model: r.n_cases for r in registry.queries()["stt_report"](spark, str(tmp_path)).collect()} == {"web": 114, "all": 114}


def test_deletion_cancels_jobs_once(spark):
    rows = spark.createDataFrame([(1, "a", "queued"), (2, "a", "cancelled"), (3, "b", "stt"), (4, None, "stt")], "job_id long, recording_id string, status string")
    gone = spark.createDataFrame([("a",), ("a",), (None,)], "recording_id string")
    assert [tuple(r) for r in jobs.cancel_deleted(rows, gone).collect()] == [(1, "a", "cancelled", "deleted", "deleted", "cancelled_by_delete")]


def test_keyword_quality(spark):
    rows = spark.createDataFrame([(1, [" ##um ", "x", None]), (2, ["x"] * 9), (3, ["umm"]), (4, None)], "recording_id long, keywords array<string>")
    got = {r.recording_id: tuple(r)[1:] for r in evalstt.keyword_quality(rows, ["um"]).collect()}
    assert got == {1: (3, [" ##um "], False), 2: (9, [], False), 3: (1, [], True), 4: (0, [], True)}


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from talefold.streaming import jobs as streaming

    events = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("user_id AS job_id", "event_id", "CAST(ts AS timestamp) AS ts", "event_type AS event", "'t' AS claim_token")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    streaming.run_once(stream(), f"{tmp_path}/changes", f"{tmp_path}/c1", streaming.progress_changes)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/changes").select("job_id", "event_id", "event").collect()))
    assert got == sorted(map(tuple, jobs.progress_changes(events.withColumn("ts", F.col("ts"))).select("job_id", "event_id", "event").collect()))
    uploads = stream().selectExpr("job_id % 20 AS client_key", "ts AS uploaded_at")
    for turn in range(2):
        streaming.write_new(uploads, f"{tmp_path}/live", f"{tmp_path}/c2-{turn}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/live").count() == spark.read.parquet(f"{tmp_path}/in").selectExpr("job_id % 20 AS k").distinct().count()


def test_upload_stream_takes_each_key_once(spark, tmp_path):
    from talefold.streaming import jobs as streaming

    rows = [(i % 7, f"2024-01-01 00:{i:02d}:00") for i in range(30)]
    spark.createDataFrame(rows, "client_key long, t string").selectExpr("client_key", "CAST(t AS timestamp) AS uploaded_at").coalesce(1).write.parquet(f"{tmp_path}/up")
    stream = spark.readStream.schema("client_key long, uploaded_at timestamp").parquet(f"{tmp_path}/up")
    streaming.run_once(stream, f"{tmp_path}/once", f"{tmp_path}/c", streaming.ingest_once)
    assert sorted(r.client_key for r in spark.read.parquet(f"{tmp_path}/once").collect()) == list(range(7))


def test_lease_sessions_equal_their_batch_twin(spark, tmp_path):
    from talefold.streaming import jobs as streaming

    rng = random.Random(3)
    rows, n = [], 0
    for job in range(5):
        at = 0
        for _ in range(20):
            at += rng.choice([20, 20, 20, 89, 91, 300])
            rows.append((job, "t", n := n + 1, at))
    rows.append((99, "t", n + 1, 10_000_000))  # moves the watermark on
    table = spark.createDataFrame(rows, "job_id long, claim_token string, event_id long, s long").selectExpr("*", "timestamp_seconds(1700000000 + s) AS ts")
    table.coalesce(1).write.parquet(f"{tmp_path}/beats")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/beats")
    streaming.run_once(stream, f"{tmp_path}/sessions", f"{tmp_path}/c", streaming.lease_sessions)
    got = sorted((r.job_id, r.first_at, r.last_at, r.n) for r in spark.read.parquet(f"{tmp_path}/sessions").collect())
    want = sorted((r.job_id, r.first_at, r.last_at, r.n) for r in jobs.lease_episodes(table.where("job_id < 99"), 90).collect())
    assert got == want and len(want) > 10


def test_catalog_and_sinks(spark, tmp_path):
    import json

    for name in ("rec1", "rec2", ".hidden", "trash"):
        (tmp_path / "root" / name).mkdir(parents=True)
        (tmp_path / "root" / name / "metadata.json").write_text(json.dumps({"title": name, "recorded_at": "2024-01-01 10:00", "duration_sec": 5}))
    assert {(r.recording_id, r.title) for r in tables.catalog(spark, f"{tmp_path}/root/*/metadata.json").collect()} == {("rec1", "rec1"), ("rec2", "rec2")}
    (tmp_path / "root" / "rec1" / "stt.json").write_text('{"transcription": [{"text": "hi", "offsets": {"from": 0, "to": 2000}}]}')
    (tmp_path / "root" / "rec2" / "stt.json").write_text("{broken")
    read = tables.recogniser_json(spark, f"{tmp_path}/root/*/stt.json")
    assert {r.recording_id: r.transcription and r.transcription[0].text for r in read.collect()} == {"rec1": "hi", "rec2": None}
    rows = spark.range(20).selectExpr("id AS recording_id", "concat('t', id) AS text")
    tables.write_json(rows, f"{tmp_path}/json", 3)
    tables.write_text(rows, f"{tmp_path}/text", 3)
    tables.write_json(rows.where("recording_id < 5").selectExpr("recording_id", "'new' AS text"), f"{tmp_path}/json", 3)
    assert spark.read.json(f"{tmp_path}/json").where("text = 'new'").count() == 5
    assert spark.read.text(f"{tmp_path}/text").where("value LIKE '# %'").count() == 20


def test_similar_titles_of_any_length(spark):
    """The bounds on common subsequences agree with the exact ratio for long and short texts."""
    rng = random.Random(6)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcde회의") for _ in range(rng.choice([3, 20, 63, 64, 65, 90])))
        b = "".join(rng.choice("abcde회의") if rng.random() < rng.choice([0.1, 0.3, 0.6]) else c for c in a)[rng.randint(0, 5) :]
        pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select(diffing.alike("a", "b", titles.RATIO)).collect()
    assert [r[0] for r in got] == [difflib.SequenceMatcher(None, a, b).ratio() >= titles.RATIO for a, b in pairs]


def test_title_similarity(spark):
    rows = {r.id: r.ratio_e4 for r in registry.queries()["title_similarity"](spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").selectExpr("page_id", "regexp_extract(html, '<title>([^<]*)</title>', 1) AS t").collect()
    known = {r.page_id: r.t for r in pages}
    want = {i: difflib.SequenceMatcher(None, known[i - 1], t).ratio() * 10_000 for i, t in known.items() if i - 1 in known}
    assert set(rows) == set(want) and all(abs(rows[i] - x) <= 1 for i, x in want.items())


def test_recovered_json(spark):
    from talefold.operators import outputs

    texts = ['{"a": 1}', "noise: x\n[1]", 'so\n```json\n{"b": "}"}\n``` or {', "{ {", "", None, 'x {"c": {}} y } z', '```\n{bad}\n``` {"d": 1}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", outputs.recovered_json(F.col("t"), ["noise:"]).alias("j")).collect()
    assert {r.i: r.j for r in rows} == {0: '{"a": 1}', 1: "[1]", 2: '{"b": "}"}', 3: None, 4: None, 5: None, 6: None, 7: None}


def test_recorded_at(spark):
    from talefold.functions import recordings

    texts = ["2024-03-05 10:20:30", "2024-03-05 10:20", "2024-03-05T10:20:30+09:00", "2024-03-05T10:20:30Z", "2024-03-05", "", None, "soon"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", F.unix_seconds(recordings.recorded_at(F.col("t"), F.lit("1970-01-01 00:00:00").cast("timestamp"))).alias("s")).collect()}
    noon = 1709601630  # 2024-03-05 01:20:30 UTC
    assert got == {0: noon, 1: noon - 30, 2: noon, 3: noon + 32_400, 4: noon - 37_230, 5: 0, 6: 0, 7: 0}


def test_notes_are_written_by_bucket(spark, tmp_path):
    notes = spark.range(50).selectExpr("id AS recording_id", "concat('n', id) AS markdown")
    tables.write_notes(notes, f"{tmp_path}/notes", 4)
    assert spark.read.parquet(f"{tmp_path}/notes").count() == 50


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    frame = registry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    result = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    want = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    assert sorted(names) == columns
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect()) == sorted(repr(tuple(map(plain, r))) for r in want)
