"""Ranges, edit scripts, reducers, sketches, files and groups against plain Python."""

import difflib
import hashlib
import itertools
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from talefold.functions import recordings
from talefold.operators import chunking as C
from talefold.operators import diffing, evalstt, groups, reduce_tree, sketches, titles
from talefold.operators import ranges as B
from talefold.operators import reduce as R
from talefold.sources import files, tables


def test_ranges_of_any_width(spark):
    rng = random.Random(1)
    points = [(r, x) for r in range(3) for x in [0, 1, 15, 16, 17, 255, 256, 4095, 4096, 10**9, *(rng.randint(0, 10**9) for _ in range(40))]]
    spans = [(rng.randint(0, 3), n, *sorted((rng.choice(points)[1] + rng.randint(-3, 3), rng.choice(points)[1] + rng.randint(-3, 3)))) for n in range(80)]
    spans += [(0, 100, 0, 10**9), (1, 101, 16, 31), (2, 102, 5, 4), (2, 103, None, 7), (0, 104, 17, 17), (1, 105, -5, 4096)]
    p = spark.createDataFrame(sorted(set(points)), "recording_id int, at long")
    s = spark.createDataFrame(spans, "recording_id int, n int, low long, high long")
    got = sorted((r.recording_id, r["at"], r.n) for r in B.in_ranges(p, s, "recording_id", "at", "low", "high").collect())
    assert got == sorted((r, x, n) for r, x in set(points) for q, n, low, high in spans if q == r and low is not None and low <= x <= high)
    assert s.select(F.max(F.size(B.blocks(F.col("low"), F.col("high"))))).first()[0] < 300
    wide = spark.createDataFrame([(1, 1, 0, 10**9)], "recording_id long, chunk_no int, low int, high int")
    segments = spark.createDataFrame([(1, 0, 0, "a"), (1, 10**9, 0, "b"), (1, 10**9, 1, "later"), (2, 5, 0, "c")], "recording_id long, seg_idx int, pos int, text string")
    assert sorted((r.seg_idx, r.text) for r in C.index_ranges(wide, segments).collect()) == [(0, "a"), (10**9, "later")]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_scripts(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "c1", "회의", "...", "x,y", "#"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 25))), " ".join(word() for _ in range(rng.randint(0, 25)))) for i in range(120)] + [(900, None, "a b"), (901, "", ""), (902, "a " * 60, "b c " * 60)]
    table = spark.createDataFrame(rows, "i int, old string, new string").select("*", diffing.edit_script("old", "new").alias("e"), diffing.least_edits("old", "new").alias("least"))
    for r in table.collect():
        a, b = (re.findall(r"[0-9A-Za-z가-힣]+|[^0-9A-Za-z가-힣\s]+", x or "") for x in (r.old, r.new))
        ops = [o for o in difflib.SequenceMatcher(None, a, b).get_opcodes() if o[0] != "equal"]
        n = {k: sum(max(j - i, m - h) for op, i, j, h, m in ops if op == k) for k in ("insert", "delete", "replace")}
        assert (r.e.inserted, r.e.deleted, r.e.replaced, r.e.distance) == (n["insert"], n["delete"], n["replace"], sum(n.values()))
        assert [(c.op, c.old, c.new) for c in r.e.changes] == [(op, a[i:j], b[h:m]) for op, i, j, h, m in ops][:20]
        assert r.least == plain_edits(a, b) <= r.e.distance


def test_version_report_fills_in(spark):
    fast = spark.createDataFrame([(1, 0, "a b", 5, 6, "heard"), (1, 1, " same ", 7, 8, None), (1, 2, "lost", 9, 10, None)], "recording_id long, seg_idx int, text string, start_ms long, end_ms long, raw_text string")
    final = spark.createDataFrame([(1, 0, "a c d"), (1, 1, "same")], "recording_id long, seg_idx int, text string")
    raw = spark.createDataFrame([(1, 0, 50, None, ""), (1, 1, 70, 80, "raw")], "recording_id long, seg_idx int, start_ms long, end_ms long, text string")
    plan = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 1)], "recording_id long, chunk_no int, p_start int, p_end int")
    report = diffing.version_report(fast, final, raw, plan)
    got = {r.seg_idx: r for r in report.collect()}
    assert [(r.chunk_no, r.start_ms, r.end_ms, r.raw_text, r.mapped, r.changed, r.distance) for _, r in sorted(got.items())] == [(2, 50, 6, "heard", True, True, 2), (2, 70, 80, "raw", True, False, None), (None, 9, 10, "", False, False, None)]
    assert [tuple(c) for c in got[0].changes] == [("replace", ["b"], ["c", "d"])]
    assert tuple(diffing.report_totals(report).first()) == (1, 3, 1, 1, 2)


def items(spark, n_chunks):
    rng = random.Random(3)
    rows = [(r, c, rng.choice(["topics", "key_points"]), p, rng.choice(["Plan A", "plan  a", "Budget", "x" * 30, " ", f"item {rng.randint(0, 400)}"]), [rng.randint(0, 500) for _ in range(rng.randint(0, 3))]) for r, n in enumerate(n_chunks) for c in range(1, n + 1) for p in range(4)]
    return spark.createDataFrame(rows, "recording_id long, chunk_no int, field string, pos int, text string, source_segment_ids array<int>")


def test_reducer_tree_equals_the_union(spark):
    table = items(spark, [1, 5, 90])
    rows = lambda df: sorted((r.recording_id, r.field, r["rank"], r.text, r.source_segment_ids) for r in df.collect())
    tree = reduce_tree.reduce_tree(table, reduce_tree.union_reducer(None), direct=300, limit=400)
    assert rows(tree) == rows(R.union_items(table, "recording_id"))
    levels = {r.recording_id: r.level for r in tree.select("recording_id", "level").distinct().collect()}
    assert levels[0] == 1 and levels[2] > 3
    once = reduce_tree.reduce_tree(table, reduce_tree.union_reducer(), direct=10**6)
    assert rows(once) == rows(R.capped(R.union_items(table, "recording_id")))
    by_hand = C.pack_groups(R.sizes(table.where("recording_id = 1")), 150)
    two = reduce_tree.reduce_tree(table.where("recording_id = 1"), reduce_tree.union_reducer(), direct=400, limit=150)
    if {r.level for r in two.select("level").collect()} == {2}:
        assert rows(two) == rows(R.two_levels(table.where("recording_id = 1"), by_hand).withColumn("level", F.lit(2)))
    assert reduce_tree.reduce_tree(table.limit(0), reduce_tree.union_reducer()).collect() == []


def test_reducer_of_the_users_own(spark):
    """Groups come in order and within the limit, but for two that are too large by themselves."""

    def told(rows):
        size = int(rows["text"].str.len().sum() + len(rows))
        assert rows["unit"].is_monotonic_increasing and (size <= 400 or rows["unit"].nunique() <= 2)
        return pd.DataFrame({"field": ["note"], "text": [f"{size:04d}" * 40], "source_segment_ids": [sorted({int(i) for ids in rows["source_segment_ids"] for i in ids})]})

    table = items(spark, [1, 60])
    out = {r.recording_id: r for r in reduce_tree.reduce_tree(table, told, direct=40, limit=400).collect()}
    assert len(out) == 2 and out[1].level >= 4
    ids = {r.recording_id: sorted(r.ids) for r in table.select("recording_id", F.explode("source_segment_ids").alias("i")).groupBy("recording_id").agg(F.collect_set("i").alias("ids")).collect()}
    assert {k: r.source_segment_ids for k, r in out.items()} == ids


def test_groups_of_the_reducer_share_batches(spark):
    """A group is one call, whole where batches cut it, and far more groups than batches take no batch each."""
    table = items(spark, [30] * 12)

    def told(rows):
        return pd.DataFrame({"field": ["note"], "text": [f"{len(rows)}" if rows["text"].iloc[0] != " " else None], "source_segment_ids": [[]]}).iloc[: 0 if rows["unit"].iloc[0] == 30 else 1]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        units = table.select("recording_id", F.col("chunk_no").alias("unit"), "field", "pos", "text", "source_segment_ids", F.col("chunk_no").alias("group_no"))
        out = reduce_tree._reduced(units, told)
        got = [(r.recording_id, r.unit, r.pos, r.source_segment_ids) for r in out.orderBy("recording_id", "unit").collect()]
        assert got == [(k, n, 0, []) for k in range(12) for n in range(1, 30)] and {r.text for r in out.collect()} <= {"4", None}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    calls = []  # plan nodes that call Python for each group apart
    kept_, reduce_tree.kept = reduce_tree.kept, lambda df: calls.append(df._jdf.queryExecution().executedPlan().toString()) or df
    try:
        reduce_tree._reduced(units, told)
    finally:
        reduce_tree.kept = kept_
    assert "MapInPandas" in calls[0] and "FlatMapGroups" not in calls[0]


def test_daily_states_merge(spark):
    rng = random.Random(4)
    rows = [(d, d * 1000 + rng.randint(0, 300), f"t{min(rng.randint(1, 4000), rng.randint(1, 4000), rng.randint(1, 4000))}") for d in range(5) for _ in range(4000)]
    table = spark.createDataFrame(rows, "day int, recording_id long, term string")
    states = sketches.day_states(table)
    whole = sketches.merged(states)
    got = sketches.counts(whole).first()
    assert got.n == 20_000
    assert abs(got.n_recordings - len({r for _, r, _ in rows})) <= 0.03 * len({r for _, r, _ in rows})
    assert abs(got.n_terms - len({t for *_, t in rows})) <= 0.03 * len({t for *_, t in rows})
    counted = pd.Series([t for *_, t in rows]).value_counts()
    top = {r.term: r.n for r in sketches.frequent(whole, 10).collect()}
    assert sorted(top.values(), reverse=True) == counted.head(10).tolist() and all(counted[t] == n for t, n in top.items())
    some = sketches.merged(states.where("day < 2"))
    assert sketches.counts(some).first().n == 8000


def test_files_by_content(spark, tmp_path):
    bodies = {"a.txt": b"one", "deep/b.bin": bytes(range(256)) * 5000, "deep/er/c.txt": b"c"}
    (tmp_path / "here").mkdir()
    (tmp_path / "here" / "empty").write_bytes(b"")
    for name, body in bodies.items():
        (tmp_path / "here" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "here" / name).write_bytes(body)
    local = files.file_digests(spark, f"{tmp_path}/here")
    assert {r.path: (r.size, r.md5, r.sha256) for r in local.collect()} == {n: (len(b), hashlib.md5(b).hexdigest(), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}
    remote = spark.createDataFrame([("a.txt", 3, "0" * 32), ("deep/b.bin", 1, "x"), ("moved.txt", 1, hashlib.md5(b"c").hexdigest()), ("other", 1, "y")], "path string, size long, md5 string")
    assert {r.path: r.verdict for r in files.copies(local, remote).collect()} == {"a.txt": "md5_differs", "deep/b.bin": "size_differs", "deep/er/c.txt": "missing"}
    assert sorted(r.path for r in files.unlisted(local, remote).collect()) == ["a.txt", "deep/b.bin", "other"]


def test_components(spark):
    rng = random.Random(5)
    links = [(i + 1, i) for i in range(70)] + [(200 + i, 199) for i in range(1, 30)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    low = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(100):
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    table = spark.createDataFrame(links, "a long, b long")
    assert {r.id: r.group_id for r in groups.components(table).collect()} == low
    assert groups.components(table.limit(0)).collect() == []


def test_curated_titles_join_no_group(spark):
    names = ["weekly team sync notes", "weekly team sync note", "Weekly Team Sync", "budget", "budget!", "other thing", "weekly team sync notes 2"]
    rows = [(i, t, "fixed" if i in (1, 4) else None) for i, t in enumerate(names)]
    got = {r.id: (r.group_id, r.n) for r in titles.collision_groups(spark.createDataFrame(rows, "id long, title string, reason string"), ["fixed"]).collect()}
    assert got == {0: (0, 3), 2: (0, 3), 6: (0, 3)}
    free = {r.id for r in titles.collision_groups(spark.createDataFrame(rows, "id long, title string, reason string")).collect()}
    assert free == {0, 1, 2, 3, 4, 6} and all(a < b for a, b in itertools.pairwise(sorted(free)))


def test_title_endings(spark):
    cases = {"회의에서": "회의", "예산을": "예산", "가": "", " plan for the team": "plan", "Notes ing": "Notes", "keep을": "keep을", None: "", "about  things": "things"}
    table = spark.createDataFrame([(k,) for k in cases], "t string")
    out = recordings.without_endings("t", ["서", "에서", "을", "가", "ing"], ["about"], [" for "], ["keep을"])
    assert {r.t: r.o for r in table.select("t", out.alias("o")).collect()} == cases


def test_timed_report(spark):
    hits = spark.createDataFrame([(1, "m", 2, 1, [], 0), (2, "n", 2, 2, [], 1)], "case_id int, model string, n_must long, n_hits long, misses array<string>, n_bad long")
    runs = spark.createDataFrame([("m", 4, 40), ("m", 6, None), ("n", 5, 10)], "model string, elapsed_sec long, audio_sec long")
    got = {r.model: (r.n_hits, r.seconds, r.slowest_sec, r.real_time_permille) for r in evalstt.timed_report(hits, runs).collect()}
    assert got == {"m": (1, 10, 6, 100), "n": (2, 5, 5, 500), None: (3, 15, 6, 180)}
    assert evalstt.timed_report(hits, runs.drop("audio_sec")).where("real_time_permille IS NOT NULL").count() == 0


def test_database_rows(spark):
    url = "jdbc:derby:memory:jobs;create=true"
    rows = spark.range(100).selectExpr("IF(id % 10 = 3, NULL, id * 7) AS job", "CAST(id AS string) AS told")
    rows.write.format("jdbc").option("url", url).option("dbtable", "jobs").mode("overwrite").save()
    got = tables.jdbc_rows(spark, url, "jobs", "job", 5)
    assert got.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    rows.limit(0).write.format("jdbc").option("url", url).option("dbtable", "empty_jobs").mode("overwrite").save()
    assert tables.jdbc_rows(spark, url, "empty_jobs", "job").collect() == []
