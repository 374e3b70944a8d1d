"""Streams under late, shuffled, repeated and replayed input."""

import itertools
import os
import random
import shutil

from pyspark.sql import functions as F

from talefold.operators import jobs
from talefold.streaming import jobs as streaming


def written(spark, rows, schema, path, files):
    """rows as files that a stream takes one by one, in order."""
    for n, some in enumerate(files):
        spark.createDataFrame([rows[i] for i in some], schema).coalesce(1).write.parquet(f"{path}/batch-{n}")
    os.makedirs(f"{path}/in")
    for n in range(len(files)):
        for name in sorted(os.listdir(f"{path}/batch-{n}")):
            if name.endswith(".parquet"):
                shutil.move(f"{path}/batch-{n}/{name}", f"{path}/in/{n:03d}.parquet")
                os.utime(f"{path}/in/{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.read.parquet(f"{path}/in"), lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_shuffled_late_changes_equal_the_batch_twin(spark, tmp_path):
    """Rows come up to five minutes late over many batches; changes are those in order of time, and idle jobs are forgotten."""
    rng, rows = random.Random(1), []
    for i in range(600):
        rows.append((rng.randint(0, 4), i, f"2024-01-01 {i // 60 // 2:02d}:{i // 2 % 60:02d}:{i % 2 * 30:02d}", rng.choice(["a", "a", "b"])))
    order = sorted(range(600), key=lambda i: i + rng.uniform(0, 10))  # 30 seconds a row
    rows.append((99, 999, "2024-01-03 00:00:00", "end"))
    files = [order[i : i + 60] for i in range(0, 600, 60)] + [[600]]
    table, stream = written(spark, rows, "job_id long, event_id long, t string, event string", str(tmp_path), files)
    dated = lambda df: df.withColumn("ts", F.to_timestamp("t")).drop("t")
    streaming.run_once(dated(stream()), f"{tmp_path}/out", f"{tmp_path}/c", lambda s: streaming.ordered_changes(s, "10 minutes", 3_600_000))
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("job_id", "event_id", "event").collect()))
    want = sorted(map(tuple, jobs.progress_changes(dated(table).where("job_id < 99")).select("job_id", "event_id", "event").collect()))
    assert got == want and len(want) > 100
    left = spark.read.format("statestore").load(f"{tmp_path}/c").selectExpr("key.job_id").collect()
    assert [r.job_id for r in left] in ([], [99])


def test_earliest_upload_wins_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, f"2024-01-01 0{k % 3}:{rng.randint(0, 50):02d}:00", f"{k}-{i}") for k in range(12) for i in range(4)]
    rows.append((99, "2024-01-02 00:00:00", "end"))
    order = list(range(48))
    rng.shuffle(order)
    table, stream = written(spark, rows, "client_key long, t string, body string", str(tmp_path), [order[:24], order[24:], [48]])
    dated = lambda df: df.withColumn("uploaded_at", F.to_timestamp("t")).drop("t")
    streaming.run_once(dated(stream()), f"{tmp_path}/out", f"{tmp_path}/c", lambda s: streaming.ingest_earliest(s, "6 hours"))
    got = {r.client_key: r.body for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {k: min(g)[2] for k, g in itertools.groupby(rows[:48], key=lambda r: r[0])}


def test_replayed_batches_add_nothing(spark, tmp_path):
    """The earliest row of each batch's keys is written once, by the first run, by a run from the start and by a batch done again."""
    rows = [(k % 30 if k % 7 else None, f"2024-01-01 00:{59 - k % 60:02d}:00", f"body-{k}") for k in range(120)]
    table, stream = written(spark, rows, "client_key long, t string, body string", str(tmp_path), [range(40), range(40, 80), range(80, 120)])
    dated = lambda: stream().withColumn("uploaded_at", F.to_timestamp("t")).drop("t")
    live, checkpoint = f"{tmp_path}/live", f"{tmp_path}/c"
    streaming.write_new(dated(), live, checkpoint, buckets=8).awaitTermination()
    want = {}
    for some in (rows[:40], rows[40:80], rows[80:]):
        for key, group in itertools.groupby(sorted(some, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])), key=lambda r: r[0]):
            want.setdefault(key, next(group)[2])
    read = lambda: sorted(((r.client_key, r.body) for r in spark.read.parquet(live).collect()), key=str)
    assert read() == sorted(want.items(), key=str)
    os.remove(f"{checkpoint}/commits/2")  # the last batch was written, but its end was not noted
    os.remove(f"{checkpoint}/commits/.2.crc")
    streaming.write_new(dated(), live, checkpoint, buckets=8).awaitTermination()
    assert read() == sorted(want.items(), key=str)
    streaming.write_new(dated(), live, f"{tmp_path}/c2", buckets=8).awaitTermination()
    assert read() == sorted(want.items(), key=str)
