"""Streams against their batch forms."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from regspark.plans.streams import v_arrivals, v_lease_events
from regspark.sources.scratch import scratch_path
from regspark.streaming import incremental, leases, windows

D = "/root/testdata/sf0.001"
START = datetime(2024, 3, 1)


def drain(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return frame.sparkSession.table(name)


def files(df, path, column):
    """A file for each value of a column, read one after the other."""
    import os
    import time

    for value in [r[0] for r in df.select(column).distinct().orderBy(column).collect()]:
        df.filter(F.col(column) == value).coalesce(1).write.mode("append").parquet(str(path))
        for f in os.listdir(path):
            if f.endswith(".parquet") and os.path.getmtime(path / f) > 10**9 + 10**6:
                os.utime(path / f, (10**9 + value, 10**9 + value))
        time.sleep(0)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_lease_stream_equals_batch_on_events(spark, tmp_path):
    events = v_lease_events(spark, D).withColumn("part", F.ntile(6).over(__import__("pyspark").sql.Window.orderBy("ts")))
    stream = files(events, tmp_path / "in", "part").drop("part")
    got = drain(leases.lease_stream(stream, "1 minute", 1800), "lease_stream")
    most = events.agg(F.max("ts")).first()[0]
    want = leases.expired_leases(events, F.lit(most) - F.expr("interval 1 minute"), 1800)
    rows = lambda df: sorted((r.session, r.start, r.last, r.beats, r.freed) for r in df.collect())
    assert len(rows(want)) > 20 and rows(got) == rows(want)


def test_lease_stream_joins_spells_out_of_order(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for s in range(6):
        at = 0
        for i in range(60):
            at += rng.choice([30, 200, 590, 600, 601, 900])
            rows.append((s, START + timedelta(seconds=at), rng.choice(["a", "b", "c", None]), rng.choice(["leased", "leased", "completed", None]), i // 10))
    rows.append((99, START + timedelta(days=2), None, None, 6))
    shuffled = [(s, t, k, w, max(0, p + rng.choice([0, 0, 1]))) for s, t, k, w, p in rows]  # a part late, within the watermark
    df = spark.createDataFrame(shuffled, "session int, ts timestamp, key string, status string, part int")
    got = drain(leases.lease_stream(files(df, tmp_path / "in", "part").drop("part"), "3 hours"), "lease_shuffled")
    want = leases.expired_leases(df, F.lit(START + timedelta(days=1, hours=21)))
    rows_of = lambda d: sorted((r.session, r.start, r.last, r.beats, tuple(r.freed)) for r in d.collect())
    assert rows_of(got) == rows_of(want) and len({r[0] for r in rows_of(got)}) == 6


def test_odd_lease_events(spark):
    df = spark.createDataFrame([(1, None, "a", "leased"), (None, START, "a", "leased"), (2, START, None, None), (2, START, "k", "leased"), (2, START, "k", "leased")], "session int, ts timestamp, key string, status string")
    assert [(r.session, r.beats, r.freed) for r in leases.expired_leases(df, F.lit(START + timedelta(hours=1))).collect()] == [(2, 3, ["k"])]
    assert leases.expired_leases(df.limit(0), F.current_timestamp()).count() == 0


def test_late_rows_are_counted_once(spark, tmp_path):
    arrivals = v_arrivals(spark, D).withColumn("batch", F.col("batch").cast("int"))
    store = windows.window_store(spark, scratch_path(spark, "windows-test"))
    stream = files(arrivals, tmp_path / "in", "batch")
    query = windows.count_stream(stream, store, 86_400, 43_200, str(tmp_path / "mark"))
    assert query.awaitTermination(300) and query.exception() is None
    got = {(r.start, r.by): (r.on_time, r.late) for r in windows.counted(store).collect()}
    want = {(r.start, r.by): (r.on_time, r.late) for r in windows.late_windows(arrivals, 86_400, 43_200).collect()}
    assert got == want and sum(a + b for a, b in got.values()) == arrivals.count() and sum(b for _, b in got.values()) > 0
    # the stream's log is lost: the same batches come again, and nothing changes
    again = windows.count_stream(stream, store, 86_400, 43_200, str(tmp_path / "other"))
    assert again.awaitTermination(300)
    assert {(r.start, r.by): (r.on_time, r.late) for r in windows.counted(store).collect()} == want


def test_job_stream_drops_repeats(spark, tmp_path):
    rows = [("j1", "queued", START, 0), ("j1", "queued", START, 0), ("j1", "done", START + timedelta(minutes=5), 1), ("j2", "queued", START, 1), ("j1", "done", START + timedelta(minutes=5), 1)]
    df = spark.createDataFrame(rows, "job string, status string, ts timestamp, part int")
    got = drain(incremental.job_stream(files(df, tmp_path / "in", "part").drop("part")), "job_stream", "complete")
    assert {r.job: (r.status, r.updated) for r in got.collect()} == {"j1": ("done", START + timedelta(minutes=5)), "j2": ("queued", START)}
