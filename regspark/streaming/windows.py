"""Windowed counts in which late rows are counted too (INC-7, INC-8).

Rows come in batches. The watermark of a batch is the largest time of the batches before it, less a delay. A row
whose window ended before its batch's watermark is late: the window has been given out already and stays as it is,
and the row is added to the window's count of late rows. So each row is counted once, on time or late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regspark.sources.store import RecordStore

_STORED = "name string, kind string, start long, by string, n long, turn long"


def window_start(ts, every: int):
    """Seconds since 1970 at which a time's window of ``every`` seconds begins."""
    return F.floor(F.unix_micros(ts) / (every * 1_000_000)) * every


def late_windows(rows: DataFrame, every: int, delay: int, by: str = "by") -> DataFrame:
    """(start, by, on_time, late): counts of each window of ``every`` seconds. rows: batch (its number), ts and the
    column ``by``. Rows without a time don't count."""
    known = rows.filter("ts IS NOT NULL").select("batch", F.col("ts").cast("timestamp").alias("ts"), F.col(by).cast("string").alias("by"))
    per = known.groupBy("batch").agg(F.max(F.unix_micros("ts")).alias("most"))
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # a row a batch
    marks = per.select("batch", (F.max("most").over(before) - delay * 1_000_000).alias("mark"))
    counted = known.groupBy("batch", window_start("ts", every).alias("start"), "by").agg(F.count("*").alias("n")).join(marks, "batch")
    late = F.coalesce((F.col("start") + every) * 1_000_000 <= F.col("mark"), F.lit(False))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return counted.groupBy("start", "by").agg(n(~late).alias("on_time"), n(late).alias("late"))


def window_store(spark: SparkSession, path: str) -> RecordStore:
    return RecordStore(spark, path, _STORED, key="name", order_by="turn", buckets=8)


def count_stream(rows: DataFrame, store: RecordStore, every: int, delay: int, checkpoint: str, by: str = "by", name: str = "windows"):
    """The same over a stream, into a store: each batch is one commit named by its number, so that a replay
    counts nothing twice. Returns the running query."""

    def put(batch: DataFrame, number: int) -> None:
        held = batch.filter("ts IS NOT NULL").select(F.col(by).cast("string").alias("by"), F.col("ts").cast("timestamp").alias("ts")).persist()
        try:
            state = store.read()
            most = held.agg(F.max(F.unix_micros("ts"))).first()[0]
            before = state.filter("kind = 'mark'").agg(F.max("n")).first()[0]
            if most is None:
                return
            after = max(most, before) if before is not None else most
            counted = held.groupBy(window_start("ts", every).alias("start"), "by").agg(F.count("*").alias("n"))
            gone = F.lit(False) if before is None else (F.col("start") + every) * 1_000_000 <= before - delay * 1_000_000
            counted = counted.withColumn("kind", F.when(gone, "late").otherwise("open")).select("kind", "start", "by", "n")
            known = state.filter("kind IN ('open', 'late')").select("kind", "start", "by", "n")
            total = known.unionByName(counted).groupBy("kind", "start", "by").agg(F.sum("n").alias("n"))
            done = (F.col("kind") == "open") & ((F.col("start") + every) * 1_000_000 <= after - delay * 1_000_000)
            label = F.concat_ws("|", F.when(F.col("kind") == "late", "late").otherwise("window"), F.col("start").cast("string"), F.coalesce(F.concat(F.lit("="), "by"), F.lit("null")))
            total = total.select(label.alias("name"), F.when(done, "closed").otherwise(F.col("kind")).alias("kind"), "start", "by", "n")
            mark = store.spark.createDataFrame([("mark", "mark", None, None, after)], "name string, kind string, start long, by string, n long")
            store.upsert(total.unionByName(mark).withColumn("turn", F.lit(number)), f"{name}-{number}")
        finally:
            held.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(store: RecordStore) -> DataFrame:
    """(start, by, closed, on_time, late) of a store's windows."""
    rows = store.read().filter("kind <> 'mark'")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return rows.groupBy("start", "by").agg(F.coalesce(F.bool_or(F.col("kind") == "closed"), F.lit(False)).alias("closed"), n(F.col("kind") != "late").alias("on_time"), n(F.col("kind") == "late").alias("late"))
