"""Resuming, ledgers and job logs (INC-1, INC-2, INC-4, INC-5, INC-7, INC-8). Ingest is in ``sources.store`` (INC-6),
leases and late rows in ``leases`` and ``windows``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def pending(inventory: DataFrame, completed: DataFrame, failed: DataFrame, leased: DataFrame, n: int | None = None) -> DataFrame:
    """Keys that no one has done, failed or holds, in listing order (INC-1)."""
    busy = completed.select("key").union(failed.select("key")).union(leased.select("key")).distinct()
    out = inventory.join(busy, "key", "left_anti")
    return out.orderBy("key").limit(n) if n else out


def retry_set(inventory: DataFrame, completed: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys not completed, and the failed marks that stay (INC-2)."""
    again = inventory.join(completed.select("key").distinct(), "key", "left_anti")
    return again, failed.join(again.select("key"), "key", "left_anti")


def stale_sessions(heartbeats: DataFrame, as_of, timeout_seconds: int = 600) -> DataFrame:
    """Sessions without a readable heartbeat for the timeout (INC-3). heartbeats: session, heartbeat."""
    last = heartbeats.groupBy("session").agg(F.max("heartbeat").alias("last"))
    return last.filter(F.col("last").isNull() | (F.unix_timestamp(as_of) - F.unix_timestamp("last") > timeout_seconds))


def sessions(heartbeats: DataFrame, gap: str = "10 minutes", watermark: str | None = None) -> DataFrame:
    """Work sessions told by gaps between heartbeats; with a watermark it runs on a stream, and later rows
    than that are left out (INC-3)."""
    df = heartbeats.withWatermark("heartbeat", watermark) if watermark else heartbeats
    return df.groupBy("session", F.session_window("heartbeat", gap).alias("w")).agg(F.count("*").alias("beats")).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def ledger_stats(ledger: DataFrame) -> DataFrame:
    """Completed, failed and held keys of each session (INC-4). ledger: session, status."""
    return ledger.groupBy("session").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "leased")])


def merge_progress(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").union(b.select("key")).distinct()


def job_status(events: DataFrame, as_of, keep: str = "1 hour") -> DataFrame:
    """Each job's newest status and whether it has expired (INC-7). events: job, status, ts."""
    by = events.groupBy("job").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.min("ts").alias("created"), F.max("ts").alias("updated"))
    return by.withColumn("expired", F.col("created") + F.expr(f"interval {keep}") < as_of)


def job_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The same over a stream: repeated events are dropped while their watermark holds."""
    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["job", "status", "ts"])
    return once.groupBy("job").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("updated"))


def crawl_windows(log: DataFrame, every: str = "7 days", by: tuple = ("state", "agency_type")) -> DataFrame:
    """Counts for each window of a crawl log (INC-8). log: ts and the columns of ``by``."""
    return log.groupBy(F.window("ts", every).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")
