"""Queries of leases and late rows in their batch forms, and their SQL; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.plans.queries import register, t
from regspark.streaming import leases, windows


def v_lease_events(spark, d):
    status = F.when(F.col("event_type") == "click", "leased").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("heartbeat")
    key = F.when(F.col("event_type") != "view", F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")))
    return t(spark, d, "events").select((F.col("user_id") % 20).alias("session"), "ts", key.alias("key"), status.alias("status"))


@register("expired_leases", """
WITH e AS (SELECT user_id % 20 AS session, ts, CASE WHEN event_type <> 'view' THEN 'f' || event_id % 5 END AS key,
  CASE event_type WHEN 'click' THEN 'leased' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'heartbeat' END AS status FROM events),
x AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM e),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts RANGE UNBOUNDED PRECEDING) AS spell FROM x),
k AS (SELECT session, spell, key, min(ts) AS a, max(ts) AS b, count(*) AS n, arg_max(status, (ts, status)) AS said FROM y GROUP BY ALL),
s AS (SELECT session, spell, min(a) AS start, max(b) AS last, sum(n)::BIGINT AS beats, coalesce(string_agg(key, ',' ORDER BY key) FILTER (said = 'leased' AND key IS NOT NULL), '') AS freed FROM k GROUP BY ALL)
SELECT session, start, last, beats, freed FROM s WHERE epoch_us(last) + 1800000000 < epoch_us(TIMESTAMP '2024-01-30 00:00:00')""")
def expired_leases(spark, d):
    out = leases.expired_leases(v_lease_events(spark, d), F.lit("2024-01-30 00:00:00").cast("timestamp"), 1800)
    return out.withColumn("freed", F.array_join("freed", ","))


def v_arrivals(spark, d):
    """Events in ten batches or more; every thirteenth comes two batches late."""
    e = t(spark, d, "events")
    n = e.agg(F.max("event_id").alias("most"))
    late = F.when(F.col("event_id") % 13 == 0, 2).otherwise(0)
    return e.crossJoin(F.broadcast(n)).select((F.floor(F.col("event_id") * 10 / (F.col("most") + 1)) + late).alias("batch"), "ts", F.col("event_type").alias("by"))


@register("late_windows", """
WITH a AS (SELECT event_id * 10 // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 13 = 0 THEN 2 ELSE 0 END AS batch, ts, event_type AS "by" FROM events),
m AS (SELECT batch, max(max(epoch_us(ts))) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 43200000000 AS mark FROM a GROUP BY batch),
w AS (SELECT batch, epoch_us(ts) // 86400000000 * 86400 AS start, "by", mark FROM a JOIN m USING (batch))
SELECT start, "by", count(*) FILTER (NOT coalesce((start + 86400) * 1000000 <= mark, false)) AS on_time, count(*) FILTER ((start + 86400) * 1000000 <= mark) AS late FROM w GROUP BY ALL""")
def late_windows(spark, d):
    return windows.late_windows(v_arrivals(spark, d), 86_400, 43_200)
