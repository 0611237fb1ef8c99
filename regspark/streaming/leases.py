"""Sessions that hold keys, and give them up when their heartbeats stop (INC-3).

Every event of a session is a heartbeat. Heartbeats at most ``timeout`` seconds apart are one spell; a spell that
has been silent for longer has expired, and the keys whose last word in it is that they are leased are free again.
The batch form takes a log and a point in time. The stream form keeps open spells as state, with an event-time timer
on the one that expires first, and gives the same rows once the watermark has passed that point.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TIMEOUT = 600
_OUT = "session {}, start timestamp, last timestamp, beats long, freed array<string>"


def expired_leases(events: DataFrame, as_of, timeout: int = TIMEOUT) -> DataFrame:
    """(session, start, last, beats, freed): expired spells and the keys that they free, sorted. events: session,
    ts, key, status (``leased`` holds a key, anything else gives it up; a null key is a heartbeat alone). Events
    without a time or session don't count; of equal times the larger status is the last."""
    w = Window.partitionBy("session").orderBy("ts")
    known = events.filter("ts IS NOT NULL AND session IS NOT NULL").select("session", F.col("ts").cast("timestamp").alias("ts"), "key", "status")
    silent = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > timeout * 1_000_000
    spells = known.withColumn("spell", F.sum(silent.cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    spells = spells.withColumn("spell", F.coalesce("spell", F.lit(0)))
    by_key = spells.groupBy("session", "spell", "key").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("beats"), F.max(F.struct("ts", F.coalesce("status", F.lit("")).alias("s")))["s"].alias("status"))
    held = F.when((F.col("status") == "leased") & F.col("key").isNotNull(), F.col("key"))
    out = by_key.groupBy("session", "spell").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("beats").alias("beats"), F.sort_array(F.collect_list(held)).alias("freed"))
    return out.filter(F.unix_micros("last") + timeout * 1_000_000 < F.unix_micros(as_of)).drop("spell")


class Spells:
    """A session's open spells: lists of first and last time (microseconds), beats, and {key: (time, status)}."""

    def __init__(self, text: str | None, timeout: int):
        self.open, self.timeout = json.loads(text) if text else [], timeout * 1_000_000

    def add(self, ts: int, key: str | None, status: str) -> None:
        one = [ts, ts, 1, {} if key is None else {key: [ts, status]}]
        rest = []
        for s in self.open:  # an event out of order may join two spells
            if s[0] - self.timeout <= one[1] and one[0] <= s[1] + self.timeout:
                words = s[3]
                for k, said in one[3].items():
                    words[k] = max(words.get(k, said), said)
                one = [min(s[0], one[0]), max(s[1], one[1]), s[2] + one[2], words]
            else:
                rest.append(s)
        self.open = [*rest, one]

    def expired(self, watermark: int) -> list:
        gone = [s for s in self.open if s[1] + self.timeout < watermark]
        self.open = [s for s in self.open if s[1] + self.timeout >= watermark]
        return gone

    def next_timer(self) -> int:
        """Milliseconds at which the first spell expires."""
        return (min(s[1] for s in self.open) + self.timeout) // 1000 + 1


def lease_stream(events: DataFrame, watermark: str = "10 minutes", timeout: int = TIMEOUT) -> DataFrame:
    """``expired_leases`` on a stream, in append mode: a spell comes out when the watermark has passed its end by
    the timeout. Events older than the watermark are left out by Spark (count them with ``late_windows``)."""
    kind = events.schema["session"].dataType.simpleString()
    known = events.filter("ts IS NOT NULL AND session IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    known = known.select("session", "ts", F.unix_micros("ts").alias("at"), F.col("key").cast("string").alias("key"), F.coalesce("status", F.lit("")).alias("status"))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spells = Spells(state.get[0] if state.exists else None, timeout)
        for batch in batches:
            for ts, key, status in zip(batch["at"], batch["key"], batch["status"], strict=True):
                spells.add(int(ts), key if isinstance(key, str) else None, status)
        gone = spells.expired(state.getCurrentWatermarkMs() * 1000)
        if spells.open:
            state.update((json.dumps(spells.open),))
            state.setTimeoutTimestamp(max(spells.next_timer(), state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if gone:
            when = lambda i: pd.to_datetime([s[i] for s in gone], unit="us")
            freed = [sorted(k for k, (_, said) in s[3].items() if said == "leased") for s in gone]
            yield pd.DataFrame({"session": [group[0]] * len(gone), "start": when(0), "last": when(1), "beats": [s[2] for s in gone], "freed": freed})

    return known.groupBy("session").applyInPandasWithState(step, _OUT.format(kind), "spells string", "append", GroupStateTimeout.EventTimeTimeout)
