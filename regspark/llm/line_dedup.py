"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

The exact tables are references (a line key and a document that holds it, once) and counts (for each key its
documents and the largest id). A key that enough documents hold is *repeated*. For each shard of keys a
cuckoo filter holds fingerprints of the repeated keys. Looking lines up asks the filters first, so that only
references that may be repeated are shuffled to the exact counts, which decide; a filter's false hits change
nothing. Keys can be taken out of a cuckoo filter again: deleting documents lowers counts, keys that are no
longer repeated leave their shard's filter, and the lines that were dropped because of them come back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.common import UPPER, LOWER, free_name, require, stored, table

NAME = "op4_line_dedup"
MIN_CHARS, MIN_DOCS = 40, 5
#: Repeated keys in a shard's filter, on average.
KEYS_PER_SHARD = 100_000
#: The filters are sent to all executors up to this size; beyond it each shard's references are brought to its
#: filter, PROBE_ROWS of them at a time, about.
FILTER_BYTES, PROBE_ROWS = 32 << 20, 500_000
#: Shards, a row each, whose number of slices is sent to all executors.
SENT_SHARDS = 500_000
SPACE = " \t\n\x0b\x0c\r"


# -- cuckoo filter -----------------------------------------------------------------------------
class CuckooFilter:
    """16-bit fingerprints in buckets of four; works on arrays of 64-bit keys."""

    SLOTS, KICKS, LOAD = 4, 500, 0.8

    def __init__(self, buckets: int):
        self.table = np.zeros((1 << max(1, int(buckets - 1).bit_length()), self.SLOTS), np.uint16)
        self.spilled: list[tuple[int, int]] = []  # (fingerprint, bucket) that found no place

    @classmethod
    def holding(cls, keys: np.ndarray) -> CuckooFilter:
        made = cls(int(len(keys) / cls.SLOTS / cls.LOAD) + 1)
        made.insert(keys)
        return made

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self.mix(keys.astype(np.int64).view(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self.other(first, mark)

    def other(self, bucket, mark):
        step = self.mix(np.asarray(mark).astype(np.uint64)) & np.uint64(len(self.table) - 1)
        return np.asarray(bucket) ^ step.astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        rng = np.random.default_rng(len(keys))
        for mark, *both in zip(*self.places(keys), strict=True):
            for bucket in both:
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
            else:
                bucket = both[rng.integers(2)]
                for _ in range(self.KICKS):
                    slot = rng.integers(self.SLOTS)
                    mark, self.table[bucket, slot] = self.table[bucket, slot], mark
                    bucket = int(self.other(bucket, mark))
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = mark
                        break
                else:
                    self.spilled.append((int(mark), int(bucket)))

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted."""
        for mark, *both in zip(*self.places(keys), strict=True):
            for bucket in both:
                found = np.flatnonzero(self.table[bucket] == mark)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
            else:
                self.spilled = [s for s in self.spilled if not (s[0] == mark and s[1] in both)] or []

    def crowded(self) -> bool:
        """Whether further keys would hardly find a place."""
        return len(self.spilled) > 0 or np.count_nonzero(self.table) > 0.93 * self.table.size

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(keys)
        hit = ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)
        for m, b in self.spilled:
            hit |= (mark == m) & ((first == b) | (second == b))
        return hit

    def to_bytes(self) -> bytes:
        spilled = np.array(self.spilled, np.int64).reshape(-1, 2)
        return np.int64(len(spilled)).tobytes() + spilled.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        made = cls(1)
        made.spilled = [tuple(x) for x in np.frombuffer(data, np.int64, 2 * n, 8).reshape(-1, 2).tolist()]
        made.table = np.frombuffer(data, np.uint16, offset=8 + 16 * n).reshape(-1, cls.SLOTS).copy()
        return made


# -- tables ------------------------------------------------------------------------------------
def key_text(line):
    """What a line is compared by: stripped of ASCII white space, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def key_of(line):
    """128 bits of a key."""
    return F.struct(F.xxhash64(F.lit(11), key_text(line)).alias("k1"), F.xxhash64(F.lit(29), key_text(line)).alias("k2"))


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def id_of(docs: DataFrame):
    """A null id is a document of its own, below all others."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, doc): each long line key and document once; repeated rows of a document don't count again."""
    long_lines = F.filter(lines_of(docs["text"]), lambda x: F.char_length(key_text(x)) >= min_chars)
    keys = docs.select(id_of(docs).alias("doc"), F.explode(F.array_distinct(F.transform(long_lines, key_of))).alias("k"))
    return keys.select("k.k1", "k.k2", "doc").dropDuplicates(["k1", "k2", "doc"])


def counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))


def build_filters(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): a cuckoo filter over each shard's keys."""

    def build(group):
        import pandas as pd

        made = CuckooFilter.holding(group["k1"].to_numpy())
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "filter": [made.to_bytes()]})

    keys = repeated.select(shard_of(shards).alias("shard"), "k1")
    return keys.groupBy("shard").applyInPandas(build, "shard int, filter binary")


def shard_of(shards: int):
    return F.pmod("k2", F.lit(shards)).cast("int")


def update_filters(filters: DataFrame, risen: DataFrame, fallen: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """Takes keys that aren't repeated any more out of their shard's filter and puts new ones in. Only filters of
    touched shards change; one that gets crowded is built anew, larger, from its shard's keys (of ``counts``)."""
    change = lambda keys, sign: keys.select(shard_of(shards).alias("shard"), "k1", F.lit(sign).alias("sign"))

    def update(_, old, keys):
        import pandas as pd

        if not len(keys):
            return old[["shard", "filter"]]
        in_, out = (keys.loc[keys["sign"] == s, "k1"].to_numpy() for s in (1, -1))
        made = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter.holding(in_)
        if len(old):
            made.delete(out)
            made.insert(in_)
        shard = (old if len(old) else keys)["shard"].iloc[0]
        return pd.DataFrame({"shard": [int(shard)], "filter": [None if made.crowded() else made.to_bytes()]})

    keys = change(risen, 1).unionByName(change(fallen, -1))
    updated = stored(filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(update, "shard int, filter binary"), "line-filters")
    full = updated.filter("filter IS NULL").select("shard")
    if full.isEmpty():
        return updated
    again = counts.withColumn("shard", shard_of(shards)).join(full, "shard", "left_semi")
    return stored(updated.filter("filter IS NOT NULL").unionByName(build_filters(again.drop("shard"), shards)), "line-filters")


def maybe_repeated(refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """References that their shard's filter may hold. Small filters are sent to the references; else references go
    to the filters, shard by shard, a shard that many references ask for in several slices."""
    size = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size > FILTER_BYTES:
        return asked_by_shard(refs, filters, shards)
    sent = refs.sparkSession.sparkContext.broadcast({r.shard: bytes(r["filter"]) for r in filters.collect()})

    def probe(batches):
        held = {s: CuckooFilter.from_bytes(f) for s, f in sent.value.items()}
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            shard, hit = np.mod(k2, shards), np.zeros(len(k1), bool)
            for s in np.unique(shard):
                if s in held:
                    rows = np.flatnonzero(shard == s)
                    hit[rows] = held[s].contains(k1[rows])
            yield b.filter(pa.array(hit))

    return refs.mapInArrow(probe, "k1 long, k2 long, doc long")


def asked_by_shard(refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    keyed = refs.withColumn("shard", shard_of(shards))
    many = keyed.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("slices"))  # a row a shard
    many = F.broadcast(many) if shards <= SENT_SHARDS else many
    dealt = keyed.join(many, "shard").select("k1", "k2", "doc", "shard", F.pmod(F.xxhash64("doc"), "slices").cast("int").alias("slice"))
    held = filters.join(many, "shard").select("filter", F.col("shard").alias("own"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"))

    def probe(asked: pa.Table, found: pa.Table) -> pa.Table:
        rows = asked.select(["k1", "k2", "doc"])
        if not found.num_rows or not asked.num_rows:
            return rows.slice(0, 0)
        hit = CuckooFilter.from_bytes(found.column("filter")[0].as_py()).contains(rows.column("k1").to_numpy())
        return rows.filter(pa.array(hit))

    return dealt.groupBy("shard", "slice").cogroup(held.groupBy("own", "part")).applyInArrow(probe, "k1 long, k2 long, doc long")


@dataclass
class LineIndex:
    """The state after some insertions and deletions; each change gives a new state, all tables stored."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        refs = stored(references(docs, min_chars), "line-refs")
        return cls._of_refs(refs, min_chars, min_docs)

    @classmethod
    def _of_refs(cls, refs: DataFrame, min_chars: int, min_docs: int) -> LineIndex:
        repeated = stored(counted(refs).filter(F.col("n_docs") >= min_docs), "line-counts")
        shards = max(1, -(-repeated.count() // KEYS_PER_SHARD))
        return cls(refs, repeated, stored(build_filters(repeated, shards), "line-filters"), shards, min_chars, min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents; those known already change nothing. Only keys that the new references hold are counted
        again, and only filters of shards with keys that have become repeated change."""
        fresh = stored(references(docs, self.min_chars).join(self.refs, ["k1", "k2", "doc"], "left_anti"), "line-fresh")
        refs = stored(self.refs.unionByName(fresh.select("k1", "k2", "doc")), "line-refs")
        return self._changed(refs, fresh.select("k1", "k2").distinct())

    def delete(self, ids: DataFrame) -> LineIndex:
        """Takes documents (column doc_id) out again."""
        gone = ids.select(id_of(ids).alias("doc")).distinct()
        touched = stored(self.refs.join(gone, "doc", "left_semi").select("k1", "k2").distinct(), "line-touched")
        refs = stored(self.refs.join(gone, "doc", "left_anti").select("k1", "k2", "doc"), "line-refs")
        return self._changed(refs, touched)

    def _changed(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        again = counted(refs.join(touched, ["k1", "k2"], "left_semi")).filter(F.col("n_docs") >= self.min_docs)
        counts = stored(self.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(again), "line-counts")
        if counts.count() > 2 * self.shards * KEYS_PER_SHARD:  # time for more shards
            shards = -(-counts.count() // KEYS_PER_SHARD)
            return LineIndex(refs, counts, stored(build_filters(counts, shards), "line-filters"), shards, self.min_chars, self.min_docs)
        risen, fallen = counts.join(self.counts, ["k1", "k2"], "left_anti"), self.counts.join(counts, ["k1", "k2"], "left_anti")
        filters = update_filters(self.filters, risen, fallen, counts, self.shards)
        return LineIndex(refs, counts, filters, self.shards, self.min_chars, self.min_docs)

    def drops(self) -> DataFrame:
        """(doc, keys): the keys whose lines each document loses, an array<struct<k1, k2>> no longer than the
        document."""
        hit = maybe_repeated(self.refs, self.filters, self.shards)
        lost = hit.join(self.counts, ["k1", "k2"]).filter(F.col("doc") < F.col("keeper"))
        return lost.groupBy("doc").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))

    def apply(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with n_lines and n_dropped after its own columns and ``text`` replaced by the kept lines,
        joined by line feeds. Null texts become empty ones (one empty line)."""
        doc, keys = free_name(docs, "doc"), free_name(docs, "keys")
        drops = self.drops().select(F.col("doc").alias(doc), F.col("keys").alias(keys))
        lines = lines_of(F.col(f"`{text}`"))
        dropped = lambda x: (F.char_length(key_text(x)) >= self.min_chars) & F.array_contains(F.col(keys), key_of(x))
        kept = F.when(F.col(keys).isNull(), lines).otherwise(F.filter(lines, lambda x: ~dropped(x)))
        out = docs.join(drops, id_of(docs) == F.col(doc), "left").withColumn(keys, kept_struct(lines, kept))
        return out.withColumn("n_lines", F.col(keys)["n"]).withColumn("n_dropped", F.col(keys)["n"] - F.col(keys)["kept"]).withColumn(text, F.col(keys)["text"]).drop(doc, keys)


def kept_struct(lines, kept):
    return F.transform(F.array(kept), lambda k: F.struct(F.size(lines).cast("long").alias("n"), F.size(k).cast("long").alias("kept"), F.array_join(k, "\n").alias("text")))[0]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Indexes ``docs`` and applies the index to them. An empty table gives an empty table."""
    return LineIndex.of(docs, min_chars, min_docs).apply(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(require(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id < r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
