"""Record tables with versions (SRC-3, SRC-4, INC-6).

A store is a folder. Rows lie in *parts*, each a folder of Parquet files with the rows of one bucket of key hashes.
A version is a small table that lists its parts, each with its smallest and largest key and a Bloom filter of its
keys; a commit is one row that names the newest version, and is written last, as one file. Readers take the newest
committed version, so they never see half a write, and any older version stays readable until it is dropped.

An upsert reads only parts that may hold one of its keys: parts of touched buckets whose range and filter admit
one. Those are written anew without these keys; rows of new keys become further parts. Every write carries the
name of its batch, and a batch that is committed already changes nothing. Meant for one writer at a time.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.sources.records import newest

#: Bits of a filter for each key, and bits that each key sets: about one key in 100 is admitted in error.
KEY_BITS, KEY_MARKS = 10, 7
#: Parts of a bucket beyond which an upsert joins them.
MOST_PARTS = 8
_PARTS = "part string, bucket int, rows long, low string, high string, filter binary"
_COMMITS = "version long, batch string, parent long, rows long, rejected long"


def marks(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places in a filter of ``bits`` bits, a row for each 64-bit hash."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(KEY_MARKS, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def key_filter(hashes: np.ndarray) -> bytes:
    out = np.zeros(max(64, -(-len(hashes) * KEY_BITS // 8) * 8), bool)
    out[marks(hashes, len(out)).ravel()] = True
    return np.packbits(out).tobytes()


def admits(packed: bytes, hashes: np.ndarray) -> np.ndarray:
    have = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
    return have[marks(hashes, len(have))].all(axis=1)


class Write(NamedTuple):
    """What a write did: whether it changed anything, its version, and which parts it read."""

    fresh: bool
    version: int
    read: tuple[str, ...]


class RecordStore:
    """A table of records with one row for each key. ``sketch`` names a column of groups and one of things to count: each part then keeps, per group, its rows
    and a sketch of the different things, from which ``stats`` answers without reading records."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str = "page_id", order_by: str = "ingested_at", buckets: int = 64, sketch: tuple[str, str] | None = None):
        self.spark, self.path, self.key, self.order_by, self.buckets, self.sketch = spark, path.rstrip("/"), key, order_by, buckets, sketch
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    # -- reading ---------------------------------------------------------------------------------
    def commits(self) -> DataFrame:
        """All commits: version, batch, the version before, rows in all, and rows rejected in the batch."""
        try:
            return self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException:
            return self.spark.createDataFrame([], _COMMITS)

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return self.commits().agg(F.max("version")).first()[0] or 0

    def parts(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _PARTS)
        return self.spark.read.schema(_PARTS).parquet(f"{self.path}/versions/{version:012d}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version: the newest at the time of the call, unless one is named."""
        return self._rows([r.part for r in self.parts(version).select("part").collect()])

    def _rows(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{p}" for p in parts])

    def rejects(self) -> DataFrame:
        """(batch, file, record): input that could not be parsed, of committed batches."""
        try:
            found = self.spark.read.schema("file string, record string, batch string").option("recursiveFileLookup", "true").parquet(f"{self.path}/rejects")
        except AnalysisException:
            return self.spark.createDataFrame([], "batch string, file string, record string")
        return found.join(self.commits().select("batch"), "batch", "left_semi").select("batch", "file", "record")

    def stats(self, version: int | None = None) -> DataFrame:
        """(group, rows, documents) of a version (ANA-11): rows are exact, different things are estimated from the
        union of the parts' sketches (standard error 0.8 %). Parts that a write replaces take their sketches along,
        so moved and deleted rows don't count on."""
        live = self.parts(version).select("part")
        names = sorted({r.part.split("/")[0] for r in live.collect()})
        if not names:
            return self.spark.createDataFrame([], "group string, rows long, documents long")
        kept = self.spark.read.parquet(*[f"{self.path}/sketches/{n}" for n in names]).join(F.broadcast(live), "part", "left_semi")
        return kept.groupBy("group").agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("documents"))

    # -- writing ---------------------------------------------------------------------------------
    def upsert(self, rows: DataFrame, batch: str | None = None, rejects: DataFrame | None = None) -> Write:
        """Puts rows in place of those with the same key; of repeated keys the newest counts. Rows without a
        key are rejected (as JSON, without a file). rejects: file, record."""
        batch = batch or uuid.uuid4().hex
        if self._done(batch):
            return Write(False, self.version(), ())
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema])
        lost = rows.filter(F.col(self.key).isNull()).select(F.lit(None).cast("string").alias("file"), F.to_json(F.struct("*")).alias("record"))
        rejects = lost if rejects is None else rejects.select("file", "record").unionByName(lost)
        staged = self._staged(newest(rows.filter(F.col(self.key).isNotNull()), self.key, self.order_by))
        return self._commit(staged, staged, batch, rejects)

    def delete(self, keys: DataFrame, batch: str | None = None) -> Write:
        """Takes out the rows of the given keys."""
        batch = batch or uuid.uuid4().hex
        if self._done(batch):
            return Write(False, self.version(), ())
        gone = self._staged(keys.select(F.col(self.key).cast(self.schema[self.key].dataType)).filter(F.col(self.key).isNotNull()).distinct())
        return self._commit(gone, None, batch, None)

    def _done(self, batch: str) -> bool:
        return not self.commits().filter(F.col("batch") == batch).isEmpty()

    def _hashed(self, rows: DataFrame) -> DataFrame:
        hashed = rows.withColumn("_hash", F.xxhash64(F.col(self.key).cast("string")))
        return hashed.withColumn("_bucket", F.pmod("_hash", F.lit(self.buckets)).cast("int"))

    def _staged(self, rows: DataFrame) -> DataFrame:
        """The batch as a table of its own: it is read several times, and may come from a stream."""
        path = f"{self.path}/staged/{uuid.uuid4().hex}"
        self._hashed(rows).write.parquet(path)
        return self.spark.read.parquet(path)

    def touched(self, keys: DataFrame, version: int) -> list[str]:
        """Names of the parts that may hold one of the keys (with _hash and _bucket)."""
        key = F.col(self.key).cast("string")
        edges = keys.groupBy("_bucket").agg(F.min(key).alias("least"), F.max(key).alias("most"))
        crowded = self.parts(version).groupBy("bucket").agg(F.count("*").alias("n"))
        near = self.parts(version).join(edges, (F.col("bucket") == F.col("_bucket")) & (F.col("low") <= F.col("most")) & (F.col("high") >= F.col("least"))).select("bucket", "part", "filter")

        def test(group: tuple, asked: pa.Table, parts: pa.Table) -> pa.Table:
            hashes = asked.column("_hash").to_numpy()
            rows = zip(parts.column("part").to_pylist(), parts.column("filter").to_pylist(), strict=True)
            return pa.table({"part": pa.array([p for p, f in rows if len(hashes) and admits(f, hashes).any()], pa.string())})

        hit = keys.select("_bucket", "_hash").groupBy("_bucket").cogroup(near.groupBy("bucket")).applyInArrow(test, "part string")
        full = self.parts(version).join(crowded.filter(F.col("n") >= MOST_PARTS), "bucket").join(edges, F.col("bucket") == F.col("_bucket"), "left_semi").select("part")
        return sorted(r.part for r in hit.union(full).distinct().collect())

    def _commit(self, keys: DataFrame, new: DataFrame | None, batch: str, rejects: DataFrame | None) -> Write:
        parent = self.version()
        read = self.touched(keys, parent)
        kept = self._hashed(self._rows(read)).join(keys.select(self.key), self.key, "left_anti")
        made = kept if new is None else kept.unionByName(new.select(*kept.columns))
        name = uuid.uuid4().hex
        made.repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        added = self._described(name)
        if self.sketch:
            self._sketched(name)
        stay = self.parts(parent).filter(~F.col("part").isin(read)) if read else self.parts(parent)
        version = parent + 1
        stay.unionByName(added).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{version:012d}")
        rejected = 0
        if rejects is not None:
            rejects.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/rejects/{_folder(batch)}")
            rejected = self.spark.read.parquet(f"{self.path}/rejects/{_folder(batch)}").count()
        total = self.parts(version).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        self.spark.createDataFrame([(version, batch, parent, total, rejected)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return Write(True, version, tuple(read))

    def _written(self, name: str) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField("_hash", T.LongType()), T.StructField("_bucket", T.IntegerType())])).parquet(f"{self.path}/data/{name}")

    def _sketched(self, name: str) -> None:
        group, thing = self.sketch
        part = F.format_string(f"{name}/_bucket=%d", "_bucket").alias("part")
        rows = self._written(name).groupBy(part, F.col(group).cast("string").alias("group"))
        counted = rows.agg(F.count("*").alias("rows"), F.hll_sketch_agg(F.col(thing).cast("string"), 14).alias("sketch"))
        counted.coalesce(1).write.parquet(f"{self.path}/sketches/{name}")

    def _described(self, name: str) -> DataFrame:
        """The parts of one write, with what the key index knows of them."""
        rows = self._written(name)

        def describe(group: pa.Table) -> pa.Table:
            keys, bucket = group.column("key"), group.column("_bucket")[0].as_py()
            text = keys.to_pylist()
            return pa.table({"part": pa.array([f"{name}/_bucket={bucket}"]), "bucket": pa.array([bucket], pa.int32()), "rows": pa.array([len(text)]), "low": pa.array([min(text)]), "high": pa.array([max(text)]), "filter": pa.array([key_filter(group.column("_hash").to_numpy())], pa.binary())})

        return rows.select(F.col(self.key).cast("string").alias("key"), "_hash", "_bucket").groupBy("_bucket").applyInArrow(describe, _PARTS)


def _folder(batch: str) -> str:
    return "b-" + "".join(c if c.isalnum() else "-" for c in batch)[:80] + "-" + uuid.uuid5(uuid.NAMESPACE_URL, batch).hex[:12]


def ingest(store: RecordStore, source: str, schema: str, transform, checkpoint: str, name: str = "ingest", once: bool = True):
    """New JSON files under ``source`` go through ``transform`` into the store, each batch once (INC-6): a batch
    is named by the stream and its number, so that one replayed after a crash changes nothing. Lines that can't be
    parsed are kept with their file among the store's rejects; the others of the file go in. transform: from parsed
    rows (with ``_file``) to rows of the store. Returns the running query."""
    spark = store.spark
    whole = T.StructType.fromDDL(schema).add("_broken", T.StringType())
    files = spark.readStream.schema(whole).option("columnNameOfCorruptRecord", "_broken").json(source)
    lines = files.withColumn("_file", F.col("_metadata.file_path"))

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            broken = held.filter("_broken IS NOT NULL").select(F.col("_file").alias("file"), F.col("_broken").alias("record"))
            store.upsert(transform(held.filter("_broken IS NULL").drop("_broken")), f"{name}-{number}", broken)
        finally:
            held.unpersist()

    writer = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
