"""Approximate neighbours by a clustered inverted file (RET-5).

Building: centroids come from k-means rounds over a bounded sample; every vector is then assigned to its nearest
centroid and written, sorted by list, with a code of its residual (four bits a component). The index also keeps
how many lists have to be looked at: for a few vectors of its own it finds their exact neighbours and counts in
which of their nearest lists those lie, so that the wanted recall decides, not a guess.

Searching: each question picks its nearest lists. Their codes are read where they lie, scored against the
questions that picked the list, and cut to the best few of a task, so no record is shuffled. Only the few that
remain are compared exactly.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regspark.functions.text import dot, norm
from regspark.operators.retrieve import QUESTION_BLOCK, knn, ranked
from regspark.operators.vectors import PAIRS, Best
from regspark.sources.scratch import stored

#: Lists at most: their centroids are broadcast (16 MB at 64 components).
MOST_LISTS = 1 << 16
#: Vectors a list from which centroids are learned, vectors on which the number of probes is measured, rounds.
SAMPLE_PER_LIST, PROBED, ROUNDS = 64, 200, 8
#: Codes kept for each wanted neighbour, to be compared exactly.
OVERSAMPLE = 4
LEVELS = 16


class Index(NamedTuple):
    """centroids: unit vectors, a row each; size: vectors in each list; scale: per component, the residual that
    the outermost level stands for; probes: lists to look at for the wanted recall."""

    path: str
    centroids: np.ndarray
    size: np.ndarray
    scale: np.ndarray
    probes: int

    def lists(self, q: np.ndarray, k: int) -> np.ndarray:
        """Whether a question (rows of q) looks at a list: the nearest ``probes`` ones, and further ones until
        they hold enough vectors."""
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        use = (np.arange(order.shape[1]) < self.probes) | (before < OVERSAMPLE * k)
        out = np.zeros_like(use)
        np.put_along_axis(out, order, use, axis=1)
        return out


def unit_rows(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy().reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def indexable(records: DataFrame, key: str, length: int) -> DataFrame:
    """(key, vector): vectors of the index's length, without nulls and infinities, and not zero."""
    rows = records.filter("vector IS NOT NULL").select(key, F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.filter((F.size("vector") == length) & sound)


def learn_centroids(sample: DataFrame, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: tasks add up their batches' vectors by list, Spark adds the sums."""
    spark = sample.sparkSession
    first = sample.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(lists).toPandas()["vector"]
    c = np.stack(first.to_numpy())
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(c)

        def add(batches, held=held):
            for b in batches:
                x = unit_rows(b.column(0))
                of = (x @ held.value.T).argmax(axis=1)
                total = np.zeros((len(held.value), x.shape[1]))
                np.add.at(total, of, x)
                use = np.unique(of)
                yield pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array(list(total[use]), pa.list_(pa.float64()))], ["list", "total"])

        parts = sample.select("vector").mapInArrow(add, "list int, total array<double>")
        sums = parts.select("list", F.posexplode("total").alias("i", "x")).groupBy("list", "i").agg(F.sum("x").alias("x"))
        for row in sums.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).toLocalIterator():
            v = np.array([x.x for x in row.v])
            c[row.list] = v / (np.linalg.norm(v) or 1)
        held.unpersist()
    return c


def build(records: DataFrame, path: str, key: str = "record_id", lists: int | None = None, recall: float = 0.95, k: int = 10) -> Index:
    """Writes the index of all vectors under ``path``. Centroids and probes are measured on samples by hash of
    the key (SAMPLE_PER_LIST a list, PROBED vectors); every vector is indexed."""
    spark = records.sparkSession
    lengths = records.filter("vector IS NOT NULL").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = lengths[0] if lengths else 1
    rows = indexable(records, key, length)
    n = rows.count()
    lists = max(1, min(lists or math.ceil(math.sqrt(n)), MOST_LISTS, n))
    named = rows.withColumnRenamed(key, "key")
    sample = stored(named.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_PER_LIST * lists), "ivf-sample")
    c = learn_centroids(sample, lists) if n else np.zeros((1, length))
    some = sample.orderBy(F.xxhash64("key", F.lit(2)), "key").limit(4096).toPandas()["vector"]
    x = np.stack(some.to_numpy()) if len(some) else np.ones((1, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.maximum(np.quantile(np.abs(x - c[(x @ c.T).argmax(axis=1)]), 0.995, axis=0), 1e-9)
    held = spark.sparkContext.broadcast((c, scale))

    def code(batches):
        c, scale = held.value
        for b in batches:
            x = unit_rows(b.column(1))
            of = (x @ c.T).argmax(axis=1)
            level = np.clip(np.round(((x - c[of]) / scale + 1) * (LEVELS - 1) / 2), 0, LEVELS - 1).astype(np.uint8)
            level = np.pad(level, ((0, 0), (0, level.shape[1] % 2)))
            codes = [r.tobytes() for r in level[:, 0::2] << 4 | level[:, 1::2]]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), b.column(0), pa.array(codes, pa.binary()), b.column(1)], ["list", "key", "code", "vector"])

    kind = named.schema["key"].dataType.simpleString()
    coded = named.mapInArrow(code, f"list int, key {kind}, code binary, vector array<double>")
    # a crowded list is split between tasks, and lists lie together, so that a reader skips the others
    spread = coded.repartitionByRange("list", "key").sortWithinPartitions("list", "key")
    spread.write.mode("overwrite").parquet(f"{path}/vectors")
    size = np.zeros(lists, np.int64)
    for row in spark.read.parquet(f"{path}/vectors").groupBy("list").count().toLocalIterator():
        size[row["list"]] = row["count"]
    index = Index(path, c, size, scale, lists)
    index = index._replace(probes=measured_probes(spark, index, sample, recall, k) if n else 1)
    about = json.dumps({"probes": index.probes, "size": size.tolist(), "scale": scale.tolist(), "centroids": c.tolist()})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return index


def load(spark: SparkSession, path: str) -> Index:
    about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
    return Index(path, np.array(about["centroids"]), np.array(about["size"]), np.array(about["scale"]), about["probes"])


def measured_probes(spark: SparkSession, index: Index, sample: DataFrame, recall: float, k: int) -> int:
    """How many of its nearest lists a vector of the sample has to look at to find the wanted share of its
    exact neighbours, on average."""
    asked = sample.orderBy(F.xxhash64("key", F.lit(3)), "key").limit(PROBED).select(F.col("key").alias("question_id"), F.col("vector").alias("q"))
    asked = stored(asked, "ivf-asked")
    vectors = spark.read.parquet(f"{index.path}/vectors")
    near = knn(asked, vectors, k + 1, "key").filter("NOT question_id <=> key")
    pairs = near.join(vectors.select("key", "list"), "key").groupBy("question_id").agg(F.collect_list("list").alias("lists")).join(asked, "question_id").toPandas()
    if not len(pairs):
        return 1
    q = np.stack(pairs["q"].to_numpy())
    order = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    at = np.concatenate([place[i, np.asarray(lists, int)] for i, lists in enumerate(pairs["lists"])])
    return int(np.quantile(at, recall, method="higher")) + 1


def search(questions: DataFrame, index: Index, k: int = 10, key: str = "record_id", oversample: int = OVERSAMPLE) -> DataFrame:
    """(question_id, key, score, rank): the k nearest by cosine among the vectors of the lists that a question
    looks at, compared exactly for the ``oversample`` x k best codes. questions: question_id, q. Questions with a
    null, zero or other sort of vector get nothing. Questions go to the index in blocks of QUESTION_BLOCK."""
    spark = questions.sparkSession
    length = index.centroids.shape[1]
    asked = indexable(questions.select("question_id", F.col("q").alias("vector")), "question_id", length)
    blocks = max(1, math.ceil(asked.count() / QUESTION_BLOCK))
    parts = [first_cut(asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b), index, k, oversample) for b in range(blocks)]
    few = reduce(DataFrame.unionByName, parts)
    vectors = spark.read.parquet(f"{index.path}/vectors").select("list", "key", "vector")
    both = few.join(vectors, ["list", "key"]).join(asked.select("question_id", F.col("vector").alias("q")), "question_id")
    score = dot(F.col("vector"), F.col("q")) / (norm(F.col("vector")) * norm(F.col("q")))
    return ranked(both.select("question_id", F.col("key").alias(key), score.alias("score")), key, k)


def first_cut(asked: DataFrame, index: Index, k: int, oversample: int) -> DataFrame:
    """(question_id, list, key): the best ``oversample`` x k codes of each question of one block."""
    spark, cut = asked.sparkSession, oversample * k
    block = asked.toPandas()  # bounded: QUESTION_BLOCK questions
    schema = "question int, list int, key {}, guess double"
    vectors = spark.read.parquet(f"{index.path}/vectors").select("list", "key", "code")
    kind = vectors.schema["key"].dataType.simpleString()
    q = np.stack(block["vector"].to_numpy()) if len(block) else np.zeros((0, index.centroids.shape[1]))
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    looks = index.lists(q, k)
    wanted = np.flatnonzero(looks.any(axis=0)).tolist()
    held = spark.sparkContext.broadcast((q, looks, index.centroids, index.scale))

    def score(batches):
        yield from best_codes(batches, *held.value, cut)

    scored = vectors.filter(F.col("list").isin(wanted)).mapInArrow(score, schema.format(kind))
    w = Window.partitionBy("question").orderBy(F.desc("guess"), "key")
    best = scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= cut)
    ids = block["question_id"].tolist()
    names = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"question int, question_id {asked.schema['question_id'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "question").select("question_id", "list", "key")


def best_codes(batches, q: np.ndarray, looks: np.ndarray, c: np.ndarray, scale: np.ndarray, cut: int):
    """(question, list, key, guess): the ``cut`` best codes of a task's batches (list, key, code) for each question, a
    row of q, among the lists it looks at; equal ones by key."""
    best = Best(len(q), cut)
    for b in batches:
        lists = b.column(0).to_numpy()
        packed = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(lists), -1)
        level = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(lists), -1)[:, : c.shape[1]]
        for one in np.unique(lists):
            rows, who = np.flatnonzero(lists == one), np.flatnonzero(looks[:, one])
            x = c[one] + (level[rows] * (2 / (LEVELS - 1)) - 1) * scale
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            step = max(1, PAIRS // len(rows))
            for s in range(0, len(who), step):
                some = who[s : s + step]
                guess, floor = q[some] @ x.T, best.floor[some]
                few = np.flatnonzero(floor == -np.inf)
                if len(few) and len(rows) > cut:
                    floor[few] = np.partition(guess[few], -cut, axis=1)[:, -cut]
                at, row = np.nonzero(guess >= floor[:, None])
                best.add(some[at], guess[at, row], key=b.column(1).take(pa.array(rows[row])), list=pa.array(np.full(len(at), one, np.int32)))
        best.rows()
    found = best.rows()
    for x in found.to_batches(max_chunksize=1 << 16) if found is not None else []:
        yield pa.RecordBatch.from_arrays([x["slot"].cast(pa.int32()), x["list"], x["key"], x["good"]], ["question", "list", "key", "guess"])


def recall(found: DataFrame, exact: DataFrame, key: str = "record_id") -> DataFrame:
    """One row: questions, wanted neighbours, and how many of them were found. Both: question_id, key."""
    hit = exact.select("question_id", key).join(found.select("question_id", key, F.lit(1).alias("hit")), ["question_id", key], "left")
    return hit.agg(F.count_distinct("question_id").alias("questions"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
