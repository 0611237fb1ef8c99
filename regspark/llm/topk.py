"""Exact top-k inner products by best-first search over an M-tree.

Integer vectors get one more component that makes all their lengths equal; then the nearest by Euclidean
distance has the largest inner product, and a metric tree finds it. Leaf pages hold up to a fixed number of
vectors with a routing vector, its covering radius, and all distances to the parent; pages of one routing
region are stored together. A query visits pages by their least possible distance. The triangle inequality
over stored parent distances rules pages and vectors out before any distance is computed, and the search ends
when no page can hold anything nearer than the k-th found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regspark.llm.common import bounded_batches, require, stored, table

NAME = "op8_exact_topk_search"
K, EVERY = 5, 50
PAGE, PIVOTS = 128, 64
#: Queries that are sent to all executors at once; more are searched block after block.
QUERY_BLOCK = 10_000

ORACLE_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 x) of each component, as longs. Null vectors and ids, and vectors with null or
    non-finite components, are left out; products are exact while components stay under 2^23."""
    x = F.col(f"`{embedding}`")
    good = x.isNotNull() & F.col(f"`{vec_id}`").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long")).alias("v"))


def matrix(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list column; shorter ones are filled up with zeros."""
    out = np.zeros((len(column), dims))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and (sizes == dims).all():
        return flat.reshape(len(column), dims).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at[i] : at[i + 1]]
    return out


def lifted(m: np.ndarray, top: float) -> np.ndarray:
    """With the component that makes all squared lengths ``top``."""
    return np.concatenate([m, np.sqrt(np.maximum(top - (m * m).sum(axis=1), 0))[:, None]], axis=1)


PAGES = "region int, page long, parent_distance double, radius double, center binary, ids binary, to_center binary, vectors binary"


def build_tree(rows: DataFrame, pivots: np.ndarray, dims: int, top: float) -> DataFrame:
    """Leaf pages of the tree. Each vector goes to its nearest pivot's region; a region's vectors are sorted by
    distance to the pivot over as many partitions as they need, so that a dense region is no task's alone."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for b in batches:
            m = lifted(matrix(b.column(1), dims), top)
            p = sent.value
            d2 = np.maximum((m * m).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * m @ p.T, 0)
            near = d2.argmin(axis=1)
            dist = np.linalg.norm(m - p[near], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(dist), b.column(0), b.column(1)], ["region", "distance", "vec_id", "v"])

    placed = stored(bounded_batches(rows).mapInArrow(assign, "region int, distance double, vec_id long, v array<long>"), "tree-placed")
    placed = placed.repartitionByRange("region", "distance", "vec_id").sortWithinPartitions("region", "distance", "vec_id")

    def pages(batches):
        held, number = None, 0

        def page(region, distance, ids, vectors):
            nonlocal number
            m = lifted(vectors, top)
            center = m[np.linalg.norm(m - m.mean(axis=0), axis=1).argmin()]
            to_center = np.linalg.norm(m - center, axis=1)
            number += 1
            return {"region": int(region), "page": number, "parent_distance": float(np.linalg.norm(center - sent.value[region])), "radius": float(to_center.max()), "center": center.tobytes(), "ids": ids.tobytes(), "to_center": to_center.tobytes(), "vectors": vectors.tobytes()}

        schema = pa.schema([("region", pa.int32()), ("page", pa.int64()), ("parent_distance", pa.float64()), ("radius", pa.float64()), *[(c, pa.binary()) for c in ("center", "ids", "to_center", "vectors")]])
        for b in batches:
            new = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), matrix(b.column(3), dims)
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            out, at = [], 0
            cuts = np.flatnonzero(np.diff(held[0])) + 1
            for stop in [*cuts.tolist(), len(held[0])]:
                while stop - at >= PAGE or stop != len(held[0]) and at < stop:
                    end = min(at + PAGE, stop)
                    out.append(page(held[0][at], held[1][at:end], held[2][at:end], held[3][at:end]))
                    at = end
            held = tuple(x[at:] for x in held)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_pylist([page(held[0][0], *held[1:])], schema=schema)

    return stored(placed.mapInArrow(pages, PAGES), "tree-pages")


def _search(tree: DataFrame, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, pivots: np.ndarray, dims: int, top: float, k: int) -> DataFrame:
    """(query_id, vec_id, score): at least the k best of each group of pages; ``least`` is a score that the
    k-th best of all reaches for sure."""
    sent = tree.sparkSession.sparkContext.broadcast((ids, queries, least, pivots))

    def run(batches):
        ids, queries, least, pivots = sent.value
        lift = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        norm2 = (queries * queries).sum(axis=1)
        to_pivot = np.linalg.norm(lift[:, None, :] - pivots[None], axis=2) if len(lift) * len(pivots) < 200_000 else np.stack([np.linalg.norm(pivots - q, axis=1) for q in lift])
        slack = 1e-6 * (1 + np.sqrt(top) + np.sqrt(norm2.max(initial=0.0)))
        bound = least.copy()
        for b in batches:
            n = len(b)
            region, parent, radius = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            centers = np.stack([np.frombuffer(x, np.float64) for x in b.column(4).to_pylist()]) if n else np.zeros((0, dims + 1))
            leaf_ids = [np.frombuffer(x, np.int64) for x in b.column(5).to_pylist()]
            leaf_to = [np.frombuffer(x, np.float64) for x in b.column(6).to_pylist()]
            leaves = [np.frombuffer(x, np.float64).reshape(-1, dims) for x in b.column(7).to_pylist()]
            out_q, out_v, out_s = [], [], []
            for i in range(len(ids)):
                reach = lambda: np.sqrt(max(norm2[i] + top - 2 * bound[i], 0)) + slack  # noqa: B023, E731
                # parent distances first: pages they rule out need no distance
                low = np.abs(to_pivot[i][region] - parent) - radius
                live = np.flatnonzero(low <= reach())
                d = np.linalg.norm(centers[live] - lift[i], axis=1)
                low = np.maximum(d - radius[live], 0)
                order = np.argsort(low)
                best_s, best_v = np.zeros(0), np.zeros(0, np.int64)
                for j in order:
                    if low[j] > reach():
                        break
                    page = live[j]
                    rows = np.flatnonzero(np.abs(d[j] - leaf_to[page]) <= reach())
                    s, v = leaves[page][rows] @ queries[i], leaf_ids[page][rows]
                    good = (s >= bound[i]) & (v != ids[i])
                    best_s, best_v = np.concatenate([best_s, s[good]]), np.concatenate([best_v, v[good]])
                    if len(best_s) > k:
                        top_k = np.lexsort((best_v, -best_s))[:k]
                        best_s, best_v = best_s[top_k], best_v[top_k]
                    if len(best_s) == k:
                        bound[i] = max(bound[i], best_s.min())
                out_q.append(np.full(len(best_v), ids[i]))
                out_v.append(best_v)
                out_s.append(best_s)
            q, v, s = (np.concatenate(x) if x else np.zeros(0) for x in (out_q, out_v, out_s))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(np.rint(s).astype(np.int64))], ["query_id", "vec_id", "score"])

    return bounded_batches(tree, 4096).mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every row for which ``is_query``
    (a Column over vec_id) holds with all other rows; ties go to the smaller id. With fewer rows than k all
    are returned, with none none. Rows with an id that occurs twice are both candidates, and never of a
    query with that id; a query id that occurs twice is searched once, by its largest vector."""
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, vec_id, embedding), "tree-rows")
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    stats = rows.agg(F.max(size).alias("top"), F.max(F.size("v")).alias("dims"), F.count("*").alias("n")).first()
    if not stats["n"]:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    dims, top = stats["dims"] or 0, float(stats["top"] or 0)
    as_rows = lambda got: np.array([list(r["v"]) + [0] * (dims - len(r["v"])) for r in got], np.float64).reshape(len(got), dims)
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()  # PIVOTS rows
    seed_ids, seed_rows = np.array([r["vec_id"] for r in seeds]), as_rows(seeds)
    pivots = lifted(seed_rows, top)
    tree = build_tree(rows, pivots, dims, top)
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.max("v").alias("v"))
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-rows.filter(is_query).count() // QUERY_BLOCK))))), "tree-queries")
    found = None
    for r in sorted(queries.select("block").distinct().collect()):
        block = queries.filter(F.col("block") == r["block"]).orderBy("vec_id").collect()  # about QUERY_BLOCK rows
        ids, q = np.array([x["vec_id"] for x in block]), as_rows(block)
        known = np.where(seed_ids[None] == ids[:, None], -np.inf, q @ seed_rows.T)
        least = np.sort(known, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(ids), -np.inf)
        least = np.where(np.isfinite(least), least, -float(2**62))
        part = _search(tree, ids, q, least, pivots, dims, top, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(require(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("vec_id") % EVERY == 0)
