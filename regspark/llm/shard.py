"""Sharding by a hypergeometric communication matrix.

A uniform random permutation of all rows, cut into shards whose row counts differ by one at most, is drawn in
four steps: rows fall into source blocks; the matrix that says how many rows of each block go to each shard is
drawn exactly (multivariate hypergeometric, so that both margins hold); each block is permuted and dealt out
by its row of the matrix; and each shard is permuted again. Only counts reach the driver: one number for each
block of about BLOCK_ROWS rows. Permuting sorts by random keys; a shard is sorted in pieces of about as many rows,
by bits of the key, so that no task holds a whole shard.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regspark.llm.common import literal_rows, require, stored, table

NAME = "op3_sharding"
ORACLE_SQL = None  # the permutation is random; tests check its law and its uniformity
SHARDS, SEED = 16, 20240229
#: Rows of a block, and of a piece of a shard, about; blocks and pieces of a shard at least.
BLOCK_ROWS, LEAST_BLOCKS, LEAST_PIECES = 1_000_000, 256, 64


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """A draw by inversion from the mode outwards: some tens of times as many steps as the standard deviation.
    Probabilities are kept relative to the mode's, by exact ratios of neighbours, and summed until the rest can't
    matter in double precision; nothing is a difference of large logarithms, however many rows there are."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    up, down, total = [1.0], [], 1.0
    for k in range(mode, high):
        up.append(up[-1] * ((good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))))
        total += up[-1]
        if up[-1] < 1e-18 * total:
            break
    last = 1.0
    for k in range(mode, low, -1):
        last *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
        down.append(last)
        total += last
        if last < 1e-18 * total:
            break
    u = rng.random() * total
    for step in range(max(len(up), len(down) + 1)):
        if step < len(up):
            u -= up[step]
            if u <= 0:
                return mode + step
        if 0 < step <= len(down):
            u -= down[step - 1]
            if u <= 0:
                return mode - step
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of block i that go to shard j; row sums are counts, column sums are sizes."""
    rng, left, out = random.Random(seed), list(sizes), []
    for count in counts:
        row, rest, draws = [], sum(left), count
        for j, good in enumerate(left):
            rest -= good
            got = hypergeometric(rng, good, rest, draws)
            row.append(got)
            draws -= got
            left[j] -= got
        out.append(row)
    return out


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, block_rows: int = BLOCK_ROWS, seed: int = SEED, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with a shard (0 to shards - 1) and a gapless slot from 0 in it. Shards' row counts differ by one
    at most; the first ones have the extra row. Rows are dealt by position, not by value: repeated rows,
    nulls and hot keys spread like all others. An empty table gives an empty table.

    The keyed rows are stored in the shared folder first, as the random keys must stay what they are when a
    task runs again. Give narrow rows (an id, sizes, digests) and join wide ones by id where they are needed.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.xxhash64(F.lit(seed), place).alias("block_key"),
        F.xxhash64(F.lit(seed + 1), place).alias("first_key"),
        F.xxhash64(F.lit(seed + 2), place).alias("second_key"),
        place.alias("place"),
    )
    keyed = stored(keyed, "shard-keyed")
    rows = keyed.count()
    blocks, pieces = max(LEAST_BLOCKS, -(-rows // block_rows)), max(LEAST_PIECES, -(-rows // (shards * block_rows)))
    keyed = keyed.withColumn("block", F.pmod("block_key", F.lit(blocks)).cast("int"))
    counts = {r.block: r.n for r in keyed.groupBy("block").agg(F.count("*").alias("n")).collect()}  # `blocks` numbers
    total = sum(counts.values())
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    order = sorted(counts)
    matrix = communication_matrix([counts[b] for b in order], sizes, seed)
    ends = [{"block": b, "ends": [sum(row[: j + 1]) for j in range(shards)]} for b, row in zip(order, matrix, strict=True)]
    ends_table = F.broadcast(literal_rows(spark, ends, "block int, ends array<bigint>"))  # blocks x shards numbers
    in_block = F.row_number().over(Window.partitionBy("block").orderBy("first_key", "place"))
    dealt = (
        keyed.withColumn("rank", in_block)
        .join(ends_table, "block")
        .select("row", "second_key", "place", F.size(F.filter("ends", lambda e: e < F.col("rank"))).cast("int").alias("shard"))
        .withColumn("piece", F.pmod(F.shiftright("second_key", 20), F.lit(pieces)).cast("int"))
    )
    dealt = stored(dealt, "shard-dealt")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n")).select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    in_piece = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("second_key", "place"))
    out = dealt.withColumn("rank", in_piece).join(F.broadcast(offsets), ["shard", "piece"])  # shards x pieces rows
    kept = [F.col(f"row.`{c}`") for c in df.columns if c not in (shard, slot)]
    return out.select(*kept, F.col("shard").alias(shard), (F.col("offset") + F.col("rank") - 1).cast("long").alias(slot))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = require(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = shuffle_into_shards(docs)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
