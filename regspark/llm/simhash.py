"""SimHash near-duplicates by embedding segments' bit counts.

A fingerprint's 64 bits are cut into segments, and each segment is mapped to the number of its set bits: a
point of a small integer grid. A changed bit moves the point by one step along one axis, so the Manhattan
distance of two points is a lower bound of the fingerprints' distance. Points two steps apart have a grid point
between them that is at most one step from each. So every fingerprint is listed under its own grid point and
under those one step away, fingerprints that meet in a grid point are compared exactly, and no link is lost.

A grid point where many meet is refined instead of paired: its fingerprints are listed again, in segments half
as wide, under those finer points only that lie in it. In segments of one bit a grid point is a fingerprint
itself: at most 65 meet there, all of them linked with each other, so a star joins them. Links therefore stay
linear in the number of different fingerprints, whatever their groups are.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.common import LOWER_ASCII, bounded_batches, require, stored, table
from regspark.llm.near_dedup import components

NAME = "op12_simhash_near_dedup"
ORACLE_SQL = None  # SQL has no XXH64: tests compare with brute force
WORDS, DISTANCE, SEED = 3, 2, 42
#: Fingerprints that are paired in one grid point; more are refined.
CELL = 64
#: Different fingerprints from which segments have two bits at once: four-bit grids get crowded there.
MANY = 50_000_000
#: Shingles whose bits are counted at once.
SLICE = 1 << 17


def bit_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many shingles it has, and how many of their hashes set each bit (from the lowest)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    n, ones = np.zeros(len(texts), np.int64), np.zeros((len(texts), 64), np.int64)
    pending, owner = [], []

    def count():
        if pending:
            bits = np.unpackbits(np.array(pending, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            who = np.array(owner)
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            ones[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
            pending.clear()
            owner.clear()

    for i, text in enumerate(texts):
        words = text.translate(LOWER_ASCII).split()  # bytes are split at the six ASCII blanks, no others
        if not words:
            continue
        n[i] = max(1, len(words) - WORDS + 1)
        found = map(b" ".join, zip(*[islice(words, k, None) for k in range(WORDS)], strict=False) if len(words) >= WORDS else [words])
        while part := [digest(s, SEED) for s in islice(found, SLICE)]:
            pending += part
            owner += [i] * len(part)
            if len(pending) >= SLICE:
                count()
    count()
    return n, ones


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): each row's fingerprint as a signed 64-bit number; null and wordless texts have zero."""

    def run(batches):
        for b in batches:
            n, ones = bit_counts([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
            fp = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    rows = require(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return bounded_batches(rows, 1024, "8m").mapInArrow(run, "doc_id long, fp long")


def point(x: str, width: int) -> str:
    """SQL: the grid point of fingerprint x, as segments' bit counts side by side in the bits of a number."""
    if width == 1:
        return x
    odd = f"(shiftrightunsigned({x}, 1) & {0x5555555555555555})"
    even = f"({x} & {0x5555555555555555})"
    return coarser(f"(({even} ^ {odd}) | shiftleft({even} & {odd}, 1))", 2, width)


def coarser(p: str, have: int, want: int) -> str:
    """SQL: point p of segments ``have`` bits wide on the grid of wider segments."""
    if have == want:
        return p
    if have == 1:
        return point(p, want)
    return f"(({p} & {0x3333333333333333}) + (shiftrightunsigned({p}, 2) & {0x3333333333333333}))"


def points_around(p: str, width: int) -> str:
    """SQL: an array of grid point p and those one step away from it."""
    size, mask = 64 // width, {4: 7, 2: 3, 1: 1}[width]
    count = f"(shiftrightunsigned({p}, i * {width}) & {mask}L)"
    step = f"{p} ^ shiftleft({count} ^ ({count} %s 1L), i * {width})"
    axes = f"sequence(0, {size - 1})"
    if width == 1:
        return f"concat(array({p}), transform({axes}, i -> {p} ^ shiftleft(1L, i)))"
    up = f"transform(filter({axes}, i -> {count} < {width}), i -> {step % '+'})"
    down = f"transform(filter({axes}, i -> {count} > 0), i -> {step % '-'})"
    return f"concat(array({p}), {up}, {down})"


def cell_links(cells: DataFrame, width: int) -> DataFrame:
    """(a, b): linked fingerprints out of cells (key, fp), few enough to a key."""
    met = cells.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    if width == 1:
        return met.select(F.explode(F.slice("fps", 2, 65)).alias("b"), F.col("fps")[0].alias("a")).select("a", "b")
    one = met.select("key", "fps", F.explode("fps").alias("a"))
    # two of one grid point meet in the points around it as well: there they aren't compared
    same = f"{point('a', width)} = {point('b', width)} AND {point('a', width)} <> key"
    near = F.expr(f"filter(fps, b -> b > a AND bit_count(a ^ b) <= {DISTANCE} AND NOT ({same}))")
    return one.select("a", F.explode(near).alias("b"))


def links(fps: DataFrame, cell: int = CELL, width: int | None = None) -> DataFrame:
    """(a, b): pairs of the different fingerprints (fp) that differ in two bits at most: all pairs, or, where
    many meet, enough to connect the same ones."""
    width = width or (4 if fps.count() <= MANY else 2)
    cells = fps.select("fp", F.expr(f"explode({points_around(point('fp', width), width)})").alias("key"))
    found = None
    while True:
        sizes = stored(cells.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "simhash-sizes")
        few = sizes if width == 1 else sizes.filter(F.col("size") <= cell)
        here = cell_links(cells.join(few.select("key"), "key"), width)
        found = here if found is None else found.unionByName(here)
        full = sizes.filter(F.col("size") > cell).select("key")
        if width == 1 or full.isEmpty():
            return found.distinct()
        crowded = stored(cells.join(full, "key").groupBy("fp").agg(F.collect_list("key").alias("keys")), "simhash-crowded")
        fine = width // 2
        cells = crowded.select("fp", "keys", F.expr(f"explode({points_around(point('fp', fine), fine)})").alias("key"))
        cells = cells.filter(F.expr(f"array_contains(keys, {coarser('key', fine, width)})")).select("fp", "key")
        width = fine


def classes(docs: DataFrame, cell: int = CELL, width: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``: fingerprints link at two or fewer different
    bits, and component_id is the smallest document id reachable over links. Null texts, empty texts and texts
    of blanks have fingerprint zero, which links like any other; a text of fewer words than a shingle is one
    shingle. Repeated rows and ids stay rows; a null id names a component only where it has no other;
    other columns are ignored; an empty table gives an empty result."""
    rows = stored(fingerprints(docs), "simhash-prints")
    first = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first")
    labels = components(links(first.select("fp"), cell, width)).withColumnRenamed("node", "fp")
    smallest = labels.join(first, "fp").groupBy("label").agg(F.min("first").alias("component"))
    linked = labels.join(smallest, "label").select("fp", "component")
    of_print = first.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    # a fingerprint may be that of most rows: the rows' side is the one that adaptive execution splits
    named = rows.join(of_print, "fp", "left")
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
