"""Near-duplicates by DartMinHash signatures and banded joins, verified exactly.

Each element of a document's weighted set (shingles of five words) owns a region: its weight along one axis,
ranks along the other. Hashed darts fall into the region as a Poisson process of rate one, the same darts for
the same element everywhere. A document looks at its elements' darts up to a rank that is expected to show it
about k (ln k + 2) of them, and keeps the earliest dart of each of its k coordinates; a document in which a
coordinate stays empty looks twice as far. Two documents agree in a coordinate with the probability of their
weighted Jaccard similarity, and the work hardly depends on weights.

Equal texts become one node first, by their digest. Bands of the signatures put nodes into buckets. In a
bucket nodes aren't paired with each other but with a hub: the node that shares most buckets with others, as
the text that the others were copied from does. Pairs are verified on the shingles themselves, and links
joined to classes. A bucket that then holds nodes outside its hub's class is still open: those outsiders are
compared with each other and with the class, in blocks of bounded size, whose tasks count common shingles and
give back one link for each two classes that have any. So there are two rounds, whatever the data.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.common import LOWER_ASCII, bounded_batches, require, stored, table

NAME = "op10_minhash_near_dedup"
ORACLE_SQL = None  # pairs over all texts are too slow for SQL: tests compare with brute force
WORDS, SIMILARITY = 5, 0.8
#: 26 bands of 5 rows: of links at a similarity of exactly 0.8 all but 3 in 100,000 meet in a band.
BANDS, ROWS = 26, 5
#: Nodes, and bytes of their shingles, that make one block of an open bucket, about.
BLOCK_NODES, BLOCK_BYTES = 1024, 8_000_000
#: Ids that are broadcast at most, to pick the rows that are verified.
BROADCAST_IDS = 2_000_000
_U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finalising mix of unsigned integers."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix(np.arange(256, dtype=np.uint64), 99) | _U(1)
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_BASE = 0x9E3779B97F4A7C55


@lru_cache(maxsize=1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def one(base: int) -> np.ndarray:
        steps = np.full(1 << bits, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return one(_BASE), one(pow(_BASE, -1, 2**64))


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the text each belongs to. Words are runs of ASCII letters, digits and all
    code points beyond ASCII, A-Z lower-cased; a text with fewer words than a shingle, but not none, is one
    shingle."""
    data = [(t or "").encode("utf-8", "replace").translate(LOWER_ASCII) for t in texts]
    b = np.frombuffer(b"\0".join(data) + b"\0", np.uint8)
    inside = _IS_WORD[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[0::2], edge[1::2]
    up, down = powers(max(20, int(len(b)).bit_length()))
    total = np.cumsum(_BYTE_VALUE[b] * up[: len(b)], dtype=np.uint64)
    w = mix((total[stop - 1] - np.where(start > 0, total[start - 1], _U(0))) * down[start])
    ends = np.cumsum([len(d) + 1 for d in data])
    of = np.searchsorted(ends, start, "right")
    n = np.bincount(of, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    at = np.flatnonzero(of[: len(of) - words + 1] == of[words - 1 :]) if len(of) >= words else np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    for i in range(words):
        h = h * _U(0xC2B2AE3D27D4EB4F) + w[at + i]
    short = np.flatnonzero((n > 0) & (n < words))
    extra = np.zeros(len(short), np.uint64)
    for i in range(words - 1):
        has = n[short] > i
        extra[has] = extra[has] * _U(0xC2B2AE3D27D4EB4F) + w[first[short[has]] + i]
    hashes, owner = np.concatenate([mix(h), mix(extra, 5)]), np.concatenate([of[at], short])
    return hashes, owner


def dart_minhash(elements: np.ndarray, owner: np.ndarray, n: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n x k uint64) of n weighted sets; element i belongs to set owner[i]. An element that is
    listed twice counts once (its largest weight decides). Sets without elements get zeros."""
    sign = np.zeros((n, k), np.uint64)
    weights = np.ones(len(elements)) if weights is None else weights
    cells = np.maximum(np.ceil(weights), 0).astype(np.int64)
    cell_of = np.repeat(np.arange(len(elements)), cells)
    number = (np.arange(len(cell_of)) - np.repeat(np.cumsum(cells) - cells, cells)).astype(np.uint64)
    seed, own, room = mix(elements[cell_of] + number * _U(0xD6E8FEB86659FD93), 1), owner[cell_of], weights[cell_of] - number
    mass = np.bincount(owner, weights=weights, minlength=n)
    reach = np.divide(k * (np.log(k) + 2), mass, out=np.zeros(n), where=mass > 0)
    todo = np.flatnonzero(mass > 0)
    while len(todo):
        chosen = np.isin(own, todo) if len(todo) < n else slice(None)
        s, o, r = seed[chosen], own[chosen], room[chosen]
        rank, step, limit = np.zeros(len(s)), 0, reach[o]
        least, seen, names = np.full(n * k, np.inf), [], []
        while len(s):
            width = 1 if len(s) > 4096 else 32  # darts of a region drawn at once
            turns = np.arange(step, step + width, dtype=np.uint64)
            dart = mix(s[:, None] + turns * _U(0xA0761D6478BD642F), 2)
            gap = -np.log(((dart >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            ranks = rank[:, None] + np.cumsum(gap, axis=1)
            name = mix(dart, 3)
            high = ((name >> _U(40)).astype(np.float64) + 0.5) * 2.0**-24  # place along the weight
            ok = (ranks <= limit[:, None]) & (high < r[:, None])
            where = np.nonzero(ok)
            key = o[where[0]] * k + (name[where] & _U(0xFFFFFF)).astype(np.int64) % k
            np.minimum.at(least, key, ranks[where])
            seen.append((key, ranks[where]))
            names.append(name[where])
            go = ranks[:, -1] <= limit
            s, o, r, rank, limit, step = s[go], o[go], r[go], ranks[go, -1], limit[go], step + width
        key, ranks, name = np.concatenate([x[0] for x in seen]), np.concatenate([x[1] for x in seen]), np.concatenate(names)
        best = ranks == least[key]
        sign.reshape(-1)[key[best]] = mix(name[best], 4) | _U(1)
        empty = np.isinf(least.reshape(n, k)[todo]).any(axis=1)
        todo = todo[empty]
        reach[todo] *= 2
    return sign


def bands(sign: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(sign), count), np.uint64)
    for b in range(count):
        h = np.full(len(sign), b, np.uint64)
        for r in range(rows):
            h = mix(h ^ sign[:, b * rows + r], 6)
        out[:, b] = h
    return out.view(np.int64)


#: Bytes of text that are hashed at once; a longer text is alone.
PIECE = 1 << 19


def pieces(texts: list[str | None]):
    """Ranges of texts of about PIECE bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > PIECE or i - start >= 256:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def text_digest(docs: DataFrame):
    return F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))


def sketches(docs: DataFrame) -> DataFrame:
    """(digest, doc, bands): a text's digest, the document, and its band hashes (none for a text without
    words)."""
    rows = docs.select(text_digest(docs).alias("digest"), docs["doc_id"].cast("long").alias("doc"), docs["text"].alias("text"))

    def run(batches):
        for b in batches:
            all_texts = b.column(2).to_pylist()
            for start, stop in pieces(all_texts):
                texts = all_texts[start:stop]
                h, owner = shingles(texts)
                some = np.bincount(owner, minlength=len(texts)) > 0
                found = bands(dart_minhash(h, owner, len(texts), BANDS * ROWS))
                lists = pa.array([f if ok else [] for f, ok in zip(found, some, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), b.column(1).slice(start, stop - start), lists], ["digest", "doc", "bands"])

    return bounded_batches(rows).mapInArrow(run, "digest binary, doc long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, shingles): sorted 64-bit hashes of the shingles of the wanted texts (node, digest, doc), each
    once. Shingles are made again for texts that share a band with another, instead of being kept for all."""
    few = wanted.count() <= BROADCAST_IDS
    rows = docs.select(text_digest(docs).alias("digest"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("doc"), docs["text"].alias("text"))
    rows = rows.join(F.broadcast(wanted) if few else wanted, ["digest", "doc"]).select("node", "text")

    def run(batches):
        for b in batches:
            all_texts = b.column(1).to_pylist()
            for start, stop in pieces(all_texts):
                h, owner = shingles(all_texts[start:stop])
                order = np.argsort(owner, kind="stable")
                cut = np.cumsum(np.bincount(owner, minlength=stop - start))[:-1]
                own = [np.unique(x) for x in np.split(h[order], cut)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), pa.array([len(x) for x in own], pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "n", "shingles"])

    return bounded_batches(rows).mapInArrow(run, "node long, n int, shingles binary").dropDuplicates(["node"])


def enough(both, x, y, similarity: float):
    """Whether sets of x and y elements with some in both reach the Jaccard similarity."""
    return both >= similarity * (x + y - both) - 1e-9


def star_links(stars: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs (node, hub) that are alike."""

    @F.pandas_udf("boolean")
    def alike(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            out.append(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity))
        return pd.Series(out, dtype=bool)

    left = sets.select("node", F.col("shingles").alias("sa"), "n")
    right = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("sb"), F.col("n").alias("hub_n"))
    near = stars.join(left, "node").join(right, "hub").filter(F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n") - 1e-9)
    return bounded_batches(near, 512).filter(alike("sa", "sb")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def common_shingles(sets: list[np.ndarray], often: int = 8, width: int = 2048) -> np.ndarray:
    """How many elements each two of the sets have in common: rare elements by their pairs, others by products
    of slices of the membership matrix."""
    m = len(sets)
    value, who = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")
    value, who = value[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    held = np.diff(np.concatenate([first, [len(value)]]))
    rare = np.repeat(held <= often, held)
    both = np.zeros((m, m), np.float32)
    v, w = value[rare], who[rare]
    for step in range(1, often):
        at = np.flatnonzero(v[step:] == v[:-step])
        np.add.at(both, (w[at], w[at + step]), np.float32(1))
    both += both.T
    column, w = np.repeat(np.arange((held > often).sum()), held[held > often]), who[~rare]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        member = np.zeros((m, width), np.float32)
        member[w[lo:hi], column[lo:hi] - start] = 1
        both += member @ member.T
    return both


def open_links(rows: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): classes (labels) that a link joins in a bucket whose nodes are of several. rows: bucket, node,
    hub. Of each bucket the outsiders, in blocks, meet each other and the blocks of the hub's class."""
    named = rows.join(labels, "node", "left").select("bucket", "node", "hub", F.coalesce("label", "node").alias("label"))
    open_ = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("node") == F.col("hub"), F.col("label"))).alias("chief"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.col("node") % 1_000_003).alias("y"))
    # of buckets with the same nodes one is enough
    open_ = open_.filter("low <> high AND size > 2").groupBy("size", "x", "y").agg(F.min(F.struct("bucket", "chief")).alias("o")).select("o.bucket", "o.chief")
    left = named.join(open_, "bucket").join(sets.select("node", "n"), "node").select("bucket", "node", "label", "n", (F.col("label") != F.col("chief")).cast("int").alias("out"))
    left = stored(left, "near-open")

    def blocks(side):
        mine = F.col("out") == side
        return F.greatest(F.lit(1), F.ceil(F.count_if(mine) / BLOCK_NODES), F.ceil(F.sum(F.when(mine, F.col("n")).otherwise(0)) * 8 / BLOCK_BYTES)).cast("int")

    cut = left.groupBy("bucket").agg(blocks(1).alias("outs"), blocks(0).alias("ins"))
    placed = left.join(cut, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("out") == 1, F.col("outs")).otherwise(F.col("ins"))).cast("int"))
    every = F.sequence(F.lit(0), F.col("outs") - 1)
    meets = F.when(F.col("out") == 0, F.transform(every, lambda i: F.struct(i.alias("i"), (F.col("outs") + F.col("own")).alias("j"), F.lit(1).alias("side")))).otherwise(
        F.concat(
            F.transform(every, lambda j: F.struct(F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j"), (F.col("own") > j).cast("int").alias("side"))),
            F.transform(F.sequence(F.lit(0), F.col("ins") - 1), lambda j: F.struct(F.col("own").alias("i"), (F.col("outs") + j).alias("j"), F.lit(0).alias("side"))),
        )
    )
    met = placed.select("bucket", "node", "label", "n", F.explode(meets).alias("m")).select("bucket", "m.i", "m.j", "m.side", "node", "label", "n")

    def compare(group):
        import pandas as pd

        label, side, n = (group[c].to_numpy() for c in ("label", "side", "n"))
        both = common_shingles([np.frombuffer(x, np.uint64) for x in group["shingles"]])
        good = enough(both.astype(np.float64), n[:, None], n[None, :], similarity) & (label[:, None] < label[None, :])
        if group["i"].iloc[0] != group["j"].iloc[0]:
            good &= side[:, None] != side[None, :]
        a, b = np.nonzero(good)
        return pd.DataFrame({"a": label[a], "b": label[b]}).drop_duplicates()

    return met.join(sets.select("node", "shingles"), "node").groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): each linked node's smallest connected node. Labels spread to neighbours and then jump
    to their label's label; every round is stored, and only a count of changes reaches the driver."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = stored(labels, "near-labels")
    while True:
        seen = both.join(labels.withColumnsRenamed({"node": "b", "label": "l"}), "b").groupBy("a").agg(F.min("l").alias("l"))
        spread = labels.join(seen, labels["node"] == seen["a"]).select("node", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = spread.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        new = stored(new, "near-labels")
        changed = new.filter(F.col("label") != F.col("old")).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def merged(labels: DataFrame, classes_: DataFrame) -> DataFrame:
    """labels (node, label) after some labels have been joined: classes_ names each joined one's new label."""
    joined = classes_.select(F.col("node").alias("old"), F.col("label").alias("new"))
    known = labels.join(joined, labels["label"] == joined["old"], "left").select("node", F.coalesce("new", "label").alias("label"))
    alone = joined.join(labels.select("node"), joined["old"] == F.col("node"), "left_anti")  # nodes without a link so far
    return known.unionByName(alone.select(F.col("old").alias("node"), F.col("new").alias("label")))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, class_id, class_texts): for each row of ``docs`` the smallest document id of its class
    and the number of different texts in it. Equal texts are one class; null counts as an empty text; texts
    without words are alike only if equal; null ids sort after all others and give a null class only where
    a class has no other id."""
    docs = require(docs, "doc_id", "text")
    sketched = stored(sketches(docs).withColumn("place", F.monotonically_increasing_id()), "near-sketches")
    # a node is a text, named by the place of one row that holds it
    texts = stored(sketched.groupBy("digest").agg(F.min(F.struct(F.coalesce("doc", F.lit(0)).alias("doc"), "place")).alias("f")).select("digest", "f.doc", F.col("f.place").alias("node")), "near-texts")
    nodes = sketched.join(texts.select(F.col("node").alias("place")), "place", "left_semi")
    spread = nodes.select(F.col("place").alias("node"), F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    rows = stored(spread.join(full, "bucket"), "near-buckets")
    weight = rows.groupBy("node").agg(F.sum("size").alias("weight"))
    rows = stored(rows.join(weight, "node"), "near-buckets")
    sets = stored(shingle_sets(docs, texts.join(weight.select("node"), "node", "left_semi")), "near-sets")
    hubs = rows.groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    rows = stored(rows.join(hubs, "bucket").select("bucket", "node", "hub"), "near-stars")
    labels = components(star_links(rows.filter("node <> hub").select("node", "hub").distinct(), sets, similarity))
    more = stored(open_links(rows, labels, sets, similarity), "near-more")
    if not more.isEmpty():
        labels = merged(labels, components(more))
    of_text = texts.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    named = sketched.select("digest", F.col("doc").alias("doc_id")).join(of_text, "digest")
    size = named.groupBy("label", "digest").agg(F.min("doc_id").alias("doc_id")).groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_texts"))
    return named.join(size, "label").select("doc_id", "digest", "class_id", "class_texts")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold the smallest id of their class, with all their columns. Repeated rows
    of that document stay together; a class of null ids alone stays."""
    found = classes(docs, similarity)
    gone = found.filter(F.col("class_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (text_digest(docs) == gone["gone_digest"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_texts")
