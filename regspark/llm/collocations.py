"""Phrase collocation mining by Misra-Gries summaries over hash partitions and an exact second count.

A phrase counts from LEAST occurrences on. Phrases are hashed, and hashes dealt to partitions by their first bits.
Tasks summarise their batches (each different hash once, with its count), and the summaries of a partition are
merged into one of limited capacity: beyond it, the counter next in size is taken off all of them. With a capacity
of more than the partition's mass divided by LEAST, less than LEAST is taken off altogether, so every frequent
phrase survives, in memory that depends on the mass of a partition alone.

Words and word pairs are summarised first; longer phrases only where all pairs in them have survived, since a
phrase is never more frequent than its parts. Survivors are written as bits of a filter of a fixed largest size,
which a second pass over the texts uses to count phrases exactly, as strings: what the filter lets through in
error is counted, found infrequent and dropped, so the results don't depend on its size, nor on hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regspark.llm.common import LOWER, UPPER, bounded_batches, stored, table

NAME = "op13_phrase_collocations"
LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text of which a partition gets the phrases, about; the number of partitions, as powers of two.
SHARE, FEWEST, MOST = 2_000_000, 4, 14
#: The filter has 16 bits for each survivor, and 2 to this power (64 MB) at most.
FILTER_BITS = 29
#: Bytes of text to a batch, about.
BATCH = "4m"
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_SIGNS = bytes(10 if b in _SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of one language's texts in a batch, as numbers; -1 stands between pieces."""

    def __init__(self, lang: str, texts: list[bytes]):
        import xxhash

        data = b"\n".join(texts).translate(_SIGNS).replace(b"\n", b" \n ")
        coded = pc.split_pattern(pa.array([data], pa.large_binary()), " ").values.dictionary_encode()
        self.spelled = coded.dictionary
        spelled = self.spelled.to_pylist()
        code = np.arange(len(spelled))
        code[[i for i, s in enumerate(spelled) if s == b"\n"]] = -1
        code[[i for i, s in enumerate(spelled) if not s]] = -2
        self.codes = code[coded.indices.to_numpy()]
        self.codes = self.codes[self.codes != -2]
        self.total = int((self.codes >= 0).sum())
        seed = xxhash.xxh32_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in spelled), np.uint64, len(spelled))

    def phrases(self, longest: int, passes=None):
        """For each length: the different phrases' hashes, counts, places of their first part among the phrases
        one word shorter, and last words. ``passes(length, hashes)`` says which may be parts of longer ones."""
        import pandas as pd

        n, size = len(self.codes), max(1, len(self.spelled))
        place = np.flatnonzero(self.codes >= 0)
        key, hashes = self.codes[place], np.zeros(1, np.uint64)
        for length in range(1, longest + 1):
            code, different = pd.factorize(key)
            part, word = np.divmod(different, size)
            hashes = mixed(hashes[part] * _U(0x9E3779B97F4A7C15) + self.hashes[word] + _U(length))
            yield length, hashes, np.bincount(code, minlength=len(different)), part, word
            ok = None if passes is None else passes(length, hashes)
            at = np.full(n + 1, -1, np.int64)
            at[place] = code if ok is None else np.where(ok[code], code, -1)
            place = place[(at[place] >= 0) & (at[place + 1] >= 0)]
            key = at[place] * size + self.codes[place + length] if len(place) else np.zeros(0, np.int64)


def by_language(batch: pa.RecordBatch):
    langs = pc.fill_null(batch.column(0), "und").dictionary_encode()
    texts = pc.fill_null(batch.column(1), "").cast(pa.binary())
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, Words(lang, texts.filter(pc.equal(langs.indices, i)).to_pylist())


class Filter:
    """Whether a phrase of some length may be frequent, by the first bits of its hash."""

    def __init__(self, short, long=None):
        self.short, self.long = short, long

    def __call__(self, length: int, hashes: np.ndarray):
        bits = self.short if length <= 2 else self.long
        if bits is None:
            return None
        have = np.frombuffer(bits.value, np.uint8)
        at = (hashes >> _U(64 - (len(have).bit_length() + 2))).astype(np.int64)
        return (have[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def summaries(rows: DataFrame, lengths: tuple[int, int], partition_bits: int, passes=None) -> DataFrame:
    """(part, mass, keys, counts): per batch and hash partition the next 32 bits of its different phrases'
    hashes, ascending, and how often they occur."""

    def run(batches):
        for batch in batches:
            hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, words in by_language(batch):
                for length, h, n, _, _ in words.phrases(lengths[1], passes):
                    if length >= lengths[0]:
                        hashes.append(h)
                        counts.append(n)
            h, n = np.concatenate(hashes), np.concatenate(counts)
            order = np.argsort(h)
            h, n = h[order], n[order]
            part = (h >> _U(64 - partition_bits)).astype(np.int64)
            key = (h >> _U(32 - partition_bits)).astype(np.uint32)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(h) else np.zeros(0, np.int64)
            edges = [*first.tolist(), len(h)]
            spans = list(zip(edges, edges[1:], strict=False))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[first], pa.int32()), pa.array([int(n[i:j].sum()) for i, j in spans], pa.int64()),
                    pa.array([key[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([n[i:j].astype(np.uint32).tobytes() for i, j in spans], pa.binary()),
                ],
                ["part", "mass", "keys", "counts"],
            )

    return bounded_batches(rows, 4096, BATCH).mapInArrow(run, "part int, mass long, keys binary, counts binary")


class Summary:
    """A Misra-Gries summary: counters of ``capacity`` keys at most, each too low by ``taken`` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting, self.held = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts.astype(np.int64)))
        self.held += len(keys)
        if self.held > max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            keys, counts, self.taken = keys[counts > off], counts[counts > off] - off, self.taken + off
        self.keys, self.counts, self.waiting, self.held = keys, counts, [], 0

    def survivors(self, least: int) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.taken >= least]


def survivors(parts: DataFrame, least: int) -> DataFrame:
    """(part, n, keys): the keys that may stand for ``least`` occurrences or more, of each hash partition. A
    partition's summaries stream through one merged summary; Spark sorts them, and knows their mass before."""
    rows = parts.withColumn("total", F.sum("mass").over(Window.partitionBy("part")))

    def run(batches):
        now, summary = None, None
        for batch in batches:
            for part, total, keys, counts in zip(*[batch.column(c).to_pylist() for c in ("part", "total", "keys", "counts")], strict=True):
                if part != now:
                    if summary is not None:
                        yield found(now, summary)
                    now, summary = part, Summary(total // least + 1)
                summary.add(np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.uint32))
        if summary is not None:
            yield found(now, summary)

    def found(part, summary):
        keys = summary.survivors(least)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary())], ["part", "n", "keys"])

    return bounded_batches(rows.select("part", "total", "keys", "counts"), 4096, "16m").mapInArrow(run, "part int, n long, keys binary")


def filter_bits(found: DataFrame, partition_bits: int):
    """The survivors' filter, broadcast: a bit for each range of hashes that holds one. Each partition is a
    slice of it, made where its survivors are; the whole has 64 MB at most, whatever the corpus."""
    total = found.agg(F.sum("n")).first()[0] or 0
    bits = min(FILTER_BITS, max(partition_bits + 3, math.ceil(math.log2(16 * total + 1))))
    size, shift = 1 << (bits - partition_bits - 3), 32 - (bits - partition_bits)

    def run(batches):
        for batch in batches:
            slices = []
            for keys in batch.column(1).to_pylist():
                at, out = np.frombuffer(keys, np.uint32) >> np.uint32(shift), np.zeros(size, np.uint8)
                np.bitwise_or.at(out, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
                slices.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slices, pa.binary())], ["part", "slice"])

    whole = bytearray(1 << (bits - 3))
    for row in found.select("part", "keys").mapInArrow(run, "part int, slice binary").toLocalIterator():
        whole[row.part * size : (row.part + 1) * size] = row.slice
    return found.sparkSession.sparkContext.broadcast(bytes(whole))


#: Phrases with counts that a task holds before it sums them, and of different ones before it hands them on.
HELD, DIFFERENT = 1_500_000, 750_000


def exact_counts(rows: DataFrame, passes: Filter, longest: int) -> DataFrame:
    """(lang, length, phrase, f) of the phrases that the filter lets through; length 0 counts all words. A task
    sums over its batches first, in bounded memory."""

    def summed(held: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(held).group_by(["lang", "length", "phrase"]).aggregate([("f", "sum")])
        return out.rename_columns(["lang", "length", "phrase", "f"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for lang, words in by_language(batch):
                out, names = [(0, pa.array([b""], pa.large_binary()), np.array([words.total]))], None
                for length, h, n, part, word in words.phrases(longest, passes):
                    last = words.spelled.take(pa.array(word))
                    names = last if names is None else pc.binary_join_element_wise(names.take(pa.array(part)), last, pa.scalar(b" ", pa.large_binary()))
                    ok = passes(length, h)
                    out.append((length, names.filter(pa.array(ok)), n[ok]))
                for length, phrase, n in out:
                    phrase = phrase.cast(pa.large_string()).cast(pa.string())
                    held.append(pa.table({"lang": pa.array([lang] * len(n), pa.string()), "length": pa.array(np.full(len(n), length), pa.int32()), "phrase": phrase, "f": pa.array(n, pa.int64())}))
                    size += len(n)
            if size > HELD:
                held = [summed(held)]
                size = len(held[0])
                if size > DIFFERENT:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from summed(held).to_batches()

    found = bounded_batches(rows, 4096, BATCH).mapInArrow(run, "lang string, length int, phrase string, f long")
    return found.groupBy("lang", "length", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, length, phrase, f): all phrases with ``least`` occurrences or more, and length 0 for all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST, max(FEWEST, math.ceil(math.log2(size / SHARE + 1))))
    short = filter_bits(stored(survivors(summaries(rows, (1, 2), bits), least), "phrase-survivors"), bits)
    long = filter_bits(stored(survivors(summaries(rows, (3, longest), bits, Filter(short)), least), "phrase-survivors"), bits) if longest > 2 else None
    counts = stored(exact_counts(rows, Filter(short, long), longest).filter(f"f >= {least} OR length = 0"), "phrase-counts")
    for held in (short, long):
        if held is not None:
            held.unpersist()
    return counts


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language its ``top`` collocations. Null languages are ``und``;
    null and empty texts have no words; repeated rows count again; ties go by a, then by the phrase's bytes; other
    columns are ignored; an empty table, or one without a frequent phrase, gives an empty result."""
    counts = frequent_phrases(docs, least, longest)
    words = counts.filter("length = 0").select("lang", F.col("f").alias("n"))
    parts = counts.filter("length > 0").select("lang", "phrase", "f")
    candidates = counts.filter("length > 1").select("lang", "length", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    # whoever is as frequent as its part makes the part superfluous; parts of parts follow from that
    longer = candidates.filter("length > 2").select("lang", "a", F.explode(F.array(F.expr("slice(words, 1, length - 1)"), F.expr("slice(words, 2, length - 1)"))).alias("inner"))
    longer = longer.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a").drop("longer")
    cut = kept.select("lang", "phrase", "a", "words", "length", F.explode(F.expr("sequence(1, length - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("head"), F.expr("array_join(slice(words, k + 1, length - k), ' ')").alias("tail"))
    heads, tails = parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(words, "lang")
    exact = "(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first in buckets of a language, then in what is left of it
    some = best.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\n-\r]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM lists, range(1, {LONGEST + 1}) t(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS g ON c.lang = g.lang AND g.m > c.m AND 100 * g.a >= 100 * c.a AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' ')),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (
  SELECT cuts.lang, cuts.phrase, a, k, h.f AS l, t.f AS r, n.n, ((1000::HUGEINT * a * n.n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail JOIN n ON n.lang = cuts.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank FROM low ANTI JOIN gone USING (lang, phrase))
WHERE rank <= {TOP}
"""
