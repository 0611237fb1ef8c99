"""Language-model scoring by online logistic context mixing.

A text is a stream of tokens. Each token of the vocabulary (the most frequent training words, the end token, and
one symbol for all rarer words) has a prefix code after its count, and is coded in the decisions of its path.
Predictors look at what came before, across words: nothing (the decision's own counts, exact), the word before,
the two words before, and the last two very frequent words, which tell language and style. Their hashed counts
are mixed by gated weights and refined (``lm_mixer``). A rarer word pays for its symbol in that stream, and
then for which of them it is: by its exact count, absolutely discounted; the mass so set free goes to words
seen once or never by their spelling, whose bytes are coded bit by bit by a second mixer over the last two to five bytes. That second part
doesn't depend on what came before, so it is computed once for each distinct word.

Counts cover all training tokens. Tasks count into tables of a bounded size, learn weights as they go, and
Spark adds the tables up; the summed tables, two bytes a slot, and the vocabulary are broadcast, both of a
bounded size. Rarer words meet their exact counts by a join.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.common import LOWER_ASCII, bounded_batches, require, stored, table
from regspark.llm.lm_mixer import Code, Mixer, Tables, mix, settled

NAME = "op5_lm_scoring"
ORACLE_SQL = None  # the model's score has no SQL; tests recompute the base score and the model by brute force
ALPHA = 0.1
#: Words of the vocabulary at most, the count they need, and bytes beyond which a word goes by its digest.
VOCABULARY, LEAST_COUNT, KEY_BYTES = 1 << 17, 2, 64
#: Very frequent words that contexts remember.
FREQUENT = 32
#: Bits of a hashed table: four slots for each training token, within these.
LEAST_BITS, MOST_BITS = 16, 21
#: Tokens and distinct words that one task counts, about; a word map that is full is handed on.
TASK_TOKENS, TASK_WORDS, FLUSH = 20_000_000, 1_000_000, 600_000
#: Orders of the spelling's contexts; entries of a block of counts; blocks added up at once.
ORDERS, BLOCK, FAN = (2, 4, 5), 1 << 16, 32
_GROUP, _SLICE, _PADS = 1 << 15, 4096, 3
_U = np.uint64


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, split at ASCII white space; the end token is the empty word."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER_ASCII).split()
    words.append(b"")
    return words


def key(word: bytes) -> bytes:
    """The word, or for a long one its digest behind a byte that no text holds."""
    return word if len(word) <= KEY_BYTES else b"\xff" + hashlib.sha256(word).digest()


@dataclass
class Batch:
    """The tokens of some texts, as ``tokens`` gives them: how many each text has, which of the distinct words
    each token is, and those words."""

    sizes: np.ndarray
    of: np.ndarray
    words: list[bytes]

    @classmethod
    def split(cls, texts: pa.Array) -> Batch:
        none, blank = (pa.scalar(x, texts.type) for x in ("", " "))
        texts = texts.take(pa.array(np.arange(len(texts))))  # a copy: Arrow lower-cases some slices of larger arrays wrongly
        texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, none)))
        ended = pc.if_else(pc.equal(texts, none), texts, pc.binary_join_element_wise(texts, none, blank))  # what follows the last blank is the end
        lists = pc.ascii_split_whitespace(ended)
        found = lists.flatten().dictionary_encode()
        words = found.dictionary.cast(pa.binary() if texts.type == pa.string() else pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        return cls(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), found.indices.to_numpy(), words)


def give_back() -> None:
    """Hands what Arrow has freed back to the system, as workers live on after a task."""
    pa.default_memory_pool().release_unused()


# -- counting words ----------------------------------------------------------------------------
def word_counts(docs: DataFrame) -> DataFrame:
    """(key, word, c): every distinct word of ``docs`` (text, learn) with its count in rows that are learned
    from; ``word`` only where the key is a digest."""

    def run(batches):
        seen, n = [], 0

        def added() -> pa.Table:
            return pa.Table.from_batches(seen).group_by(["key", "word"], use_threads=False).aggregate([("c", "sum")]).rename_columns(names)

        for b in batches:
            text = Batch.split(b.column(0))
            learn = np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(bool), text.sizes)
            count = np.bincount(text.of[learn], minlength=len(text.words))
            long = [w if len(w) > KEY_BYTES else None for w in text.words]
            seen.append(pa.RecordBatch.from_arrays([pa.array(map(key, text.words), pa.binary()), pa.array(long, pa.binary()), pa.array(count, pa.int64())], names))
            n += len(count)
            if n > flush:
                seen = added().combine_chunks().to_batches()
                n = sum(x.num_rows for x in seen)
                if n > flush // 2:
                    yield from seen
                    seen, n = [], 0
                give_back()
        if seen:
            yield from added().to_batches()
        seen = []
        give_back()

    names, flush = ["key", "word", "c"], FLUSH
    counted = bounded_batches(docs.select("text", "learn")).mapInArrow(run, "key binary, word binary, c long")
    return stored(counted.groupBy("key", "word").agg(F.sum("c").alias("c")), "lm-words")


@dataclass
class Vocabulary:
    """Symbols from 1, by falling count; 0 stands for all other words."""

    index: dict[bytes, int]
    counts: np.ndarray
    code: Code
    total: int  # training tokens
    distinct: int
    rare_total: int  # training tokens outside the vocabulary, their distinct words, and how much a count gives up
    rare_distinct: int
    discount: float

    @classmethod
    def of(cls, words: DataFrame) -> Vocabulary:
        end = F.octet_length("key") == 0
        best = words.filter((F.col("c") >= LEAST_COUNT) | end).orderBy(F.desc("c"), "key").limit(VOCABULARY).select("key", "c").toArrow()
        keys, counts = best.column(0).to_pylist(), best.column(1).to_numpy().astype(np.int64)
        if b"" not in keys:  # fewer documents than other words have occurrences, or none at all
            found = words.filter(end).select("c").first()
            keys, counts = [*keys, b""], np.concatenate([counts, [found["c"] if found else 0]])
        n, v, one, two = (x or 0 for x in words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first())
        counts = np.concatenate([[0], counts])
        rest = int(n - counts.sum())
        code = Code([max(rest, 1), *(max(int(c), 1) for c in counts[1:])])
        return cls({k: i + 1 for i, k in enumerate(keys)}, counts, code, int(n), int(v), rest, int(v - (counts > 0).sum()), (one + 0.5) / (one + 2 * two + 1))

    def base(self, c):
        return np.log10((np.asarray(c, float) + ALPHA) / (self.total + ALPHA * (self.distinct + 1)))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.index.get, words, repeat(0)), np.int64, len(words))
        for i in np.flatnonzero(out == 0).tolist():
            if len(words[i]) > KEY_BYTES:
                out[i] = self.index.get(key(words[i]), 0)
        return out

    def nodes(self) -> np.ndarray:
        """The zeros and ones at each node of the code in the training tokens."""
        return self.code.totals(np.concatenate([[self.rare_total], self.counts[1:]]))

    def rare(self, c: np.ndarray, spell: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Log10 of the probability of words outside the vocabulary with counts c, given that one comes: what
        the discount leaves of the count; for words seen once or never also their spelling's share of what it
        takes. spell: gives the spelling's log10 of the words at some places."""
        few = np.flatnonzero(c < 2)
        spelled = spell(few)
        if not self.rare_total:
            return spelled
        kept = np.maximum(c - self.discount, 0) / self.rare_total
        out = np.log(np.maximum(kept, 1e-300))
        free = min(0.0, math.log(self.discount * max(self.rare_distinct, 1) / self.rare_total))
        out[few] = np.logaddexp(np.where(kept[few] > 0, out[few], -np.inf), free + spelled * math.log(10))
        return out / math.log(10)


# -- the token stream --------------------------------------------------------------------------
def named(vocabulary: Vocabulary, batch: Batch):
    """How many tokens each text has, and each token's symbol and its name in contexts: the symbol, or for other
    words what their last two bytes tell."""
    symbol = vocabulary.numbers(batch.words)
    name = symbol.astype(np.uint64)
    for i in np.flatnonzero(symbol == 0).tolist():
        name[i] = (1 << 32) + int.from_bytes(batch.words[i][-2:], "big")
    return batch.sizes, symbol.take(batch.of), name.take(batch.of)


def stream(vocabulary: Vocabulary, sizes: np.ndarray, symbols: np.ndarray, names: np.ndarray, tables: Tables):
    """For slices of the token stream of documents (see ``named``): the tokens' documents, how many decisions each
    token has, and the slots and bits of all decisions."""
    end = vocabulary.index[b""]
    stops = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        begin = stops[first] - sizes[first]
        last = min(int(np.searchsorted(stops, begin + _GROUP)), len(sizes) - 1)
        of = np.repeat(np.arange(last + 1 - first), sizes[first : last + 1])
        place = np.arange(len(of)) + _PADS * (of + 1)  # each document comes after ends
        symbol = np.full(len(of) + _PADS * (last + 1 - first), end, np.int64)
        name = symbol.astype(np.uint64)
        symbol[place], name[place] = symbols[begin : stops[last]], names[begin : stops[last]]
        often = np.maximum.accumulate(np.where((symbol > 0) & (symbol <= FREQUENT) | (symbol == end), np.arange(len(symbol)), 0))
        for at in range(0, len(of), _SLICE):
            here = place[at : at + _SLICE]
            near = often[here - 1]
            a, b = name[near], name[often[near - 1]]
            one, two = name[here - 1], name[here - 2]
            contexts = [mix(one + _U(1 << 40)), mix(mix(one + _U(2 << 40)) + two), mix((np.minimum(a, b) << _U(20) | np.maximum(a, b)) + _U(3 << 50))]
            decisions, node, bit = vocabulary.code.decisions(symbol[here])
            yield first + of[at : at + _SLICE], decisions, tables.slots(contexts, decisions, node), bit
        first = last + 1


def stream_mixer(tables: Tables) -> Mixer:
    return Mixer(tables, (2, 1))


# -- spelling ----------------------------------------------------------------------------------
def spell(words: list[bytes], tables: Tables):
    """For slices of the words' bytes, each word ended by a space: the bytes' words, and slots and bits of all
    decisions, eight a byte."""
    at = 0
    while at < len(words):
        stop, size = at, 0
        while stop < len(words) and size < 2 * _SLICE:
            size += len(words[stop]) + 1
            stop += 1
        pads = max(ORDERS)
        flat = np.frombuffer(b"".join(b" " * pads + w + b" " for w in words[at:stop]), np.uint8).astype(np.uint64)
        sizes = np.array([len(w) + 1 for w in words[at:stop]])
        of = np.repeat(np.arange(stop - at), sizes)
        place = np.arange(len(of)) + pads * (of + 1)
        for cut in range(0, len(place), 2 * _SLICE):  # a very long word is coded in parts
            here = place[cut : cut + 2 * _SLICE]
            h, contexts = np.zeros(len(here), np.uint64), []
            for k in range(1, pads + 1):
                h = (h + flat[here - k] + _U(1)) * _U(0x9E3779B97F4A7C15)
                if k in ORDERS:
                    contexts.append(mix(h + _U(k)))
            byte = flat[here].astype(np.int64)
            node = np.stack([(byte | 256) >> (8 - i) for i in range(8)], axis=1).ravel()
            bit = np.stack([byte >> (7 - i) & 1 for i in range(8)], axis=1).ravel()
            yield at + of[cut : cut + 2 * _SLICE], tables.slots(contexts, 8, node), bit
        at = stop


def spelling_mixer(tables: Tables) -> Mixer:
    return Mixer(tables, (2, 1))


# -- learning ----------------------------------------------------------------------------------
def fitted(rows: DataFrame, tasks: int, mixer: Callable[[], Mixer], feed, known: Callable[[], np.ndarray | None] = lambda: None) -> Mixer:
    """A mixer that has learned from all ``rows``, in about ``tasks`` tasks; ``feed(batch)`` gives the slots and
    bits of an Arrow batch, ``known()`` the first predictor's counts, if they needn't be counted. Tables are
    added up block by block, FAN tasks at a time."""

    def run(batches):
        m = mixer().begin(known())
        for b in batches:
            for slots, bit in feed(b):
                m.learn(slots, bit)
        give_back()
        if m.known:
            m.counts[: m.tables.offsets[1]] = 0  # not to be added up
        part, flat = TaskContext.get().partitionId(), m.counts.reshape(-1)

        def block(i, data):
            return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["block", "part", "data"])

        yield block(-1, m.learned())
        for i in range(0, len(flat), BLOCK):
            if flat[i : i + BLOCK].any():
                yield block(i // BLOCK, flat[i : i + BLOCK].astype(np.float32))

    def total(group):
        kind = np.float64 if group["block"].iloc[0] < 0 else np.float32
        return sum(np.frombuffer(x, kind).astype(np.float64) for x in group["data"]), kind

    def add(group):
        data, kind = total(group)
        return group.iloc[:1].assign(data=[data.astype(kind).tobytes()])

    def finish(group):
        data, kind = total(group)
        return group.iloc[:1].assign(data=[data.tobytes() if kind is np.float64 else settled(data.reshape(-1, 2)).tobytes()])

    schema = "block int, part int, data binary"
    parts = bounded_batches(rows.coalesce(tasks), 512).mapInArrow(run, schema)
    while tasks > FAN:
        parts = parts.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("block", "part").applyInPandas(add, schema)
        tasks = -(-tasks // FAN)
    made = mixer()
    learned, out = np.zeros(len(made.learned())), np.zeros(made.tables.size, np.int16)
    for r in parts.groupBy("block").applyInPandas(finish, schema).collect():  # two bytes a slot
        if r["block"] < 0:
            learned = np.frombuffer(r["data"], np.float64)
        else:
            out[r["block"] * BLOCK // 2 : (r["block"] + 1) * BLOCK // 2] = np.frombuffer(r["data"], np.int16)
    if (first := known()) is not None:
        out[: len(first)] = settled(first)
    return made.settle(learned, out)


def bits_for(n: int, least: int = LEAST_BITS, most: int = MOST_BITS) -> int:
    return min(most, max(least, math.ceil(math.log2(n + 1))))


@dataclass
class Model:
    vocabulary: Vocabulary
    stream: Mixer
    spelling: Mixer
    words: DataFrame  # key, word, c

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """Log10 of the probability of each word's bytes; over all byte strings they sum to one at most."""
        out = np.zeros(len(words))
        for of, slots, bit in spell(words, self.spelling.tables):
            out += np.bincount(of, self.spelling.log10(slots, bit).reshape(-1, 8).sum(axis=1), len(words))
        return out

    def logs(self, sizes: np.ndarray, symbols: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Log10 of the probability of each document (see ``named``) as symbols."""
        out = np.zeros(len(sizes))
        for of, n, slots, bit in stream(self.vocabulary, sizes, symbols, names, self.stream.tables):
            each = np.add.reduceat(self.stream.log10(slots, bit), np.cumsum(n) - n)
            out[of[0] : of[-1] + 1] += np.bincount(of - of[0], each)
        return out

    def streamed(self, documents):
        """Documents, given by words and symbols, and their log10 probabilities as symbols."""
        words = [w for ws, _ in documents for w in ws]
        sizes = np.array([len(ws) for ws, _ in documents])
        yield documents, self.logs(*named(self.vocabulary, Batch(sizes, np.arange(len(words)), words)))


def fit(docs: DataFrame) -> Model:
    """Learns from rows (text, learn)."""
    spark = docs.sparkSession
    words = word_counts(docs)
    vocabulary = Vocabulary.of(words)
    sent = spark.sparkContext.broadcast(vocabulary)
    tables = Tables(vocabulary.code.nodes, 3, bits_for(4 * vocabulary.total))
    spelling_tables = Tables(256, len(ORDERS), bits_for(16 * vocabulary.distinct, most=MOST_BITS - 1))
    cores = spark.sparkContext.defaultParallelism

    def feed_text(b):
        for *_, slots, bit in stream(sent.value, *named(sent.value, Batch.split(b.column(0))), tables):
            yield slots, bit

    def feed_words(b):
        for _, slots, bit in spell([w if w is not None else k for k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], spelling_tables):
            yield slots, bit

    streamed = fitted(docs.filter("learn").select("text"), max(cores, vocabulary.total // TASK_TOKENS), lambda: stream_mixer(tables), feed_text, lambda: sent.value.nodes())
    spelled = fitted(words.filter("c > 0").select("key", "word"), max(cores, vocabulary.distinct // TASK_WORDS), lambda: spelling_mixer(spelling_tables), feed_words)
    return Model(vocabulary, streamed, spelled, words)


# -- scoring -----------------------------------------------------------------------------------
def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, learn): doc_id, n_tokens, n_known, train_tokens, base_score,
    score, n_bytes. Null texts are empty (one end token). With nothing to learn from, counts are 0 and the
    score is that of untrained mixers. Repeated rows, and rows of the same or no id, are scored each. An empty
    table gives an empty result."""
    spark = docs.sparkSession
    model = fit(docs)
    words, model.words = model.words, None
    sent = spark.sparkContext.broadcast(model)
    total = model.vocabulary.total

    def rare(batches):
        m = sent.value
        for b in batches:
            rows = [(k, w if w is not None else k, c) for k, w, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if k not in m.vocabulary.index]
            c = np.array([r[2] for r in rows], np.int64)
            logs = m.vocabulary.rare(c.astype(float), lambda at, rows=rows: m.spelled([rows[i][1] for i in at.tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array(c > 0), pa.array(m.vocabulary.base(c)), pa.array(logs)], ["key", "known", "base", "model"])

    rares = bounded_batches(words, 20_000).mapInArrow(rare, "key binary, known boolean, base double, model double")

    def look_up(batches):
        """A row of each document with its sums over the vocabulary, and one of each other word in it."""
        m = sent.value
        v, row = m.vocabulary, TaskContext.get().partitionId() << 40
        base, known = v.base(v.counts), (v.counts > 0).astype(float)
        base[0] = 0.0
        for b in batches:
            text = Batch.split(b.column(1))
            sizes, symbols, names = named(v, text)
            n, doc = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            sums = [np.bincount(doc, each.take(symbols), n) for each in (known, base)]
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            columns = [b.column(0), pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), size, pa.array(m.logs(sizes, symbols, names))]
            own = [b"\xff\xff" + (row + i).to_bytes(8, "big") for i in range(n)]  # meets no word
            yield batch(np.arange(row, row + n), pa.array(own, pa.binary()), np.zeros(n, np.int32), pa.StructArray.from_arrays(columns, fields=list(doc_type)))
            rare = symbols == 0
            pairs, counts = np.unique(doc[rare] * len(text.words) + text.of[rare], return_counts=True)
            doc, word = np.divmod(pairs, len(text.words) or 1)
            some, word = np.unique(word, return_inverse=True)
            keys = pa.array([key(text.words[i]) for i in some.tolist()], pa.binary())
            yield batch(row + doc, keys.take(pa.array(word)), counts.astype(np.int32), pa.nulls(len(doc), doc_type))
            row += n
        give_back()

    def batch(rows, keys, counts, docs_):
        return pa.RecordBatch.from_arrays([pa.array(rows), keys, pa.array(counts), docs_], ["row", "key", "n", "doc"])

    doc_type = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("seen", pa.int64()), ("base", pa.float64()), ("n_bytes", pa.int64()), ("model", pa.float64())])
    schema = "row long, key binary, n int, doc struct<doc_id:long, n_tokens:long, seen:long, base:double, n_bytes:long, model:double>"
    looked = bounded_batches(docs.select("doc_id", "text"), size="8m").mapInArrow(look_up, schema).join(rares, "key", "left")
    whole = F.col("doc").isNotNull()
    out = looked.groupBy("row").agg(
        F.max("doc.doc_id").alias("doc_id"), F.max("doc.n_tokens").alias("n_tokens"), F.max("doc.n_bytes").alias("n_bytes"),
        F.sum(F.when(whole, F.col("doc.seen")).otherwise(F.when(F.col("known"), F.col("n")).otherwise(0))).alias("n_known"),
        F.sum(F.when(whole, F.col("doc.base")).otherwise(F.col("n") * F.col("base"))).alias("base_score"),
        F.sum(F.when(whole, F.col("doc.model")).otherwise(F.col("n") * F.col("model"))).alias("score"),
    )
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all rows of ``documents``, learning from those that aren't held out; see ``score`` for nulls,
    empty tables and repeats. Rows without an id are learned from."""
    docs = require(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = score(docs.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("learn")))
    bits = -F.col("score") * math.log2(10)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"))
