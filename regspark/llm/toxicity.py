"""Toxicity behind a noisy channel.

Writers hide words by leetspeak, spacing and repetition. Odd tokens become lattices of the letters they may
stand for, where a mark or single space may be nothing or a word break; the Viterbi path under a character
trigram model restores and segments them, and the restored text is scored. Features are hashed words, word
beginnings and byte n-grams inside words, so that words of unspaced scripts are seen too. Features that labelled
toxic texts hold more often than clean ones go into a logistic regression with a ridge, whose weights aren't
negative: what merely comes along in copies of one toxic text shares a small weight, and a word that stands in
many of them gets a large one, whether or not it comes with others.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.common import bounded_batches, require, table

NAME = "op9_toxicity"
ORACLE_SQL = None  # a trained model: tests measure held-out accuracy
THRESHOLD = 0.3
BITS, HEADS, INNER = 20, (4, 5, 6), (5, 6)
#: Labelled texts the character model is fitted on at most (a documented bound).
MODEL_TEXTS = 3000
#: Labelled rows of each class that the classifier is fitted on at most (a documented bound).
CLASS_ROWS = 30_000
#: Grams of the character model that are kept.
GRAMS = 60_000
#: The ridge, and steps of the regression.
RIDGE, ROUNDS = 0.5, 400
#: Toxic texts that hold a feature at least, and standard errors by which its log odds exceed one.
LEAST, SURE = 4, 1.8
#: Letters that a sign may stand for (fixed values of the channel).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l"}
GAPS = ".-_*~^'`·,:;/\\#%&=()[]{}<>\"?"
HEAD_TRIM, TAIL_TRIM = "([{\"'«*&#%<>-_.,:;/=", ".,;:!?)]}\"'%*&#»<>-_/="
_RUN = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
_WORDS = re.compile(r"[^\W\d_]+")
_START, _ESCAPE_COST = "\x02", -9.0
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)


@dataclass
class CharModel:
    """Trigram log probabilities, backed off to bigrams and single letters by fixed weights."""

    counts: dict[str, float]

    def step(self, two: str, c: str) -> float:
        got = self.counts.get(two + c)
        if got is not None:
            return got
        got = self.counts.get(two[1] + c)
        if got is not None:
            return got - 1.5
        return self.counts.get(c, _ESCAPE_COST) - 3.0

    @classmethod
    def of(cls, counted: list[tuple[str, int]]) -> CharModel:
        total = {}
        for gram, n in counted:
            total[gram[:-1]] = total.get(gram[:-1], 0) + n
        return cls({g: math.log(n / total[g[:-1]]) for g, n in counted})


def lattice(token: str):
    """For each run of one sign: its ways to be read, each a string and a cost."""
    at = 0
    while at < len(token):
        c, end = token[at], at + 1
        while end < len(token) and token[end] == c:
            end += 1
        n, at = end - at, end
        if c in LEET:
            yield [(x * m, -0.5 - 0.4 * (n - m)) for x in LEET[c] for m in ((1,) if n == 1 else (1, 2))] + ([("", -4.0)] if c in "!|+" else [])
        elif c in GAPS:
            yield [("", -0.7), (" ", -0.7)]
        elif c == " ":
            yield [("", 0.0), (" ", 0.0)]
        elif n <= 2:
            yield [(c * n, 0.0)] + ([(c, -1.5)] if n == 2 else [])
        else:
            yield [(c, -0.6), (c * 2, -0.6)]


def restore(token: str, model: CharModel) -> str:
    """The likeliest words behind a token; at most one path for each pair of last letters is kept, and one for a
    word break, after which a word starts anew."""
    paths = {_START * 2: (0.0, None)}
    for ways in lattice(token):
        new: dict[str, tuple[float, tuple | None]] = {}
        for two, (score, tail) in paths.items():
            for said, cost in ways:
                s, last, t = score + cost, two, tail
                for c in said:
                    if c != " ":
                        s += model.step(last, c)
                        last, t = last[1] + c, (c, t)
                    elif last != _START * 2:
                        s += model.step(last, c)
                        last, t = _START * 2, (c, t)
                if last not in new or s > new[last][0]:
                    new[last] = s, t
        paths = new
    _, tail = max(paths.items(), key=lambda x: x[1][0] + (0.0 if x[0] == _START * 2 else model.step(x[0], " ")))[1]
    out = []
    while tail is not None:
        out.append(tail[0])
        tail = tail[1]
    return "".join(reversed(out)).strip()


class Restorer:
    """Restores texts; remembers tokens up to a bound."""

    KEEP = 200_000

    def __init__(self, model: CharModel):
        self.model, self.known = model, {}

    def token(self, token: str, repeats: bool) -> str:
        core = token.rstrip(TAIL_TRIM).lstrip(HEAD_TRIM)
        if not core or not _WORDS.search(core) and not (3 <= len(core) <= 12 and any(c in "@$!|" for c in core)):
            return token
        if core.isalpha() and not (repeats and _RUN.search(core)):
            return core
        return restore(core, self.model)

    def text(self, text: str | None) -> str:
        tokens = (text or "").lower().split()
        repeats = bool(_RUN.search(text or ""))
        if len(self.known) > self.KEEP:
            self.known.clear()
        swap = {}
        for t in set(tokens):
            if repeats or not t.isalpha():
                got = self.known.get(t)
                if got is None:
                    got = self.known[t] = self.token(t, True)
                swap[t] = got
        joined = " ".join([swap.get(t, t) for t in tokens])
        return _SPACED.sub(lambda m: restore(m[0], self.model), joined)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of hashed features and the text of each: every word, its first 4, 5 and 6 bytes, and all 5 and 6
    bytes inside it (the same features as its first ones)."""
    data = [t.encode("utf-8", "replace") for t in texts]
    b = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
    gap = b == 32
    start, stop = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    ends = np.cumsum([len(d) + 1 for d in data])
    owner = np.searchsorted(ends, start - 1, "right")
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(b), _M, np.uint64)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(b), _INVERSE, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:-1])])

    def hashed(begin, end, salt):
        h = (total[end] - total[begin]) * back[begin]  # of the bytes alone, wherever they stand
        h = (h ^ h >> np.uint64(32)) * np.uint64(salt)
        return (h ^ h >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)

    slots, of = [hashed(start, stop, 0xA0761D6478BD642F)], [owner]
    size = stop - start
    for n in HEADS:
        salt = 0x9E3779B97F4A7C15 + 2 * n
        begin, whose = start[size >= n], owner[size >= n]
        slots.append(hashed(begin, begin + n, salt))
        of.append(whose)
        if n in INNER:
            more = size[size >= n] - n  # places after the first
            begin = np.repeat(begin + 1, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            slots.append(hashed(begin, begin + n, salt))
            of.append(np.repeat(whose, more))
    return (np.concatenate(slots) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(of)


def evidence(slots: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """The sum of each text's feature weights; a feature counts once."""
    strong = np.flatnonzero(weights[slots] > 0)
    key = np.unique(owner[strong] << BITS | slots[strong])
    return np.bincount(key >> BITS, weights=weights[key & ((1 << BITS) - 1)], minlength=n).astype(np.float64)


@dataclass
class Model:
    chars: CharModel
    weights: np.ndarray
    offset: float


def char_model(texts: DataFrame) -> CharModel:
    """The most frequent letter trigrams, bigrams and single letters of texts; others cost an escape."""

    def run(batches):
        seen: dict[str, int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                for w in _WORDS.findall((text or "").lower()):
                    w = _START * 2 + w + " "
                    for i in range(2, len(w)):
                        for g in (w[i - 2 : i + 1], w[i - 1 : i + 1], w[i]):
                            seen[g] = seen.get(g, 0) + 1
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])
                seen = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])

    counted = bounded_batches(texts).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    best = counted.orderBy(F.desc("n"), "gram").limit(GRAMS).collect()
    return CharModel.of([(r["gram"], r["n"]) for r in best])


def fit(labelled: DataFrame) -> Model:
    """Fits on rows (text, toxic 0 or 1), CLASS_ROWS of each class at most; rows without a label are left out.
    Null texts are empty. Without rows, or with one class only, every text gets the same score."""
    rows = labelled.filter(F.col("toxic").isin(0, 1)).select(F.col("text"), F.col("toxic").cast("int").alias("toxic"))
    spark = labelled.sparkSession
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    few = rows.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(MODEL_TEXTS)  # hashes move, not texts
    chars = char_model(rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(few), "h").dropDuplicates(["h"]).select("text"))
    sent = spark.sparkContext.broadcast(chars)

    def count(batches):
        seen = np.zeros((2, 1 << BITS), np.int64)
        restorer = Restorer(sent.value)
        for b in batches:
            labels = np.array(b.column(1).to_pylist(), np.int64)
            slots, owner = features([restorer.text(t) for t in b.column(0).to_pylist()])
            key = np.unique(owner << BITS | slots)
            for label in (0, 1):
                seen[label] += np.bincount((key & ((1 << BITS) - 1))[labels[key >> BITS] == label], minlength=1 << BITS)
        slot = np.flatnonzero(seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(seen[0, slot]), pa.array(seen[1, slot])], ["slot", "clean", "toxic"])
        slot = np.flatnonzero((seen[1] == 0) & (seen[0] > 0))
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(seen[0, slot]), pa.array(seen[1, slot])], ["slot", "clean", "toxic"])

    counted = bounded_batches(rows).mapInArrow(count, "slot int, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    odds = F.log((F.col("t") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(clean + 1.0))
    bound = odds - SURE * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    found = counted.filter((F.col("t") >= LEAST) & (bound > 1)).select("slot").toArrow()  # 2^BITS rows at most
    candidates = np.sort(found.column(0).to_numpy())
    place = np.zeros(1 << BITS, np.int32)
    place[candidates] = np.arange(1, len(candidates) + 1)
    known = spark.sparkContext.broadcast(place)

    def lists(batches):
        restorer, place = Restorer(sent.value), known.value
        for b in batches:
            slots, owner = features([restorer.text(t) for t in b.column(0).to_pylist()])
            held = place[slots] > 0
            key = np.unique(owner[held] << BITS | place[slots[held]] - 1)
            cut = np.searchsorted(key >> BITS, np.arange(1, len(b)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x.astype(np.int32).tobytes() for x in np.split(key & ((1 << BITS) - 1), cut)], pa.binary())], ["toxic", "slots"])

    got = bounded_batches(rows).mapInArrow(lists, "toxic int, slots binary")
    got = got.groupBy("toxic", "slots").count().toArrow()  # twice CLASS_ROWS lists of candidates at most
    order = sorted(range(got.num_rows), key=lambda i: (got.column(0)[i].as_py(), got.column(1)[i].as_py()))
    got = got.take(pa.array(order, pa.int64()))
    held = [np.frombuffer(x, np.int32) for x in got.column(1).to_pylist()]
    weights, offset = _regression(held, got.column(0).to_numpy().astype(float), got.column(2).to_numpy().astype(float), len(candidates))
    out = np.zeros(1 << BITS, np.float32)
    out[candidates] = weights
    return Model(chars, out, offset)


def _regression(held: list[np.ndarray], label: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights of the n features, none of them negative, and the offset: accelerated proximal steps on the
    logistic loss with a ridge. held: each text's features; times: how often it comes."""
    feature = np.concatenate([*held, np.zeros(0, np.int32)]).astype(np.int64)
    text = np.repeat(np.arange(len(held)), [len(x) for x in held])
    if not len(label):
        return np.zeros(n), -3.0
    # a feature's own curvature, and its texts' sizes, bound the steps of each weight
    size = np.bincount(text, minlength=len(held)) + 1.0
    steep = 0.25 * np.bincount(feature, (times * size)[text], n) + RIDGE
    steep_offset = 0.25 * (times * size).sum() + 1e-3
    share = (times * label).sum() / times.sum()
    w, offset = np.zeros(n), math.log((share + 1e-3) / (1 - share + 1e-3))
    w_next, o_next, t = w, offset, 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(text, w_next[feature], len(held)) + o_next, -40, 40)))
        error = times * (label - p)
        w_new = np.maximum(w_next + (np.bincount(feature, error[text], n) - RIDGE * w_next) / steep, 0)
        o_new = o_next + error.sum() / steep_offset
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w_next, o_next = w_new + (t - 1) / t_new * (w_new - w), o_new + (t - 1) / t_new * (o_new - offset)
        w, offset, t = w_new, o_new, t_new
    return w, float(offset)


def _evidence(rows: DataFrame, kept: str, chars: CharModel, weights: np.ndarray) -> DataFrame:
    """rows: the text first, then the one column that is kept, as ``kept`` names it."""
    sent = rows.sparkSession.sparkContext.broadcast((chars, weights))
    name = kept.split()[0]

    def run(batches):
        chars, weights = sent.value
        restorer = Restorer(chars)
        for b in batches:
            slots, owner = features([restorer.text(t) for t in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(evidence(slots, owner, len(b), weights))], [name, "evidence"])

    return bounded_batches(rows, 512).mapInArrow(run, f"{kept}, evidence double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; a null or empty text has no evidence. Whole texts are read; rows are
    independent of each other."""
    found = _evidence(require(docs, "text", "doc_id"), "doc_id long", model.chars, model.weights)
    x = F.least(F.greatest(F.col("evidence") + model.offset, F.lit(-40.0)), F.lit(40.0))
    return found.select("doc_id", (1 / (1 + F.exp(-x))).alias("score"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chosen_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): of each class the CLASS_ROWS rows with the smallest hashes of their ids. Of several
    labels of a document the larger one holds; null ids and labels are left out."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [one.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CLASS_ROWS) for k in (0, 1)]
    return picked[0].unionByName(picked[1])


def prior_shift(labels: DataFrame, chosen: DataFrame) -> float:
    """What the classes' unequal shares of the choice change in the log odds."""
    n, m = ({r["toxic"]: r["count"] for r in d.groupBy("toxic").count().collect()} for d in (labels.filter(F.col("toxic").isin(0, 1)), chosen))
    return math.log(max(n.get(1, 0), 1) / max(n.get(0, 0), 1)) - math.log(max(m.get(1, 0), 1) / max(m.get(0, 0), 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all rows of ``documents`` by what labelled rows that aren't held out teach. Null and empty texts
    get the score of a text without evidence; repeated rows are scored each; without labels all scores are equal."""
    docs = require(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = require(table(spark, sf_dir, "labels"), "doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    chosen = chosen_labels(labels)
    model = fit(docs.join(F.broadcast(chosen), "doc_id"))  # twice CLASS_ROWS ids; texts stay where they are
    model.offset += prior_shift(labels, chosen)
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
