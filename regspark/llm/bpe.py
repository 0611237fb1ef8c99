"""BPE encoding and decoding by speculating and verifying.

A word's tokens are first guessed by greedy longest match. A sequence of tokens is what merging gives
exactly if every adjacent pair is *compatible*: encoding the two tokens' joined text gives the two tokens
back. That is tested for all pairs of a batch at once, by walking the two tokens' merge histories back in
NumPy; only words with a failing pair are merged exactly. Distinct words of a batch are encoded once and
remembered in a cache of bounded size. Each document is encoded alone, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.common import bounded_batches, require, table

NAME = "op1_bpe_encoding"
ORACLE_SQL = None  # SQL has no tokenizer: the tests hold every document against the library
#: Pieces of text whose tokens a Python worker remembers (about 250 bytes each).
CACHE_PIECES = 400_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


NONE = np.iinfo(np.int32).max


class Lookup:
    """Non-negative int64 keys to int32 values for whole arrays: open addressing, half empty."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        slot = self.slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], NONE)
        rows = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(rows):
            slot[rows] = (slot[rows] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[rows]]
            hit = seen == keys[rows]
            out[rows[hit]] = self.values[slot[rows[hit]]]
            rows = rows[~hit & (seen >= 0)]
        return out


class WordBpe:
    """A BPE with word ends, as a tokenizer file describes it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = dict(map(reversed, (self.ids | self.special).items()))
        size = max(self.tokens) + 1
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = self.ids[a], self.ids[b], self.ids[a.removesuffix(self.end) + b]
            self.merges[a, b] = rank, made
            self.left[made], self.right[made], self.rank[made] = a, b, rank
            keys.append(a * size + b)
            ranks.append(rank)
        self.size = size
        self.pairs = Lookup(np.array(keys), np.array(ranks))
        self.made_by = np.array([made for _, made in self.merges.values()], np.int32)
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        letters = byte_letters()
        code = self.code = {c: b for b, c in enumerate(letters)}
        #: Ids of one byte inside a word and at its end.
        self.inner = np.array([self.ids[c] for c in letters], np.int32)
        self.final = np.array([self.ids[c + self.end] for c in letters], np.int32)
        keys = [self.key(bytes(code[c] for c in t.removesuffix(self.end)), t.endswith(self.end)) for t in self.ids]
        self.spelled = Lookup(np.array(keys), np.fromiter(self.ids.values(), np.int32))
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.beyond = re.compile(r"[^\x00-\u012f\u0131-\u017f]")
        latin = [chr(c) for c in range(0x180)]
        letter, digit = ("".join(c for c in latin if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}"))
        self.latin_cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^\t-\r \x85\xa0{letter}{digit}]+")
        from tokenizers import Tokenizer

        file = Tokenizer.from_file(path)  # only its Unicode tables are used, for texts beyond Latin letters
        self.normalizer, self.splitter = file.normalizer, file.pre_tokenizer
        self.cache: dict[str, tuple[str, str]] = {}
        self.limit = CACHE_PIECES

    # -- guess ---------------------------------------------------------------------------------
    BASE = 0x100000001B3

    @classmethod
    def key(cls, spelling: bytes, ends: bool) -> int:
        h = 0
        for b in spelling:
            h = (h * cls.BASE + b + 1) & (2**64 - 1)
        return cls.finish(np.array([h], np.uint64), np.array([ends]))[0]

    @staticmethod
    def finish(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(2)).astype(np.int64) << 1) | ends

    def greedy(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each word, the longest first at each place, by substring hashes of all words at once.
        letters: a row of bytes for each word. Returns a row of ids for each, filled up with -1."""
        n, width = letters.shape
        prefix = np.zeros((n, width + 1), np.uint64)
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * np.uint64(self.BASE) + letters[:, j] + np.uint64(1)
        power = np.array([pow(self.BASE, i, 2**64) for i in range(width + 1)], np.uint64)
        out, at, made = np.full((n, width), -1, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        span = np.minimum(sizes, self.longest)
        while len(live):
            start, stop = at[live], at[live] + span[live]
            h = prefix[live, stop] - prefix[live, start] * power[span[live]]
            got = self.spelled(self.finish(h, stop == sizes[live]))
            hit = got != NONE
            rows = live[hit]
            out[rows, made[rows]] = got[hit]
            made[rows] += 1
            at[rows] = stop[hit]
            span[rows] = np.minimum(sizes[rows] - at[rows], self.longest)
            span[live[~hit]] -= 1
            live = live[at[live] < sizes[live]]
        return out

    # -- verify --------------------------------------------------------------------------------
    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs(a.astype(np.int64) * self.size + b)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of each pair. The later made of the two tokens is taken
        apart again and again; a merge of the two parts that meet at the border, of a rank before the one
        that made the part just taken apart, would have come first."""
        ok = np.ones(len(a), bool)
        rows = np.arange(len(a))
        limit = np.full(len(a), NONE, np.int64)
        while len(rows):
            wrong = self.pair_rank(a, b) < limit
            ok[rows[wrong]] = False
            undo_a = self.rank[a] > self.rank[b]
            made = np.where(undo_a, self.rank[a], self.rank[b])
            limit = np.where(undo_a, made, made + 1)  # of equal ranks the left place comes first
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            go = ~wrong & (made >= 0)
            rows, a, b, limit = rows[go], a[go], b[go], limit[go]
        return ok

    # -- exact merging -------------------------------------------------------------------------
    def bytes_to_ids(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at = np.arange(letters.shape[1])
        ids = np.where(at == sizes[:, None] - 1, self.final[letters], self.inner[letters])
        return np.where(at < sizes[:, None], ids, -1)

    def merge_all(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merges by lowest rank, then leftmost place: one merge in every unfinished word each round."""
        out = self.bytes_to_ids(letters, sizes)
        rows, parts = np.arange(len(out)), out.copy()
        none = np.full((len(out), 1), NONE, np.int32)
        pair = lambda a, b: np.where(b >= 0, self.pair_rank(np.maximum(a, 0), np.maximum(b, 0)), NONE)
        ranks = np.concatenate([pair(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(out), -1), none], axis=1)
        at = np.arange(parts.shape[1])
        while True:
            k = ranks.argmin(axis=1)
            best = ranks[np.arange(len(k)), k]
            go = best < NONE
            out[rows[~go]] = parts[~go]
            if not go.any():
                return out
            rows, parts, ranks, k, best = rows[go], parts[go], ranks[go], k[go], best[go]
            i = np.arange(len(k))
            source = np.minimum(at + (at > k[:, None]), len(at) - 1)
            gone = at[-1]
            parts, ranks = np.take_along_axis(parts, source, 1), np.take_along_axis(ranks, source, 1)
            parts[:, gone], ranks[:, gone] = -1, NONE
            parts[i, k] = self.made_by[best]
            after = np.where(k < gone, parts[i, np.minimum(k + 1, gone)], -1)
            ranks[i, k] = pair(parts[i, k], after)
            before = np.maximum(k - 1, 0)
            ranks[i, before] = np.where(k > 0, pair(parts[i, before], parts[i, k]), ranks[i, before])

    def merge_long(self, word: bytes) -> list[int]:
        """The same for one long word, with a heap over a linked list: near-linear in its length."""
        parts = self.bytes_to_ids(np.frombuffer(word, np.uint8)[None], np.array([len(word)]))[0].tolist()
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (m := self.merges.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.merges[a, b][1], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merges.get((parts[p], parts[q]))):
                    heapq.heappush(heap, (m[0], p, parts[p], parts[q]))
        return [p for p in parts if p >= 0]

    #: Longest word, in bytes, of each group that is worked on as one matrix.
    WIDTHS = (8, 12, 16, 32)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        found: list = [None] * len(raw)
        least = 0
        for width in self.WIDTHS:
            rows = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            if len(rows):
                data = b"".join([raw[i].ljust(width, b"\0") for i in rows])
                letters = np.frombuffer(data, np.uint8).reshape(len(rows), width)
                ids = self.encode_matrix(letters, sizes[rows])
                counts = (ids >= 0).sum(axis=1).tolist()
                for i, n, got in zip(rows.tolist(), counts, ids.tolist(), strict=True):
                    found[i] = got[:n]
        for i in np.flatnonzero(sizes > least):
            found[i] = self.encode_long(raw[i])
        return found

    def encode_matrix(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ids = self.greedy(letters, sizes)
        row, col = np.nonzero(ids[:, 1:] >= 0)
        pairs, which = np.unique(ids[row, col].astype(np.int64) * self.size + ids[row, col + 1], return_inverse=True)
        bad = np.unique(row[~self.compatible(pairs // self.size, pairs % self.size)[which]])
        if len(bad):
            ids[bad] = self.merge_all(letters[bad], sizes[bad])
        return ids

    def encode_long(self, word: bytes) -> list[int]:
        letters = np.frombuffer(word, np.uint8)
        ids = self.greedy(letters[None], np.array([len(word)]))[0]
        ids = ids[ids >= 0].astype(np.int64)
        return ids.tolist() if self.compatible(ids[:-1], ids[1:]).all() else self.merge_long(word)

    # -- texts ---------------------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if not self.beyond.search(text):  # composed already, and each letter is lower-cased alone
            return self.latin_cut.findall(text.lower())
        text = self.normalizer.normalize_str(text)
        if not self.newer(text):
            return self.cut.findall(text)
        return [bytes(self.code[c] for c in w).decode() for w, _ in self.splitter.pre_tokenize_str(text)]

    def newer(self, text: str) -> bool:
        """Whether a code point's kind may differ between this process's Unicode tables and the file's
        library."""
        return any(unicodedata.category(c) == "Cn" for c in set(text))

    def pieces(self, text: str) -> list[str]:
        """Runs without white space of a lower-case text, each of which is encoded on its own. A special
        token, or a text that needs care as a whole, is one piece, marked by a leading line feed."""
        if "<|" in text:
            parts = self.marks.split(text)
            if len(parts) > 1:
                return [w for i, p in enumerate(parts) for w in (["\n" + p] if i % 2 else self.pieces(p))]
        if self.beyond.search(text) or self.odd_space.search(text):
            return ["\n " + w for w in self.words(text)]
        return text.lower().split()

    odd_space = re.compile("[\x1c-\x1f]")  # white space to Python alone

    def fill(self, new: list[str]) -> None:
        """Puts pieces into the cache."""
        words = [[w[2:]] if w.startswith("\n ") else [] if w[0] == "\n" else self.latin_cut.findall(w) for w in new]
        flat = list(dict.fromkeys(w for ws in words for w in ws))
        known = {}
        for w, got in zip(flat, self.encode_words(flat), strict=True):
            known[w] = " ".join(map(str, got)), " ".join([self.tokens[t] for t in got])
        for piece, ws in zip(new, words, strict=True):
            if len(ws) == 1:
                self.cache[piece] = known[ws[0]]
            elif ws:
                self.cache[piece] = " ".join([known[w][0] for w in ws]), " ".join([known[w][1] for w in ws])
            else:
                self.cache[piece] = str(self.special[piece[1:]]), piece[1:]

    def encode_batch(self, texts: list[str]) -> list[tuple[list[str], list[str]]]:
        """For each text, per piece: the decimal ids joined by a space, and the tokens joined by a space."""
        per_text = [self.pieces(t) for t in texts]
        if len(self.cache) > self.limit:
            self.cache.clear()
        if new := list(set().union(*per_text).difference(self.cache)):
            self.fill(new)
        at = self.cache.__getitem__
        return [tuple(zip(*map(at, ps), strict=True)) if ps else ((), ()) for ps in per_text]

    def encode(self, text: str) -> list[int]:
        ids, _ = self.encode_batch([text])[0]
        return [int(i) for part in ids for i in part.split(" ")]

    def decode(self, ids) -> str:
        """The tokens joined by spaces: the file names no decoder. Ids the vocabulary lacks give nothing."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with an ``array<int>`` column of token ids after its own columns (one of that name is
    replaced). Null or empty texts give an empty array; rows are independent, so repeated rows, very long
    texts and further columns don't matter."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def encoded(texts):
        import pandas as pd

        found = load(path).encode_batch([t or "" for t in texts])
        return pd.Series([np.array(" ".join(i).split(), dtype=np.int32) for i, _ in found])

    return bounded_batches(docs).withColumn(ids, encoded(F.col(f"`{text}`")))


def decode(tokens: DataFrame, path: str | None = None, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the decoded text; null ids give an empty text."""
    path = path or vocabulary_path()

    @F.pandas_udf("string")
    def decoded(rows):
        import pandas as pd

        bpe = load(path)
        return pd.Series([bpe.decode([] if r is None else r.tolist()) for r in rows])

    return bounded_batches(tokens).withColumn(text, decoded(F.col(f"`{ids}`")))


def digests(docs: DataFrame, path: str | None = None, pieces: int = CACHE_PIECES) -> DataFrame:
    """Encodes and decodes each text in one pass and keeps only counts and digests. The encoder hands over
    ids and their tokens word by word, so decoding reads what was encoded. A worker remembers up to ``pieces``
    pieces; with fewer than CACHE_PIECES it
    forgets them, and its tables, after each task, for jobs whose workers stay alive.
    Null and empty texts have no tokens; rows are independent; an empty table gives an empty result."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = load(path)
        bpe.limit = pieces
        for b in batches:
            n, ids, texts = [], [], []
            for found, tokens in bpe.encode_batch([t or "" for t in b.column(1).to_pylist()]):
                joined = " ".join(found)
                n.append(joined.count(" ") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(" ".join(tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if pieces < CACHE_PIECES:
            bpe.cache.clear()
            load.cache_clear()

    return bounded_batches(require(docs, "doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
