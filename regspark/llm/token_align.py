"""Cross-tokenizer alignment by as-of joins of token starts.

Two tokenizers cut the same bytes. In each batch of documents the tokens of either side stand on one line of
byte positions, document after document, so that a position is a key of document and offset. A backward
``merge_asof`` finds for every token start the token of the other side that covers it; both directions together
give every overlapping pair, and positions where tokens of both sides end cut the document into groups.

Tokens can't cross a single blank between two other signs, on either side. So texts are cut there into units,
a batch's different units are encoded once, and their tokens remembered in a bounded memo.

Corpus-wide counts of linked ids need a second look at every link. A batch therefore leaves its documents' links
as numbers into its own table of id pairs: only these tables are exploded, summed and joined with the totals, and
the totals come back to the batch as one array.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.bpe import byte_letters
from regspark.llm.common import bounded_batches, require, stored, table

NAME = "op11_tokenizer_alignment"
ORACLE_SQL = None  # SQL has no tokenizer: tests compare with whole texts encoded by the libraries
#: Units, and tokens of them, that a worker remembers at most before it starts anew.
MEMO_UNITS, MEMO_TOKENS = 300_000, 4_000_000
#: Units encoded in one call.
TOGETHER = 4096
#: Bytes of text to a batch, about; a longer text is alone.
BATCH = "4m"
#: A blank next to another blank sign or at an end: such texts are cut by UNIT instead of at every blank.
_ODD_BLANK = r"(^|[\s\x0b\x1c-\x1f\x85\p{Z}]) | ([\s\x0b\x1c-\x1f\x85\p{Z}]|$)"
_UNIT = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """Tokens' bytes, their lengths, and the remembered units' ids, of one tokenizer."""

    def __init__(self, spelled: list[bytes], encode, cut: str):
        self.spelled, self.encode = spelled, encode
        self.size = np.array([len(s) for s in spelled])
        #: A token's decimal id as it stands inside a group, and at its end: fixed width, filled up with NUL.
        self.text = np.array([f"{i}{c}".encode() for i in range(len(spelled)) for c in "," + cut])
        self.forget()

    def forget(self) -> None:
        self.ids, self.used, self.first, self.count = np.zeros(1 << 16, np.uint16), 0, [], []

    def add(self, ids: np.ndarray, counts) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        counts = np.asarray(counts)
        self.first += (self.used + np.cumsum(counts) - counts).tolist()
        self.count += counts.tolist()
        self.used += len(ids)

    def joined(self, ids) -> bytes:
        return b"".join([self.spelled[i] for i in ids])


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True  # their strings are plain text
        a.no_truncation()
        a.no_padding()
        code = {c: i for i, c in enumerate(byte_letters())}
        a_spelled = [bytes(code[c] for c in a.id_to_token(i)) for i in range(a.get_vocab_size())]
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        b_spelled = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a = Side(a_spelled, lambda t: a.encode(" " + t, add_special_tokens=False).ids, "|")
        self.b = Side(b_spelled, lambda t: b.encode(t, num_threads=1), ";")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.sound: list[bool] = []
        self.a.forget()
        self.b.forget()

    # -- units ---------------------------------------------------------------------------------
    def learn(self, units: list[str]) -> None:
        joint, alone = [], []
        for u in units:
            plain = u and not u[0].isspace() and not u[-1].isspace() and "▁" not in u
            (joint if plain else alone).append(u)
        for i in range(0, len(joint), TOGETHER):
            part = joint[i : i + TOGETHER]
            if not self.learn_joint(part):
                alone += part
        for u in alone:
            data = b" " + u.encode()
            a, b = self.a.encode(u), self.b.encode(u)
            self.note([u], [self.a.joined(a) == data == self.b.joined(b)])
            self.a.add(np.array(a, np.uint16), [len(a)])
            self.b.add(np.array(b, np.uint16), [len(b)])

    def learn_joint(self, units: list[str]) -> bool:
        """Encodes units as one text; False if that doesn't give tokens that end where units end."""
        text = " ".join(units)
        edges = np.cumsum([len(u.encode()) + 1 for u in units])
        found = []
        for side in (self.a, self.b):
            ids = side.encode(text)
            if side.joined(ids) != b" " + text.encode():
                return False
            ids = np.array(ids, np.uint16)
            ends = np.cumsum(side.size[ids])
            stop = np.searchsorted(ends, edges)
            if (ends[stop] != edges).any():
                return False
            found.append((side, ids, np.diff(stop + 1, prepend=0)))
        self.note(units, [True] * len(units))
        for side, ids, counts in found:
            side.add(ids, counts)
        return True

    def note(self, units: list[str], sound: list[bool]) -> None:
        self.index.update(zip(units, range(len(self.sound), len(self.sound) + len(units)), strict=True))
        self.sound += sound

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the texts, units of each in that order, and all units' memo places."""
        odd = pc.match_substring_regex(texts, _ODD_BLANK).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        cut = [_UNIT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        counts = np.concatenate([pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(c) for c in cut], np.int64)])
        flat = pa.concat_arrays([plain.flatten().cast(pa.large_string()), pa.array([u for c in cut for u in c], pa.large_string())])
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.index) > MEMO_UNITS or self.a.used + self.b.used > MEMO_TOKENS:
            self.forget()
        self.learn([w for w in words if w not in self.index])
        place = np.array([self.index[w] for w in words], np.int64)
        return order, counts, place[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)

    # -- documents -----------------------------------------------------------------------------
    def align(self, texts: pa.Array) -> dict:
        """Per text, in arrays: n_a, n_b, n_groups, n_links, groups_sha256; and its different linked pairs as
        numbers into ``pairs`` (a * 65536 + b), with how often each occurs in the text."""
        import pandas as pd

        n = len(texts)
        kept = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        order, counts, unit = self.units(texts.take(pa.array(kept)))
        doc = kept[order]
        of_unit = np.repeat(np.arange(len(doc)), counts)
        # texts of which either side's tokens don't give the bytes back have no tokens
        doubt = np.unique(of_unit[~np.array(self.sound, bool)[unit]]) if len(unit) else np.zeros(0, np.int64)
        bad = [d for d in doubt if not self.whole(unit[of_unit == d], texts[int(doc[d])].as_py())]
        if bad:
            use = ~np.isin(of_unit, bad)
            unit, of_unit = unit[use], of_unit[use]
        ids, start, end, owner = [], [], [], []
        for side in (self.a, self.b):
            count = np.array(side.count, np.int64)[unit] if len(unit) else np.zeros(0, np.int64)
            first = np.array(side.first, np.int64)[unit] if len(unit) else np.zeros(0, np.int64)
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            own = side.ids[at].astype(np.int64)
            stop = np.cumsum(side.size[own])
            ids.append(own)
            end.append(stop)
            start.append(stop - side.size[own])
            owner.append(doc[np.repeat(of_unit, count)])
        a, b = (pd.DataFrame({"at": s, "token": np.arange(len(s))}) for s in start)
        covering_b = pd.merge_asof(a, b, on="at", suffixes=("_a", "_b"))
        covering_a = pd.merge_asof(b, a, on="at", suffixes=("_b", "_a"))
        both = np.concatenate([covering_b[["token_a", "token_b"]].to_numpy(), covering_a[["token_a", "token_b"]].to_numpy()])
        fresh = np.ones(len(both), bool)
        fresh[len(a) :] = start[0][both[len(a) :, 0]] != start[1][both[len(a) :, 1]]  # else found in both directions
        link_a, link_b = both[fresh].T
        total = int(end[0][-1]) if len(end[0]) else 0
        mark = np.zeros((2, total + 1), bool)
        mark[0, end[0]], mark[1, end[1]] = True, True
        last = [mark[1, end[0]], mark[0, end[1]]]
        code, pairs = pd.factorize(ids[0][link_a] * 65536 + ids[1][link_b])
        key, which = pd.factorize(owner[0][link_a] * max(1, len(pairs)) + code)[::-1]
        times = np.bincount(which, minlength=len(key))
        by_doc = np.argsort(key)
        held, number = np.divmod(key[by_doc], max(1, len(pairs)))
        return {
            "n_a": np.bincount(owner[0], minlength=n), "n_b": np.bincount(owner[1], minlength=n),
            "n_groups": np.bincount(owner[0][last[0]], minlength=n), "n_links": np.bincount(owner[0][link_a], minlength=n),
            "groups_sha256": self.digests(n, ids, owner, last),
            "pairs": pairs, "pair_links": np.bincount(code, minlength=len(pairs)),
            "cut": np.concatenate([[0], np.cumsum(np.bincount(held, minlength=n))]), "number": number, "times": times[by_doc],
        }

    def whole(self, units: np.ndarray, text: str) -> bool:
        data = b" " + text.encode()
        return all(b"".join(s.joined(s.ids[s.first[u] : s.first[u] + s.count[u]]) for u in units) == data for s in (self.a, self.b))

    def digests(self, n: int, ids, owner, last) -> list[str]:
        """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        group = [np.cumsum(x) - x for x in last]
        groups = int(last[0].sum())
        before = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=groups))]) for g in group]
        size = len(ids[0]) + len(ids[1])
        texts, docs = np.zeros(size, "S6"), np.zeros(size, np.int64)
        for k, (side, shift) in enumerate(((self.a, 0), (self.b, 1))):
            at = np.arange(len(ids[k])) + before[1 - k][group[k] + shift]
            texts[at], docs[at] = side.text[2 * ids[k] + last[k]], owner[k]
        data = texts.tobytes().translate(None, b"\0")
        edge = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if size else np.zeros(0, np.int64)
        stop = np.cumsum(np.add.reduceat(np.char.str_len(texts), edge)).tolist() if size else []
        out = [""] * n
        for d, lo, hi in zip(docs[edge].tolist(), [0, *stop], stop, strict=False):
            out[d] = hashlib.sha256(data[lo : hi - 1]).hexdigest()
        return out


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned_blocks(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """A row per document, in blocks (batches of texts): its counts, its digest, its different linked pairs
    (``number``, ``times``); the block's first row holds the pairs that numbers stand for (``pairs``) and how
    often each is linked in the block."""
    a_path, b_path = paths or vocabulary_paths()

    def run(batches):
        aligner, part = load(a_path, b_path), TaskContext.get().partitionId()
        for turn, batch in enumerate(batches):
            found = aligner.align(pc.fill_null(batch.column(1), ""))
            n = batch.num_rows
            lists = lambda cut, values, kind: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, kind))
            head = [0, *[len(found["pairs"])] * n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, (part << 32) + turn), pa.int64()), batch.column(0), *[pa.array(found[c], pa.int64()) for c in _COUNTS], pa.array(found["groups_sha256"], pa.string()),
                    lists(found["cut"], found["number"], pa.int32()), lists(found["cut"], found["times"], pa.int32()),
                    lists(head, found["pairs"], pa.int64()), lists(head, found["pair_links"], pa.int32()),
                ],
                ["block", "doc_id", *_COUNTS, "groups_sha256", "number", "times", "pairs", "pair_links"],
            )

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    schema = f"block long, doc_id long, {counts}, groups_sha256 string, number array<int>, times array<int>, pairs array<long>, pair_links array<int>"
    rows = require(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return bounded_batches(rows, 4096, BATCH).mapInArrow(run, schema)


def _score(blocks: pa.Table, totals: pa.Table) -> pa.Table:
    """One block's documents with n_best and count_sum; totals holds one row, or none if nothing is linked."""
    number, times = (pc.fill_null(blocks.column(c).combine_chunks(), []) for c in ("number", "times"))
    size = pc.list_value_length(number).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(size)), size)
    at, k = number.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    best, total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    if totals.num_rows:
        row = totals.column("totals").combine_chunks().flatten()
        links, top = row.field("links").to_numpy(), row.field("top").to_numpy(zero_copy_only=False)
        np.add.at(best, doc, k * top[at])
        np.add.at(total, doc, k * links[at])
    keep = blocks.select(["doc_id", *_COUNTS])
    return keep.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total)).append_column("groups_sha256", blocks.column("groups_sha256"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``. Null and
    empty texts, and texts whose tokens don't give the bytes back on both sides, have no tokens: zeros and an
    empty digest. Each row counts, repeated ones too; other columns are ignored; an empty table gives an empty
    result. A text longer than a batch is aligned alone and needs memory of some fifty times its bytes."""
    blocks = stored(aligned_blocks(docs, paths), "align-blocks")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "pair_links")).alias("pos", "p")).select("block", "pos", "p.pairs", "p.pair_links")
    counts = stored(pairs.groupBy("pairs").agg(F.sum("pair_links").alias("links")), "align-counts")
    # at most a row for each id of the second vocabulary, of 65,536 at most
    best = counts.groupBy(F.col("pairs").bitwiseAND(65535).alias("b")).agg(F.max("links").alias("most"))
    marked = counts.withColumn("b", F.col("pairs").bitwiseAND(65535)).join(F.broadcast(best), "b").select("pairs", "links", (F.col("links") == F.col("most")).alias("top"))
    back = pairs.join(marked, "pairs").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "links", "top"))).alias("totals"))
    own = blocks.drop("pairs", "pair_links").withColumnRenamed("block", "place")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("place").cogroup(back.groupBy("block")).applyInArrow(_score, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
