"""Cross-tokenizer alignment against whole texts encoded by the libraries and aligned byte by byte."""

import hashlib
import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

from regspark.llm import token_align as T
from regspark.llm.bpe import byte_letters
from tests.llm.tests_data import rows


@pytest.fixture(scope="module")
def tools():
    import sentencepiece

    a_path, b_path = T.vocabulary_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


def tokens(tools, text):
    a, b = tools
    if not text:
        return [], []
    code = {c: i for i, c in enumerate(byte_letters())}
    left = [(i, bytes(code[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    if b"".join(s for _, s in left) != want or b"".join(s for _, s in right) != want:
        return [], []
    return left, right


def brute(tools, docs):
    per, count = [], Counter()
    for d, text in docs:
        left, right = tokens(tools, text)
        of = [[i for i, (_, s) in enumerate(side) for _ in s] for side in (left, right)]
        links = {(x, y) for x, y in zip(*of, strict=True)}
        ids = [(left[x][0], right[y][0]) for x, y in links]
        count.update(ids)
        ends = []
        for side in (left, right):
            at, out = 0, []
            for _, s in side:
                at += len(s)
                out.append(at)
            ends.append(out)
        shared, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for e in shared:
            x, y = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(",".join(str(t) for t, _ in left[i:x]) + "|" + ",".join(str(t) for t, _ in right[j:y]))
            i, j = x, y
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        per.append((d, len(left), len(right), len(groups), ids, digest))
    best = {}
    for (_, y), c in count.items():
        best[y] = max(c, best.get(y, 0))
    return sorted(((d, n, m, g, len(ids), sum(count[p] == best[p[1]] for p in ids), sum(count[p] for p in ids), s) for d, n, m, g, ids, s in per), key=str)


def got(df):
    return sorted((tuple(r) for r in T.align(df).collect()), key=str)


def test_given_documents_equal_brute_force(spark, tools):
    assert got(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")) == brute(tools, rows("sf0.001", "documents", "doc_id, text"))


def test_odd_rows(spark, tools, odd, none, clashing):
    docs = [(r.doc_id, r.text) for r in odd.filter("doc_id is null or doc_id <> 8").collect()]
    assert got(odd.filter("doc_id is null or doc_id <> 8")) == brute(tools, docs) and got(none) == []
    assert [r[:5] for r in got(clashing)] == [r[:5] for r in got(odd)]


def test_blanks_marks_and_rare_signs(spark, tools, monkeypatch):
    rng = random.Random(3)
    parts = ["the", "The", "ion", "don't", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "▁a", "数据", "🙂", "é", "é", "123", "4,5", "\u0000", "﻿", "x" * 40]
    blanks = [" ", " ", " ", "  ", "   ", "\n", " \n", "\n ", "\t", " ", "  ", "　 ", "\x1c ", "\x85", "​", "", "\r\n\r\n"]
    docs = [(i, "".join(rng.choice(parts) + rng.choice(blanks) for _ in range(rng.randint(1, 12)))) for i in range(300)]
    docs += [(900 + i, b + "word" + c) for i, (b, c) in enumerate((b, c) for b in blanks for c in blanks)]
    docs += [(2000, " "), (2001, "  "), (2002, "\n"), (2003, "▁"), (2004, "a ▁ b"), (2005, " ▁a")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(tools, docs)
    assert got(df) == want
    assert sum(r[1] == 0 for r in want) > 10  # texts with a literal mark don't give their bytes back


def test_memo_starts_anew(spark):
    monkey = pytest.MonkeyPatch()
    texts = [f"word{i % 50} other{i % 7} thing{i}" for i in range(400)]
    import pyarrow as pa

    full = T.Aligner(*T.vocabulary_paths())
    want = full.align(pa.array(texts))
    monkey.setattr(T, "MEMO_UNITS", 20)
    small = T.Aligner(*T.vocabulary_paths())
    parts = [small.align(pa.array(texts[i : i + 40])) for i in range(0, 400, 40)]
    monkey.undo()
    assert sum((p["groups_sha256"] for p in parts), []) == want["groups_sha256"]
