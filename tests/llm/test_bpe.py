import random

from tokenizers import Tokenizer

from regspark.llm import bpe
from tests_data import texts


def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def same(rows):
    own = bpe.load(bpe.vocabulary_path())
    lib = library()
    for text, (ids, toks), want in zip(rows, own.encode_batch(rows), lib.encode_batch(rows, add_special_tokens=False), strict=True):
        assert [int(i) for p in ids for i in p.split()] == want.ids, ascii(text[:80])
        assert " ".join(toks) == lib.decode(want.ids, skip_special_tokens=False)


def test_documents_equal_the_library():
    same(texts("sf0.001"))


def test_random_words_equal_the_library():
    rng = random.Random(3)
    same(["".join(rng.choice("aaabbcdeehhilnnorsttuw'éß1. ") for _ in range(rng.randint(0, 60))) for _ in range(5000)])


def test_odd_texts():
    same(["", " ", "a" * 5000, "́á", "İΣς", "<|endoftext|>x<|startoftext|>", "<|endoftext", "'s 'LL don't", "\x1c\x1da", "  x", "數據🙂🙂", "࢏՘", "1234½²", "ſK", "힣가"])


def test_all_guesses_are_verified():
    own = bpe.load(bpe.vocabulary_path())
    words = sorted({w for t in texts("sf0.001") for w in own.words(t)})
    exact = [own.merge_long(w.encode()) for w in words]
    assert own.encode_words(words) == exact


def test_edge_rows(odd, none, clashing):
    got = {r.doc_id: r for r in bpe.digests(odd).collect()}
    assert got[2].n_tokens == 0 and got[3].n_tokens == 0 and got[7].n_tokens == 30_000
    assert bpe.digests(none).count() == 0
    out = bpe.decode(bpe.encode(clashing.filter("doc_id = 1"))).first()
    assert out.decoded.startswith("the</w> quick</w>") and len(out.token_ids) == 15
