"""Language ID, toxicity and language-model scoring."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from regspark.llm import langid, lm_score, toxicity
from tests_data import rows

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_texts(spark):
    langs = dict(rows("sf0.01", "documents", "doc_id, lang"))
    found = langid.query(spark, SF).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(langs) and np.mean([langs[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_rows(spark, odd, none, clashing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[6].lang_pred == "und" and not got[2].lang_accepted
    assert langid.predict(none, model).count() == 0 and langid.predict(clashing, model).count() == clashing.count()
    assert langid.predict(odd, langid.fit(none)).filter("lang_pred <> 'und'").count() == 0


def teaching_words(spark, sf):
    """Words of restored training texts that at least four toxic ones and no clean one hold."""
    texts, labels = dict(rows(sf, "documents", "doc_id, text")), dict(rows(sf, "labels", "doc_id, toxic"))
    r = toxicity.Restorer(toxicity.char_model(spark.createDataFrame([(t,) for t in list(texts.values())[:1000]], "text string")))
    held = {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    n = {0: Counter(), 1: Counter()}
    for i, y in labels.items():
        if i not in held:
            n[y].update(set(r.text(texts[i]).split()))
    taught = {w for w, c in n[1].items() if c >= 4 and not n[0][w] and w.isalpha()}
    return r, texts, labels, held, taught


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_on_held_out_texts(spark, sf):
    r, texts, labels, held, taught = teaching_words(spark, sf)
    got = {x.doc_id: x.predicted for x in toxicity.query(spark, f"/root/testdata/{sf}").collect()}
    sure = [i for i in held if labels[i] == 1 and taught & set(r.text(texts[i]).split())]
    assert len(sure) > 5 and np.mean([got[i] for i in sure]) >= 0.95
    assert np.mean([got[i] for i in held if labels[i] == 0]) <= 0.01


def test_toxicity_of_obfuscated_copies(spark):
    from pyspark.sql import functions as F

    r, texts, labels, held, taught = teaching_words(spark, "sf0.01")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter(~toxicity.held_out(F.col("doc_id"))))
    ways = [
        lambda w: w.replace("i", "1").replace("o", "0").replace("s", "$"),
        lambda w: " ".join(w),
        lambda w: "".join(c * 3 for c in w),
        lambda w: ".".join(w),
    ]
    made = []
    for i in held:
        words = texts[i].lower().split() if labels[i] == 1 else []
        if {w for w in words if w in taught and len(w) > 4}:
            made += [(10 * i + k, " ".join(f(w) if w in taught and len(w) > 4 else w for w in words)) for k, f in enumerate(ways)]
    got = [x.score >= toxicity.THRESHOLD for x in toxicity.score(spark.createDataFrame(made, "doc_id long, text string"), model).collect()]
    assert len(got) >= 12 and np.mean(got) >= 0.9


def test_toxicity_restores_and_edge_rows(spark, odd, none):
    text = "you stupid worthless idiot and other plain words of a text " * 3
    chars = toxicity.char_model(spark.createDataFrame([(text,)], "text string"))
    r = toxicity.Restorer(chars)
    assert r.text("an 1d10t is w0rthl3ss and s t u p i d or stuuupid") == "an idiot is worthless and stupid or stupid"
    train = spark.createDataFrame([(f"fine words here {i}", 0) for i in range(60)] + [(f"stupid idiot {i}", 1) for i in range(60)] + [(None, None)], "text string, toxic int")
    model = toxicity.fit(train)
    got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[2] == got[3]
    assert toxicity.score(none, model).count() == 0 and toxicity.score(odd, toxicity.fit(train.limit(0))).count() == odd.count()


def test_lm_base_and_model(spark):
    docs = rows("sf0.001", "documents", "doc_id, text")
    got = {r.doc_id: r for r in lm_score.query(spark, "/root/testdata/sf0.001").collect()}
    c = Counter()
    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 10:
            c.update(lm_score.tokens(text))
    n, v = sum(c.values()), len(c)
    for i, text in docs:
        words = lm_score.tokens(text)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(c[w] > 0 for w in words), n) and abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.score < 0 and r.bits_per_byte > 0


def learned(spark, texts):
    from pyspark.sql import functions as F

    return lm_score.fit(spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.lit(True).alias("learn")))


def test_probabilities_sum_to_at_most_one(spark):
    import random

    r = random.Random(3)
    model = learned(spark, [" ".join(r.choice(["a", "bc", "the", "then", f"w{r.randint(0, 99)}"]) for _ in range(300)) for _ in range(20)])
    one = [b"", *[bytes([b]) for b in range(256) if b != 32]]
    assert 0.01 < (10 ** model.spelled(one)).sum() <= 1 + 1e-6
    v = model.vocabulary
    after = [b"the", b"a"]

    def logs(docs):
        return np.concatenate([out for _, out in model.streamed([(ws, v.numbers(ws)) for ws in docs])])

    begun, every = logs([after]), logs([[*after, w] for w in [*v.index, b"no such word"]])
    assert abs((10 ** (every - begun[0])).sum() - 1) < 1e-6
    long = model.spelled([b"x" * 50_000, b"the"])
    assert np.isfinite(long).all() and long[1] > long[0]
    total = v.rare(np.array([1.0] * v.rare_distinct), lambda at: np.full(len(at), -300.0))
    assert (10**total).sum() <= 1


def brute_log10(mixer, symbol, contexts):
    """The decisions of a symbol, one by one, with whole numbers of any size."""
    from regspark.llm.lm_mixer import CLIP, LEVELS

    full, tables, total = (1 << 64) - 1, mixer.tables, 0.0
    for node, bit in symbol:
        slots = [node]
        for c, at in zip(contexts, tables.offsets[1:].tolist(), strict=True):
            h = (c ^ ((node + 1) * 0xA0761D6478BD642F & full)) * 0xE7037ED1A0B428DB & full
            slots.append((h >> (64 - tables.bits)) + at)
        found = [int(mixer.table[s]) for s in slots]
        gate = (found[mixer.gate[0]] & 3) * LEVELS + (found[mixer.gate[1]] & 3)
        mixed = sum(float(w[gate * LEVELS + (x & 3)]) * (x >> 2) for w, x in zip(mixer.weights, found, strict=True)) * CLIP / 127
        near = round((min(12.0, max(-12.0, mixed)) + 12) * 128)
        total += float(mixer.logs[(gate * 3073 + near) * 2 + bit])
        assert abs(sum(10.0 ** mixer.logs[(gate * 3073 + near) * 2 + b] for b in (0, 1)) - 1) < 1e-5
    return total


def test_lm_score_equals_brute_force(spark):
    from regspark.llm.lm_mixer import mix

    docs = rows("sf0.001", "documents", "doc_id, text")
    model = learned(spark, [t for _, t in docs])
    v, code = model.vocabulary, model.vocabulary.code
    hashed = lambda x: int(mix(np.array([x & (1 << 64) - 1], np.uint64))[0])
    end = v.index[b""]

    def path(n):
        at = slice(code.start[n], code.start[n] + code.length[n])
        return list(zip(code.node[at].tolist(), code.bit[at].tolist(), strict=True))

    def contexts(numbers, words, i):
        back = lambda k: (numbers[i - k], words[i - k]) if i >= k else (end, b"")
        names = [n if n else (1 << 32) + int.from_bytes(w[-2:], "big") for n, w in map(back, (1, 2))]
        often = [n for n in reversed(numbers[:i]) if 0 < n <= lm_score.FREQUENT or n == end][:2]
        a, b = sorted([*often, end, end][:2])
        return [hashed(names[0] + (1 << 40)), hashed(hashed(names[0] + (2 << 40)) + names[1]), hashed((a << 20 | b) + (3 << 50))]

    def spelled(word):
        text, total = b" " * 5 + word + b" ", 0.0
        for i in range(5, len(text)):
            h, found = 0, []
            for k in range(1, 6):
                h = (h + text[i - k] + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                if k in lm_score.ORDERS:
                    found.append(hashed(h + k))
            bits = [((text[i] | 256) >> (8 - j), text[i] >> (7 - j) & 1) for j in range(8)]
            total += brute_log10(model.spelling, bits, found)
        return total

    got = {r.doc_id: r.score for r in lm_score.score(spark.createDataFrame([(i, t, True) for i, t in docs], "doc_id long, text string, learn boolean")).collect()}
    count = Counter(w for _, t in docs for w in lm_score.tokens(t))
    few = sorted(docs, key=lambda d: len(d[1] or ""))[:: len(docs) // 11][:10]
    for i, text in few:
        words = lm_score.tokens(text)
        numbers = v.numbers(words).tolist()
        want = 0.0
        for k, n in enumerate(numbers):
            want += brute_log10(model.stream, path(n), contexts(numbers, words, k))
            if not n:
                want += float(v.rare(np.array([float(count[words[k]])]), lambda at, w=words[k]: np.array([spelled(w)] * len(at)))[0])
        assert abs(got[i] - want) < 0.02 * abs(want) + 0.1, (i, got[i], want)  # weights depend a little on how tasks are cut


def test_counts_are_exact_for_the_first_predictor(spark):
    from regspark.llm.lm_mixer import settled

    texts = [t for _, t in rows("sf0.001", "documents", "doc_id, text")]
    model = learned(spark, texts)
    v, c = model.vocabulary, Counter()
    for t in texts:
        for n in v.numbers(lm_score.tokens(t)).tolist():
            at = slice(v.code.start[n], v.code.start[n] + v.code.length[n])
            c.update(zip(v.code.node[at].tolist(), v.code.bit[at].tolist(), strict=True))
    counts = np.array([[c[n, 0], c[n, 1]] for n in range(v.code.nodes)])
    assert (settled(counts) == model.stream.table[: v.code.nodes]).all()


def test_lm_beats_the_base_on_held_out_texts(spark):
    found = [r for r in lm_score.query(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_lm_edge_rows(odd, none):
    from pyspark.sql import functions as F

    got = lm_score.score(odd.select("doc_id", "text", F.lit(True).alias("learn"))).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {1}
    assert lm_score.score(none.select("doc_id", "text", F.lit(True).alias("learn"))).count() == 0
    assert all(r.n_known == 0 for r in lm_score.score(odd.select("doc_id", "text", F.lit(False).alias("learn"))).collect())


def test_lm_sees_the_words_before(spark):
    from pyspark.sql import functions as F

    text = "the state board shall issue a license to each applicant who has paid the fee " * 3
    learned = [(i, text, True) for i in range(20)]
    asked = [(100, text, False), (101, " ".join(reversed(text.split())), False)]
    docs = spark.createDataFrame(learned + asked, "doc_id long, text string, learn boolean")
    got = {r.doc_id: r for r in lm_score.score(docs).filter(F.col("doc_id") >= 100).collect()}
    assert abs(got[100].base_score - got[101].base_score) < 1e-9 and got[100].score > got[101].score + 10


def test_many_tasks_and_long_words(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm_score, "FAN", 2)
    monkeypatch.setattr(lm_score, "TASK_TOKENS", 200)
    long = "y" * 300
    docs = spark.createDataFrame([(i, f"the {long} board of {i} words {long}z {i}", i % 5 > 0) for i in range(300)], "doc_id long, text string, learn boolean").repartition(9)
    got = lm_score.score(docs).collect()
    assert len(got) == 300 and {r.n_tokens for r in got} == {9}
    n, v = 240 * 9, 7 + 240
    base = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    for r in got:
        own = r.doc_id % 5 > 0
        want = 7 * base(240) + 2 * base(2 if own else 0)
        assert r.n_known == (9 if own else 7) and r.train_tokens == n and abs(r.base_score - want) < 1e-6


def test_toxicity_finds_words_in_runs(spark):
    text = "you stupid worthless idiot and other plain words are an old text of a friend " * 3
    r = toxicity.Restorer(toxicity.char_model(spark.createDataFrame([(text,)], "text string")))
    assert r.text("you,idiot y o u i d i o t you.are.an.idiot") == "you idiot you idiot you are an idiot"
    slots, owner = toxicity.features(["idiot", "x" * 50 + "idiot", "x" * 50, "今日" + "idiot" + "天气"])
    of = [set(slots[owner == i].tolist()) for i in range(4)]
    assert (of[0] & of[1]) - of[2] and of[0] & of[3]
    assert set(toxicity.features(["x" * 45])[0].tolist()) != set(toxicity.features(["x" * 44])[0].tolist())


def test_all_languages_are_learned(spark):
    import random

    r, made = random.Random(4), []
    for k in range(70):  # each language has its own letters; the last one is rare
        letters = [chr(0x4E00 + 40 * k + i) for i in range(30)]
        made += [(f"l{k:02d}", " ".join("".join(r.choices(letters, k=4)) for _ in range(12))) for _ in range(3 if k == 69 else 5)]
    docs = spark.createDataFrame(made, "lang string, text string")
    model = langid.fit(docs)
    assert len(model.languages) == 70
    got = langid.predict(docs, model).filter("lang = lang_pred AND lang_accepted").count()
    assert got == len(made)
    crowd = docs.filter("lang = 'l69'").unionByName(spark.range(3000).selectExpr("'l69' AS lang", "'copies copies' AS text"))
    one, two = (langid.fit(x, sample=4) for x in (crowd, crowd.repartition(3)))
    assert len(one.of) == 4 and np.allclose(one.centroids, two.centroids)


def test_batches_hold_the_tokens_of_their_texts(spark):
    import random

    import pyarrow as pa

    r = random.Random(5)
    odd = [None, "", " ", " a", "a ", "\x1c a\x0b\x0cB c\x85d É", "a\x00b  c", "ÀÉ İ ſ K", "x" * 100 + " " + "Y" * 65]
    texts = odd + ["".join(r.choice(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f  aBÇ") for _ in range(r.randint(0, 12))) for _ in range(500)]
    for arrow in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string())[7:400][:100], pa.array(texts, pa.string())[9:].cast(pa.large_string()), pa.array([], pa.string())):
        batch = lm_score.Batch.split(arrow)
        words = iter([batch.words[i] for i in batch.of.tolist()])
        assert [[next(words) for _ in range(n)] for n in batch.sizes.tolist()] == [lm_score.tokens(t) for t in arrow.to_pylist()]
        assert next(words, None) is None


def test_words_are_looked_up_once_a_batch(spark, monkeypatch):
    import pyarrow as pa

    texts = [f"the state board shall {'y' * 80} issue {i % 3}" for i in range(300)]
    model = learned(spark, texts)
    v, asked = model.vocabulary, []
    whole = np.concatenate([out for _, out in model.streamed([(ws, v.numbers(ws)) for ws in map(lm_score.tokens, texts)])])
    numbers = lm_score.Vocabulary.numbers
    monkeypatch.setattr(lm_score.Vocabulary, "numbers", lambda self, words: asked.append(len(words)) or numbers(self, words))
    got = model.logs(*lm_score.named(v, lm_score.Batch.split(pa.array(texts))))
    assert asked == [10] and np.array_equal(got, whole)  # six words, three numbers, the end


def test_word_counts_with_full_maps(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FLUSH", 5)
    long = "Z" * 70
    texts = [(f"a b {long} w{i % 9} {long}" if i % 4 else None, i % 3 > 0) for i in range(200)]
    found = lm_score.word_counts(spark.createDataFrame(texts, "text string, learn boolean")).collect()
    want = Counter()
    for text, learn in texts:
        want.update({w: int(learn) * n for w, n in Counter(lm_score.tokens(text)).items()})
    assert {bytes(r.word if r.word is not None else r.key): r.c for r in found} == dict(want) and len(found) == len(want)
    assert [bytes(r.word) for r in found if r.word is not None] == [long.lower().encode()]
