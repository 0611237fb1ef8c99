"""Phrase collocations against SQL and against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from regspark.llm import collocations as C


def brute(docs, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    frequent = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    out = []
    for (lang, w), a in frequent.items():
        if any(g == lang and len(x) > len(w) and v >= a and any(x[i : i + len(w)] == w for i in range(len(x))) for (g, x), v in frequent.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    result = []
    for lang in {o[0] for o in out}:
        for i, (_, s, a, p, x, y, t) in enumerate(sorted(o for o in out if o[0] == lang)[:top], 1):
            result.append((lang, i, p.decode(), -a, x, y, t, -s))
    return sorted(result)


def got(df, **options):
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


def test_query_equals_sql(spark, same):
    same(spark, C.query, C.ORACLE_SQL, "sf0.01")


@pytest.mark.parametrize(("least", "top", "bits"), [(3, 2000, 29), (2, 7, 29), (5, 2000, 12)])
def test_equals_brute_force(spark, monkeypatch, least, top, bits):
    monkeypatch.setattr(C, "FILTER_BITS", bits)  # a filter that lets nearly everything through changes nothing
    rng = random.Random(least)
    words = ["a", "B", "b", "é", "数据", "x y", " ", "the", "\x1f", "<s>", "-"]
    docs = []
    for i in range(250):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ".", "\n", "\x0b", ", "]) for _ in range(rng.randint(0, 40)))
        docs.append((i, rng.choice(["en", "de", "", None]), rng.choice([text, text, text, None, ""])))
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(5)
    assert got(df, least=least, top=top) == brute([d[1:] for d in docs], least, top=top)


def test_odd_rows(spark, odd, none, clashing):
    docs = [(r.lang, r.text) for r in odd.collect()]
    want = brute(docs, 2)
    assert len(want) > 3 and got(odd, least=2) == want and got(clashing, least=2) == want
    assert got(none) == [] and got(odd.filter("doc_id = 3")) == []


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(1)
    keys = rng.zipf(1.2, 60_000).astype(np.uint64) % 50_000
    exact = Counter(keys.tolist())
    for parts in (1, 7, 60):
        s = C.Summary(len(keys) // 100 + 1)
        for part in np.array_split(keys, parts):
            k, n = np.unique(part, return_counts=True)
            s.add(k.astype(np.uint32), n)
            s.merge()
            assert len(s.keys) <= s.capacity
        kept = set(s.survivors(100).tolist())
        assert s.taken < 100 and {k for k, n in exact.items() if n >= 100} <= kept
        assert len(kept) < 2000 < len(exact)
