"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import pytest
import xxhash

from regspark.llm import simhash as S
from tests.llm.tests_data import rows


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64(" ".join(p).encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest connected value of each 64-bit value, by comparing all with all."""
    x = np.array(sorted(set(prints)), np.uint64)
    label = np.arange(len(x))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            return {int(v): int(x[i]) for v, i in zip(x, label, strict=True)}
        label = new


def want(docs):
    prints = [fingerprint(t) for _, t in docs]
    root = components(prints)
    least = {}
    for (d, _), p in zip(docs, prints, strict=True):
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    return sorted(((d, f"{p:016x}", least.get(root[p])) for (d, _), p in zip(docs, prints, strict=True)), key=str)


def got(df, **options):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.classes(df, **options).collect()), key=str)


def test_given_documents_equal_brute_force(spark):
    assert got(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")) == want(rows("sf0.001", "documents", "doc_id, text"))


def test_odd_rows(spark, odd, none, clashing):
    expected = want([(r.doc_id, r.text) for r in odd.collect()])
    assert got(odd) == expected and got(clashing) == expected and got(none) == []


def crowd(rng, n):
    """Fingerprints in crowds: copies with a few flipped bits, among others."""
    out = {0, 2**64 - 1, 1 << 63, 3 << 62}
    for _ in range(n):
        base = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        loose = rng.integers(0, 64, 7)
        out |= {base ^ sum({1 << int(b) for b in rng.choice(loose, int(rng.integers(0, 5)))}) for _ in range(40)}
    return out


@pytest.mark.parametrize(("cell", "width"), [(64, 4), (3, 4), (3, 2), (1, 1)])
def test_links_connect_what_brute_force_connects(spark, cell, width):
    prints = crowd(np.random.default_rng(cell + width), 30)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    pairs = [(r.a % 2**64, r.b % 2**64) for r in S.links(spark.createDataFrame(signed, "fp long"), cell, width).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    root = components(prints)
    parent = {p: p for p in prints}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in pairs:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert {p: top(p) for p in prints} == root
