"""Top-k search and near duplicates."""

import numpy as np

from pyspark.sql import functions as F
from regspark.llm import near_dedup as N
from regspark.llm import topk as K


def test_topk_equals_sql(spark, same):
    same(spark, K.query, K.ORACLE_SQL)


def brute(vectors, queries, k):
    out = []
    for q in queries:
        s = sorted((-int(np.dot(vectors[q], vectors[v])), v) for v in vectors if v != q)
        out += [(q, i + 1, v, -x) for i, (x, v) in enumerate(s[:k])]
    return sorted(out)


def test_topk_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(700)] + [(1000 + i, [0.5] * 6) for i in range(300)]
    odd = [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    exact = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    got = sorted(tuple(r) for r in K.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(exact, [i for i in exact if i % 50 == 0], 5)
    few = K.top_k(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2 and K.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def classes(df):
    return {r.doc_id: r.class_id for r in N.classes(df).collect()}


def test_dart_minhash_estimates_weighted_similarity():
    a = np.arange(1, 301, dtype=np.uint64)
    w1, w2 = np.ones(300), np.where(np.arange(300) < 150, 2.5, 0.5)
    s = N.dart_minhash(np.concatenate([a, a]), np.repeat([0, 1], 300), 2, 4000, np.concatenate([w1, w2]))
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for g in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(int(rng.integers(1, 12))):
            words = list(base)
            for at in rng.integers(0, 120, int(rng.integers(0, 5))):
                words[at] = f"v{rng.integers(0, 9999)}"
            rows.append((n, " ".join(words)))
            n += 1
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute_classes(rows)


def brute_classes(rows):
    """Connected components of all pairs with a Jaccard similarity of 0.8 or more, smallest id first."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    ids, label, holders = [i for i, _ in rows], list(range(len(rows))), {}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in holders.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            holders[x].append(i)
        for j, both in common.items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(rows))}


def near_copies(n, edits, seed, words=100, first=0):
    rng = np.random.default_rng(seed)
    base = [f"b{seed}x{i}" for i in range(words)]
    for i in range(n):
        out = list(base)
        for at in rng.integers(0, words, edits(rng)):
            out[at] = f"e{rng.integers(0, 10**6)}"
        yield first + i, " ".join(out)


def test_large_group_of_near_copies(spark):
    rows = list(near_copies(5000, lambda rng: int(rng.integers(0, 3)), 1))
    got = classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert len(got) == 5000 and sum(c == 0 for c in got.values()) > 4990 and got[0] == 0


def test_outsiders_of_a_large_bucket_and_chains(spark, monkeypatch):
    rows = list(near_copies(600, lambda rng: int(rng.integers(0, 9)), 2))
    chain = [f"c{i}" for i in range(100)]
    for k in range(12):  # each link of the chain drops what its predecessor began with
        rows.append((1000 + k, " ".join(chain[6 * k :] + [f"d{i}" for i in range(6 * k)])))
    want = brute_classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert len({want[i] for i in range(1000, 1012)}) == 1 and len(set(want.values())) > 20
    assert classes(df) == want
    monkeypatch.setattr(N, "BLOCK_NODES", 50)  # many blocks give the same classes
    assert classes(df) == want


def test_open_buckets_and_merging(spark, monkeypatch):
    rows = list(near_copies(80, lambda rng: int(rng.integers(0, 9)), 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = docs.select(F.col("doc_id").alias("node"), N.text_digest(docs).alias("digest"), F.col("doc_id").alias("doc"))
    sets = N.stored(N.shingle_sets(docs, wanted), "test-sets")
    bucket = wanted.select(F.lit(1).cast("long").alias("bucket"), "node", F.lit(5).cast("long").alias("hub"))
    none = spark.createDataFrame([], "node long, label long")
    want = brute_classes(rows)
    for size in (1024, 7):
        monkeypatch.setattr(N, "BLOCK_NODES", size)
        got = {r.node: r.label for r in N.merged(none, N.components(N.open_links(bucket, none, sets, 0.8))).collect()}
        assert {i: got.get(i, i) for i, _ in rows} == want
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (8, 8), (9, 8)], "node long, label long")
    joined = spark.createDataFrame([(3, 1), (1, 1), (7, 1)], "node long, label long")
    assert sorted(map(tuple, N.merged(labels, joined).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 1), (8, 8), (9, 8)]


def test_common_shingles():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, int(n)).astype(np.uint64)) for n in rng.integers(0, 200, 30)]
    both = N.common_shingles(sets, often=8, width=64)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)


def test_given_documents_lose_no_link(spark):
    import re

    from tests_data import rows as table

    texts = {i: " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in table("sf0.01", "documents", "doc_id, text")}
    long = [(i, t) for i, t in sorted(texts.items()) if len(t.split()) >= 5]
    want = brute_classes(long)
    docs = spark.createDataFrame(long, "doc_id long, text string")
    assert classes(docs) == want


def test_edge_rows(odd, none, clashing):
    got = classes(odd)
    assert got[1] == got[4] == 1 and got[2] == got[3] == 2 and got[None] is None and got[6] == 6
    assert N.classes(none).count() == 0 and N.keep_one(none).count() == 0
    kept = N.keep_one(clashing)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 6, 7, 8, 9] and kept.columns == clashing.columns
