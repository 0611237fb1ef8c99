import random
from collections import Counter

from regspark.llm import shard as S


def test_matrix_has_both_margins():
    counts, sizes = [13, 0, 50, 7, 1000], [268, 268, 267, 267]
    m = S.communication_matrix(counts, sizes, 1)
    assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes


def test_draws_follow_the_law():
    rng = random.Random(1)
    n = 20_000
    got = Counter(S.hypergeometric(rng, 7, 13, 5) for _ in range(n))
    from math import comb

    assert all(abs(got[k] / n - comb(7, k) * comb(13, 5 - k) / comb(20, 5)) < 0.015 for k in range(6))


def test_sizes_slots_and_uniformity(spark):
    out = S.shuffle_into_shards(spark.range(10_007).withColumnRenamed("id", "x"), shards=16, block_rows=40).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert sorted(r.x for r in out) == list(range(10_007)) and {len(v) for v in by.values()} == {625, 626}
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
        assert abs(sum(r.x for r in v) / len(v) - 5003) < 600
    first = sorted(by[0], key=lambda r: r.slot)
    ups = sum(a.x < b.x for a, b in zip(first, first[1:], strict=False))
    assert 0.4 < ups / len(first) < 0.6


def test_edge_rows(odd, none, clashing):
    assert S.shuffle_into_shards(odd).count() == odd.count()
    assert S.shuffle_into_shards(none).count() == 0
    out = S.shuffle_into_shards(clashing)
    assert out.columns.count("shard") == 1 and out.columns.count("slot") == 1 and out.count() == clashing.count()
    assert S.shuffle_into_shards(odd.select("text").filter("text = ''")).count() == 1


def test_draws_of_many_rows():
    rng = random.Random(2)
    good, bad, draws = 10**10, 15 * 10**10, 10**7
    got = [S.hypergeometric(rng, good, bad, draws) for _ in range(60)]
    mean, p = draws / 16, 1 / 16
    sd = (draws * p * (1 - p)) ** 0.5
    assert abs(sum(got) / 60 - mean) < 4 * sd / 60**0.5 and 0.7 * sd < (sum((x - mean) ** 2 for x in got) / 60) ** 0.5 < 1.3 * sd


def test_draws_at_the_edges():
    rng = random.Random(3)
    assert S.hypergeometric(rng, 0, 5, 3) == 0 and S.hypergeometric(rng, 5, 0, 3) == 3 and S.hypergeometric(rng, 4, 3, 7) == 4
    assert {S.hypergeometric(rng, 1, 1, 1) for _ in range(50)} == {0, 1}


def test_query(spark):
    import zlib
    from collections import defaultdict

    from tests.llm.tests_data import rows

    texts = dict(rows("sf0.001", "documents", "doc_id, text"))
    out = S.query(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) == len(texts) and out.groupby("shard").size().max() - out.groupby("shard").size().min() <= 1
    slots = defaultdict(list)
    for r in out.itertuples():
        data = (texts[r.doc_id] or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.law == "rows" and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
