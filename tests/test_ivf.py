"""The clustered index: recall, pairs compared, odd vectors, crowded lists."""

import numpy as np
import pyarrow as pa
import pytest

from regspark.operators import ivf, retrieve
from regspark.plans.queries import _queries, v_vectors
from regspark.sources.scratch import scratch_path


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_and_pairs_on_the_given_vectors(spark, sf):
    d = f"/root/testdata/{sf}"
    vectors, questions = v_vectors(spark, d), _queries(spark, d)
    index = ivf.build(vectors, scratch_path(spark, "ivf-test"))
    found = ivf.search(questions, index)
    row = ivf.recall(found, retrieve.knn(questions, vectors, 10)).first()
    assert row.found >= 0.9 * row.wanted
    assert row.questions * ivf.OVERSAMPLE * 10 < 0.1 * row.questions * vectors.count()
    assert index.size.sum() == vectors.count() and index.probes <= len(index.size)
    again = ivf.load(spark, index.path)
    assert again.probes == index.probes and sorted(ivf.search(questions, again).collect()) == sorted(found.collect())


def clusters(rng, groups=40, each=60):
    middle = rng.normal(size=(groups, 16))
    return [(g * each + i, [float(x) for x in middle[g] + 0.15 * rng.normal(size=16)]) for g in range(groups) for i in range(each)]


def test_clustered_vectors_need_few_lists(spark):
    rows = clusters(np.random.default_rng(5))
    df = spark.createDataFrame(rows, "record_id long, vector array<double>")
    index = ivf.build(df, scratch_path(spark, "ivf-test"))
    asked = df.filter("record_id % 60 = 0").selectExpr("record_id AS question_id", "vector AS q")
    row = ivf.recall(ivf.search(asked, index), retrieve.knn(asked, df, 10)).first()
    looked = index.size[: index.probes].sum() / index.size.sum()
    assert row.found >= 0.9 * row.wanted and index.probes <= 8 and looked < 0.25


def test_odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(200)]
    rows += [(900, None), (901, [0.0] * 5), (902, [1.0]), (903, [float("nan")] * 5), (904, [1.0, None, 0.0, 0.0, 0.0]), (905, [float("inf")] * 5)]
    df = spark.createDataFrame(rows, "record_id long, vector array<double>")
    index = ivf.build(df, scratch_path(spark, "ivf-test"), lists=8)
    assert index.size.sum() == 260
    asked = df.filter("record_id IN (3, 150, 900, 901, 902, 903)").selectExpr("record_id AS question_id", "vector AS q")
    got = ivf.search(asked, index, k=5).collect()
    assert {r.question_id for r in got} == {3, 150} and len(got) == 10
    assert all(abs(r.score - 1) < 1e-9 for r in got if r.question_id == 150)
    empty = ivf.build(df.limit(0), scratch_path(spark, "ivf-test"))
    assert ivf.search(asked, empty).count() == 0


@pytest.mark.parametrize("waiting", [1, 1 << 19])
def test_a_task_sends_on_the_best_codes_of_all_its_batches(monkeypatch, waiting):
    """No more than the cut a question, however many batches and lists; equal guesses by key."""
    from regspark.operators import vectors

    monkeypatch.setattr(vectors, "WAITING", waiting)
    monkeypatch.setattr(ivf, "PAIRS", 100)
    rng = np.random.default_rng(7)
    c, scale, cut = rng.normal(size=(6, 5)), np.full(5, 0.3), 4
    q, looks = rng.normal(size=(9, 5)), rng.random((9, 6)) < 0.6
    lists, keys = np.sort(rng.integers(0, 6, 300)).astype(np.int32), rng.permutation(300)
    code = rng.integers(0, 256, (300, 3)).astype(np.uint8)
    code[100:200] = code[100]
    code[:, 2] &= 0xF0
    table = pa.table({"list": pa.array(lists), "key": pa.array(keys), "code": pa.array([r.tobytes() for r in code], pa.binary())})
    got = pa.Table.from_batches(list(ivf.best_codes(iter(table.to_batches(max_chunksize=37)), q, looks, c, scale, cut)))
    level = np.stack([code >> 4, code & 15], axis=2).reshape(300, -1)[:, :5]
    x = c[lists] + (level * (2 / 15) - 1) * scale
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    guess = np.round(q @ x.T, 12)
    found = {}
    for r in got.to_pylist():
        found.setdefault(r["question"], set()).add((r["key"], r["list"]))
    for i in range(9):
        order = sorted(np.flatnonzero(looks[i, lists]), key=lambda j: (-guess[i, j], keys[j]))[:cut]
        assert found.get(i, set()) == {(keys[j], lists[j]) for j in order}
