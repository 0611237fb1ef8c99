"""Versions, replays, readers during a write, the key index, broken input."""

import json

from regspark.sources.scratch import scratch_path
from regspark.sources.store import RecordStore, admits, ingest, key_filter

SCHEMA = "page_id string, state string, n long, ingested_at long"


def store(spark, buckets=8):
    return RecordStore(spark, scratch_path(spark, "store-test"), SCHEMA, buckets=buckets)


def rows(spark, keys, n, at, state="MS"):
    return spark.createDataFrame([(k, state, n, at) for k in keys], SCHEMA)


def held(df):
    return {r.page_id: (r.state, r.n) for r in df.collect()}


def test_replay_changes_nothing_and_versions_stay(spark):
    s = store(spark)
    assert s.read().count() == 0 and s.version() == 0
    assert s.upsert(rows(spark, ["a", "b", "c"], 1, 1), "x").fresh
    assert s.upsert(rows(spark, ["b", "d"], 2, 2, "TN"), "y").version == 2
    assert not s.upsert(rows(spark, ["b"], 9, 9), "y").fresh
    now = {"a": ("MS", 1), "b": ("TN", 2), "c": ("MS", 1), "d": ("TN", 2)}
    assert held(s.read()) == now and held(s.read(1)) == {k: ("MS", 1) for k in "abc"}
    s.delete(spark.createDataFrame([("a",), ("zz",), (None,)], "page_id string"), "z")
    assert held(s.read()) == {k: v for k, v in now.items() if k != "a"} and held(s.read(2)) == now
    assert [(r.version, r.parent, r.rows) for r in s.commits().orderBy("version").collect()] == [(1, 0, 3), (2, 1, 4), (3, 2, 3)]


def test_newest_of_a_batch_and_rows_without_a_key(spark):
    s = store(spark)
    batch = spark.createDataFrame([("a", "MS", 1, 1), ("a", "MS", 3, 3), ("a", "MS", 2, 2), (None, "MS", 7, 1)], SCHEMA)
    s.upsert(batch, "x")
    assert held(s.read()) == {"a": ("MS", 3)}
    assert [json.loads(r.record)["n"] for r in s.rejects().collect()] == [7]
    s.upsert(batch.limit(0), "empty")
    assert held(s.read()) == {"a": ("MS", 3)} and s.version() == 2


def test_a_reader_sees_one_version_and_a_crash_leaves_the_old_one(spark, monkeypatch):
    s = store(spark)
    s.upsert(rows(spark, ["a", "b"], 1, 1), "x")
    before = s.read()
    s.upsert(rows(spark, ["a", "b"], 2, 2), "y")
    assert held(before) == {"a": ("MS", 1), "b": ("MS", 1)}  # files of the version it opened are still there
    made = []

    def crash(name):
        made.append(name)
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(s, "_described", crash)
    try:
        s.upsert(rows(spark, ["a", "c"], 3, 3), "z")
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert made and held(s.read()) == {"a": ("MS", 2), "b": ("MS", 2)}
    s.upsert(rows(spark, ["a", "c"], 3, 3), "z")
    assert held(s.read()) == {"a": ("MS", 3), "b": ("MS", 2), "c": ("MS", 3)}


def test_only_parts_that_may_hold_a_key_are_read(spark):
    s = store(spark, buckets=16)
    s.upsert(rows(spark, [f"k{i:04d}" for i in range(400)], 1, 1), "one")
    parts = {r.part: r.bucket for r in s.parts().collect()}
    assert len(parts) == 16
    two = s.upsert(rows(spark, ["k0007", "k0008"], 2, 2), "two")
    assert 1 <= len(two.read) <= 2
    new = s.upsert(rows(spark, [f"n{i:04d}" for i in range(30)], 1, 3), "three")
    assert new.read == ()  # beyond every part's largest key: nothing old is read
    inside = s.upsert(rows(spark, [f"k{i:04d}x" for i in range(30)], 1, 3), "four")
    assert len(inside.read) <= 6  # ranges admit all, filters nearly none
    assert s.read().count() == 460 and s.read().filter("n = 2").count() == 2
    files = {f.split("/data/")[1].split("/")[0] for f in s.read().inputFiles()}
    assert len(files) > 2  # older writes' parts are still in use


def test_many_small_writes_are_joined(spark):
    s = store(spark, buckets=1)
    for i in range(11):
        s.upsert(rows(spark, [f"k{i:02d}"], i, i), f"b{i}")
    assert s.parts().count() < 9 and s.read().count() == 11


def test_filters_admit_all_their_keys():
    import numpy as np

    rng = np.random.default_rng(0)
    keys, others = (rng.integers(-(2**63), 2**63, 5000) for _ in range(2))
    f = key_filter(keys)
    assert admits(f, keys).all() and admits(f, others).mean() < 0.03


def test_stream_with_broken_lines_and_a_replay(spark, tmp_path):
    source, s = tmp_path / "in", store(spark)
    source.mkdir()
    (source / "a.json").write_text('{"page_id": "a", "n": 1}\nnot json\n{"page_id": "b", "n": "x"}\n{"page_id": "c", "n": 3}\n')

    def rows_of(df):
        return df.selectExpr("page_id", "'MS' AS state", "n", "1L AS ingested_at")

    def run(mark):
        query = ingest(s, str(source), "page_id string, n long", rows_of, str(tmp_path / mark))
        assert query.awaitTermination(60)
        assert query.exception() is None

    run("mark")
    assert held(s.read()) == {"a": ("MS", 1), "c": ("MS", 3)}
    bad = s.rejects().collect()
    assert sorted(r.record for r in bad) == ["not json", '{"page_id": "b", "n": "x"}'] and all(r.file.endswith("a.json") for r in bad)
    run("other-mark")  # the stream's own log is lost: batch 0 comes again
    assert s.version() == 1 and len(s.rejects().collect()) == 2
    (source / "b.json").write_text('{"page_id": "a", "n": 9}\n')
    run("mark")
    assert held(s.read())["a"] == ("MS", 1) or s.version() == 2
    assert s.version() == 2


def test_statistics_without_reading_records(spark):
    s = RecordStore(spark, scratch_path(spark, "store-test"), SCHEMA, buckets=4, sketch=("state", "n"))
    assert s.stats().count() == 0
    s.upsert(rows(spark, [f"k{i}" for i in range(500)], 1, 1), "one")
    s.upsert(spark.range(300).selectExpr("concat('k', id) AS page_id", "'TN' AS state", "id AS n", "2L AS ingested_at"), "two")
    s.delete(spark.range(100).selectExpr("concat('k', id) AS page_id"), "three")
    got = {r.group: (r.rows, r.documents) for r in s.stats().collect()}
    assert got["MS"] == (200, 1) and got["TN"][0] == 200 and abs(got["TN"][1] - 200) <= 4
    plan = s.stats()._jdf.queryExecution().executedPlan().toString()
    assert "/data/" not in plan
    assert {r.group: r.rows for r in s.stats(1).collect()} == {"MS": 500}


def test_run_statistics_need_one_scan(spark, tmp_path):
    from regspark.operators import clean

    pages = spark.createDataFrame([(1, "x", None), (1, None, "e"), (2, "y", "e"), (None, "z", None)], "doc_id int, output string, error string")
    got = clean.write_observed(pages, str(tmp_path / "out"))
    assert got == clean.run_stats(pages).first().asDict() == {"documents": 2, "pages": 4, "abstracts": 2, "failures": 2}
    assert spark.read.parquet(str(tmp_path / "out")).columns == pages.columns
    assert clean.write_observed(pages.limit(0), str(tmp_path / "none")) == {"documents": 0, "pages": 0, "abstracts": 0, "failures": 0}


def test_history_one_by_one_equals_history_at_once(spark):
    from regspark.operators import links
    from regspark.plans.store import _recorded, v_crawls

    d = "/root/testdata/sf0.001"
    rows_of = lambda df: sorted(((r.url, r.file_hash, r.valid_from, r.valid_to) for r in df.collect()), key=str)
    one, all_ = rows_of(_recorded(spark, d)), rows_of(links.history_of(v_crawls(spark, d)))
    assert one == all_ and any(r[3] for r in one) and not all(r[3] for r in one)
