import numpy as np

from regspark.llm import line_dedup as L


def test_query_equals_sql(spark, same):
    same(spark, L.query, L.ORACLE_SQL)


def test_cuckoo_filter_forgets_what_is_deleted():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    f = L.CuckooFilter.holding(keys)
    assert f.contains(keys).all()
    f.delete(keys[:2500])
    f = L.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


def rows(df):
    return sorted((r.doc_id, r.n_dropped, r.text) for r in df.select("doc_id", "n_dropped", "text").collect())


def test_deleting_documents_brings_lines_back(spark):
    line = "this very line is found in many documents of the corpus"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}\n{line.upper()} ") for i in range(7)], "doc_id long, text string")
    part = docs.filter("doc_id < 4")
    index = L.LineIndex.of(part).insert(docs.filter("doc_id >= 4"))
    assert rows(index.apply(docs)) == rows(L.dedup_lines(docs)) and index.apply(docs).filter("n_dropped = 2").count() == 6
    back = index.delete(docs.filter("doc_id >= 4").select("doc_id"))
    assert rows(back.apply(part)) == rows(L.dedup_lines(part)) and back.apply(part).filter("n_dropped > 0").count() == 0
    assert back.counts.count() == 0


def test_edge_rows(odd, none, clashing):
    out = {r.doc_id: r for r in L.dedup_lines(odd).collect()}
    assert out[2].text == "" and out[2].n_lines == 1 and out[6].n_lines == 3 and out[None].n_dropped == 0
    assert L.dedup_lines(none).count() == 0 and L.dedup_lines(clashing).count() == clashing.count()


def index_rows(index):
    return {(r.k1, r.k2, r.n_docs, r.keeper) for r in index.counts.collect()}


def test_tiny_limits_change_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, L.query(spark, d).collect()))
    for name, value in (("FILTER_BYTES", 0), ("PROBE_ROWS", 7), ("KEYS_PER_SHARD", 5)):
        monkeypatch.setattr(L, name, value)
    assert sorted(map(tuple, L.query(spark, d).collect())) == want
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    whole = L.LineIndex.of(docs, 4, 2)
    grown = L.LineIndex.of(docs.filter("doc_id % 3 = 0"), 4, 2).insert(docs.filter("doc_id % 3 = 1")).insert(docs.filter("doc_id % 3 >= 1"))
    assert index_rows(grown) == index_rows(whole) and len(index_rows(whole)) > 5
    lost = lambda i: {(r.doc, k.k1) for r in i.drops().collect() for k in r["keys"]}
    assert lost(grown) == lost(whole) and lost(whole)
    shrunk = grown.delete(docs.filter("doc_id % 3 = 2").select("doc_id"))
    rest = L.LineIndex.of(docs.filter("doc_id % 3 < 2"), 4, 2)
    assert index_rows(shrunk) == index_rows(rest) and lost(shrunk) == lost(rest)
    back = shrunk.insert(docs.filter(F.col("doc_id") % 3 == 2))
    assert index_rows(back) == index_rows(whole) and lost(back) == lost(whole)


def test_ties_and_ids_with_several_texts(spark):
    line = "a line that is long enough to count as a repeated one, surely"
    rows = [(i, f"{line}\nown {i}") for i in range(5)] + [(4, line.upper()), (4, f"  {line}\t"), (2, None)]
    out = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(out, key=str) == sorted([(i, 2, 1, f"own {i}") for i in range(4)] + [(4, 2, 0, f"{line}\nown 4"), (4, 1, 0, line.upper()), (4, 1, 0, f"  {line}\t"), (2, 1, 0, "")], key=str)
