from regspark.llm import decontaminate as D


def test_query_equals_sql(spark, same):
    same(spark, D.query, D.ORACLE_SQL)


def test_without_broadcast(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = D.table(spark, d, "documents"), D.table(spark, d, "benchmark")
    assert sorted(D.hits(docs, bench).collect()) == sorted(D.hits(docs, bench, broadcast_words=0).collect())


def test_long_runs_short_items_and_block_borders(spark):
    words = [f"w{i}" for i in range(900)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "A b, C! d"), (3, "a b x"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(words[250:275])), (11, "a b"), (12, ""), (13, None), (14, " ".join(words[880:]) + " end")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in D.scan(docs, bench).collect()}
    assert got == {1: (900, 45, ["10", "14"]), 2: (4, 2, ["11"]), 3: (3, 2, ["11"]), 4: (0, 0, [])}


def test_edge_rows(spark, odd, none, clashing):
    bench = spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox")], "item_id long, text string")
    assert D.scan(odd, bench).count() == odd.count() and D.clean(clashing, bench).count() == odd.count() - 3
    assert D.scan(none, bench).count() == 0 and D.scan(odd, bench.limit(0)).filter("contaminated").count() == 0
