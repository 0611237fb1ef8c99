"""Many terms over many texts, against counting one by one; pages of ranges."""

import random
import time

from pyspark.sql import functions as F
from regspark.operators import analyze, audit, patterns, segment


def test_counts_and_pages_equal_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for i in range(60):
        parts = []
        for page in range(rng.randint(0, 5)):
            words = " ".join(rng.choice(["aa", "aaa", "Aab", "fee", "late fee", "§ 1", "x"]) for _ in range(rng.randint(0, 12)))
            parts.append(f"[Page {page + 1}]\n{words}")
        texts.append((i, "\n\n".join(parts) if i % 9 else None))
    terms = ["a", "aa", "AAA", "fee", "late fee", "ee l", "§", "[page 2]", "", None, "x\n\n[page", "zz"]
    df, asked = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r.term, r.doc_id): (r["count"], list(r.pages)) for r in analyze.term_count(asked, df, need_token=False).collect()}
    want = {}
    for i, text in texts:
        for t in terms:
            if text and t and t.lower() in text.lower():
                pages = [int(p.split("]")[0]) for p in text.split("[Page ")[1:] if t.lower() in ("[page " + p).lower()]
                want[t, i] = (text.lower().count(t.lower()), pages[:20])
    assert got == want and len(want) > 200
    no_marks = {(r.term, r.doc_id): r["count"] for r in analyze.term_count(asked, df, need_token=False, markers=False).collect()}
    assert not any(t == "[page 2]" for t, _ in no_marks) and no_marks["fee", 1] == got["fee", 1][0]
    words = {r.term for r in analyze.term_count(asked, df).collect()}
    assert words == {"aa", "AAA", "fee", "late fee", "[page 2]"} or words == {"aa", "AAA", "fee", "late fee", "[page 2]", "x\n\n[page"}


def test_blocks_of_terms_give_the_same(spark):
    docs = spark.createDataFrame([(i, [(None, f"word{i} and word{i + 1}, word{i}")]) for i in range(50)], "doc_id int, parts array<struct<page int, text string>>")
    terms = spark.createDataFrame([(f"word{i}",) for i in range(60)], "term string")
    rows = lambda df: sorted((r.doc_id, r.term, r["count"]) for r in df.collect())
    whole = rows(patterns.occurrences(docs, terms, ["doc_id"]))
    assert len(patterns.blocks(terms, 100)) > 5 and rows(patterns.occurrences(docs, terms, ["doc_id"], size=100)) == whole
    assert (49, "word49", 2) in whole and (11, "word1", 3) in whole
    assert rows(patterns.occurrences(docs, terms.limit(0), ["doc_id"])) == []


def test_a_hundred_thousand_terms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    terms = spark.range(100_000).select(F.concat(F.lit("th"), F.hex("id")).alias("term")).union(spark.createDataFrame([("the",), ("license",)], "term string"))
    began = time.perf_counter()
    found = analyze.term_count(terms, docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.term: r.n for r in found.groupBy("term").agg(F.sum("count").alias("n")).collect()}
    one = analyze.term_count(spark.createDataFrame([("the",), ("license",)], "term string"), docs)
    assert {t: got[t] for t in ("the", "license")} == {r.term: r.n for r in one.groupBy("term").agg(F.sum("count").alias("n")).collect()}
    assert time.perf_counter() - began < 120


def test_golden_coverage_of_odd_parts(spark):
    records = spark.createDataFrame([("MS", "a_1.pdf"), ("MS", "a_1.pdf"), ("MS", "b.pdf"), ("TN", "a_1.pdf"), (None, "a_1.pdf"), ("MS", None)], "state string, filename string")
    golden = spark.createDataFrame([(1, "MS", "a_1"), (2, "MS", ""), (3, "MS", None), (4, "TN", "b"), (5, "MS", "pdf"), (6, None, "a")], "id int, expected_state string, expected_doc_filename_substring string")
    assert {r.id: r.hits for r in audit.golden_coverage(golden, records).collect()} == {1: 2, 2: 3, 3: 0, 4: 0, 5: 3, 6: 0}


def test_a_reference_means_an_equal_key_first(spark):
    answers = spark.createDataFrame([(1, "Rule 5, Rule 5.1 and a.pdf; Rule 9"), (2, None), (3, "no source")], "answer_id int, text string")
    cites = [(1, "z.pdf", "rule 5.1", [3], []), (1, "b.pdf", "Rule 5", [], None), (1, "aa.pdf", None, None, [""]), (1, "a.pdf", "", [4], ["x"]), (3, "a.pdf", "no source", [1], [])]
    c = spark.createDataFrame(cites, "answer_id int, document string, section string, pages array<int>, statute_codes array<string>")
    got = [(r.answer_id, r.position, r.reference, r.document, r.page) for r in audit.link_references(answers, c).orderBy("answer_id", "position").collect()]
    assert got == [(1, 0, "Rule 5", "b.pdf", 1), (1, 1, "Rule 5.1", "z.pdf", 3), (1, 2, "a.pdf", "a.pdf", 4)]


def test_pages_of_a_long_document(spark):
    pages = spark.range(100_000).selectExpr("1 AS doc_id", "CAST(id + 1 AS INT) AS page_number", "id * 50 AS page_start", "id * 50 + 50 AS page_end")
    chunks = spark.range(60_000).selectExpr("1 AS doc_id", "id * 80 AS start", "id * 80 + 120 AS end").union(spark.sql("SELECT 2, 5L, 9L UNION ALL SELECT 1, 999999999L, 999999999L"))
    began = time.perf_counter()
    got = {(r.doc_id, r.start): list(r.pages) for r in segment.pages_for_ranges(chunks, pages).collect()}
    assert time.perf_counter() - began < 60 and len(got) == 60_002
    assert got[2, 5] == [1] and got[1, 999999999] == [1]
    assert all(got[1, s] == list(range(s // 50 + 1, (s + 119) // 50 + 2)) for s in range(0, 4_000_000, 80_000))
    over = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 10, 20), (1, 3, 30, 40)], "doc_id int, page_number int, page_start int, page_end int")
    one = segment.pages_for_ranges(spark.createDataFrame([(1, 35, 90, "x")], "doc_id int, start int, end int, note string"), over).first()
    assert list(one.pages) == [1, 3] and one.note == "x"
