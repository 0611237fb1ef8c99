"""Queries of the clustered index, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.operators import ivf, retrieve
from regspark.plans.queries import _COS, _bm25_sql, _queries, register, spread, t, v_questions, v_vectors
from regspark.schema import BOOSTS
from regspark.sources.scratch import scratch_path


@register("knn_approx")
def knn_approx(spark, d):
    index = ivf.build(v_vectors(spark, d), scratch_path(spark, "ivf"))
    return ivf.search(_queries(spark, d), index).withColumn("score", F.round("score", 6))


@register("knn_recall", """
SELECT count(*) AS questions, 10 * count(*) AS wanted, true AS enough_found, true AS few_compared, true AS scores_exact FROM embeddings WHERE vec_id % 100 = 0""")
def knn_recall(spark, d):
    """Whether the index finds 0.9 of all questions' ten exact neighbours, compares a tenth of all pairs at most, and
    scores what it finds as the exact search does."""
    vectors, questions = v_vectors(spark, d), _queries(spark, d)
    index = ivf.build(vectors, scratch_path(spark, "ivf"))
    found, exact = ivf.search(questions, index), retrieve.knn(questions, vectors, 10)
    compared = ivf.OVERSAMPLE * 10 <= 0.1 * int(index.size.sum())
    pair = found.join(exact.withColumnRenamed("score", "true_score"), ["question_id", "record_id"])
    scores = pair.agg(F.coalesce(F.bool_and(F.abs(F.col("score") - F.col("true_score")) < 1e-9), F.lit(False)).alias("scores_exact"))
    return ivf.recall(found, exact).crossJoin(F.broadcast(scores)).select("questions", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("enough_found"), F.lit(compared).alias("few_compared"), "scores_exact")


def v_state_questions(spark, d):
    """Benchmark items with a vector, asking for one, three or five states (of which one has no records)."""
    q = v_questions(spark, d).join(v_vectors(spark, d).select(F.col("record_id").alias("question_id"), F.col("vector").alias("q")), "question_id")
    lists = [F.array(*[F.lit(s) for s in x]) for x in (("de", "de"), ("fr", "en", "de"), ("es", "en", "xx", "fr", "de"))]
    return q.withColumn("states", F.when(F.col("question_id") % 3 == 0, lists[0]).when(F.col("question_id") % 3 == 1, lists[1]).otherwise(lists[2]))


def _states_sql(budget: str) -> str:
    text = _bm25_sql({"text": 1.5}, 15).split("r AS (SELECT *, CAST(row_number()")[0].strip().removeprefix("WITH ")
    return f"""
WITH {text}
v AS (SELECT d.doc_id, d.lang, embedding FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
l AS (SELECT DISTINCT item_id AS question_id, CASE item_id % 3 WHEN 0 THEN ['de'] WHEN 1 THEN ['fr', 'en', 'de'] ELSE ['es', 'en', 'xx', 'fr', 'de'] END AS states FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)),
a AS (SELECT question_id, unnest(states) AS state, generate_subscripts(states, 1) AS pos, CAST({budget} AS BIGINT) AS budget FROM l),
k AS (SELECT a.question_id, state, budget, pos, v.doc_id, row_number() OVER (PARTITION BY a.question_id, state ORDER BY {_COS} DESC, v.doc_id) AS r FROM a JOIN embeddings q ON q.vec_id = a.question_id JOIN v ON v.lang = a.state WHERE v.embedding IS NOT NULL),
b AS (SELECT a.question_id, state, budget, pos, s.doc_id, row_number() OVER (PARTITION BY a.question_id, state ORDER BY round(score, 9) DESC, s.doc_id) AS r FROM a JOIN s USING (question_id) JOIN v ON v.doc_id = s.doc_id AND v.lang = a.state),
fu AS (SELECT question_id, state, budget, pos, doc_id, sum(1.0 / (60 + r)) AS score, min((src, r)) AS first FROM (SELECT *, 0 AS src FROM k WHERE r <= 3 * budget UNION ALL SELECT *, 1 FROM b WHERE r <= 3 * budget) GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY question_id, state ORDER BY round(score, 12) DESC, first, doc_id) AS n FROM fu)
SELECT question_id, state, doc_id AS record_id, round(score, 6) AS score, CAST(n AS INTEGER) AS state_rank, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, pos, n) AS INTEGER) AS rank FROM g WHERE n <= budget"""


def _state_hits(spark, d, mode):
    docs = spread(t(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("lang").alias("state"), "text")).join(v_vectors(spark, d).select("record_id", "vector"), "record_id", "left")
    return retrieve.hybrid_by_state(v_state_questions(spark, d), docs, {"text": 1.5}, "record_id", mode).withColumn("score", F.round("score", 6))


@register("hybrid_by_state", _states_sql("CASE WHEN len(states) <= 2 THEN 6 WHEN len(states) <= 4 THEN 4 ELSE 3 END"))
def hybrid_by_state(spark, d):
    return _state_hits(spark, d, "research")


@register("hybrid_comparison", _states_sql("3"))
def hybrid_comparison(spark, d):
    return _state_hits(spark, d, "comparison")


@register("hybrid_fees", _states_sql("CASE WHEN len(states) = 1 THEN 10 ELSE 10 // len(states) + 1 END"))
def hybrid_fees(spark, d):
    return _state_hits(spark, d, "fees")


#: Fields of the boosted search, out of a document's lines.
_FIELDS = {f: i for i, f in enumerate(BOOSTS) if f != "raw_text"}


def _ten_sql() -> str:
    sql = _bm25_sql(BOOSTS, 5).replace("FROM documents", "FROM fields")
    lines = ", ".join(f"coalesce(list_extract(string_split(text, chr(10)), {i + 1}), '') AS {f}" for f, i in _FIELDS.items())
    return sql.replace("WITH f AS", f"WITH fields AS (SELECT doc_id, text AS raw_text, {lines} FROM documents), f AS", 1)


@register("bm25_ten_fields", _ten_sql())
def bm25_ten_fields(spark, d):
    """All ten boosted fields: a document's first lines, and its whole text."""
    line = lambda i: F.coalesce(F.get(F.split("text", "\n"), F.lit(i)), F.lit(""))
    docs = spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.col("text").alias("raw_text"), *[line(i).alias(f) for f, i in _FIELDS.items()])
    scores = retrieve.bm25(v_questions(spark, d), docs, BOOSTS).withColumn("score", F.round("score", 6))
    return retrieve.ranked(scores, "doc_id", 5).select("question_id", "doc_id", "score", "rank")


def v_context_hits(spark, d):
    """Documents as hits of 50 questions, a few of whose fields are empty."""
    n = F.col("doc_id")
    hits = t(spark, d, "documents").filter("doc_id % 50 <> 7").select((n % 50).alias("question_id"), n.alias("rank"), F.when(n % 4 > 0, F.col("lang")).alias("state"), F.format_string("doc_%d.pdf", n).alias("filename"), F.when(n % 3 > 0, F.concat(F.lit("Rule "), n.cast("string"))).otherwise("").alias("section"),
        (n % 9).cast("int").alias("page_number"), F.array((n % 9).cast("int"), (n % 9 + 1).cast("int")).alias("page_numbers"), (1 / (n + 60)).alias("score"), F.when(n % 2 == 0, F.array(F.lit("§ 1"), F.concat(F.lit("§ "), n.cast("string")))).alias("statute_codes"), F.col("source").alias("abstract"), F.when(n % 5 > 0, "keep").alias("core_rule"), F.col("text").alias("raw_text"))
    questions = spark.range(50).select(F.col("id").alias("question_id"), F.array(F.lit("fr"), F.lit("de"), F.lit("en")).alias("states"))
    return hits, questions


_HITS = """h AS (SELECT doc_id % 50 AS question_id, doc_id AS rank, CASE WHEN doc_id % 4 > 0 THEN lang END AS state, '---' || chr(10) || 'STATE: ' || CASE WHEN doc_id % 4 > 0 THEN lang ELSE 'MS' END || chr(10) || 'SOURCE: doc_' || doc_id || '.pdf (Section: ' || CASE WHEN doc_id % 3 > 0 THEN 'Rule ' || doc_id ELSE 'N/A' END || ', {pages})' || chr(10)
  || 'RELEVANCE SCORE: ' || printf('%.4f', 1.0::DOUBLE / (doc_id + 60)) || chr(10) || 'STATUTE CODES: ' || CASE WHEN doc_id % 2 = 0 THEN '§ 1, § ' || doc_id ELSE 'None identified' END || chr(10) || chr(10) || 'SUMMARY: ' || coalesce(source, '') || chr(10) || chr(10) || 'CORE RULE: ' || CASE WHEN doc_id % 5 > 0 THEN 'keep' ELSE 'N/A' END || chr(10) || chr(10)
  || 'ORIGINAL TEXT (for precise citation):' || chr(10) || coalesce(text, '') || chr(10) || '---' AS b FROM documents WHERE doc_id % 50 <> 7)"""


@register("context_blocks", f"""
WITH {_HITS.format(pages="Page: ' || (doc_id % 9) || '")}
SELECT q AS question_id, md5(coalesce(string_agg(b, chr(10) ORDER BY rank), 'No relevant legal documents found for this query.')) AS h FROM range(50) r(q) LEFT JOIN h ON q = question_id GROUP BY q""")
def context_blocks(spark, d):
    hits, questions = v_context_hits(spark, d)
    return retrieve.format_context(hits, questions).select("question_id", F.md5("context").alias("h"))


@register("context_by_state", f"""
WITH {_HITS.format(pages="Pages: ' || (doc_id % 9) || ', ' || (doc_id % 9 + 1) || '")},
s AS (SELECT q, pos, state, coalesce(string_agg(b, chr(10) ORDER BY rank), 'No relevant legal documents found for this query.') AS c FROM range(50) r(q) CROSS JOIN (VALUES (1, 'fr'), (2, 'de'), (3, 'en')) v(pos, state) LEFT JOIN h ON q = question_id AND h.state = v.state GROUP BY q, pos, v.state)
SELECT q AS question_id, md5(string_agg(chr(10) || '=== ' || state || ' ===' || chr(10) || c, chr(10) ORDER BY pos)) AS h FROM s GROUP BY q""".replace("SELECT q, pos, state, coalesce", "SELECT q, pos, v.state AS state, coalesce"))
def context_by_state(spark, d):
    hits, questions = v_context_hits(spark, d)
    return retrieve.format_context(hits, questions, pages=True, states=True).select("question_id", F.md5("context").alias("h"))
