"""Queries of many terms over many texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.functions.text import tokens
from regspark.operators import analyze, segment
from regspark.plans.queries import TOK, register, spread, t, v_documents, v_pages


@register("term_totals", f"""
WITH q AS (SELECT DISTINCT unnest({TOK.format(c='text')}) AS term FROM benchmark),
d AS (SELECT doc_id, lower(text) AS low, {TOK.format(c='text')} AS words FROM documents WHERE text IS NOT NULL),
w AS (SELECT DISTINCT doc_id, unnest(words) AS term FROM d),
h AS (SELECT q.term, d.doc_id, (length(low) - length(replace(low, q.term, ''))) / length(q.term) AS n FROM q JOIN w USING (term) JOIN d USING (doc_id))
SELECT term, CAST(sum(n) AS BIGINT) AS total, count(*) AS documents FROM h GROUP BY term""")
def term_totals(spark, d):
    """Every word of the benchmark as a term: its occurrences in the documents that hold it as a word."""
    terms = t(spark, d, "benchmark").select(F.explode(tokens(F.col("text"), False)).alias("term"))
    return analyze.term_count(terms, spread(t(spark, d, "documents").select("doc_id", "text"))).groupBy("term").agg(F.sum("count").alias("total"), F.count("*").alias("documents"))


@register("term_pages", """
WITH p AS (SELECT doc_id, i AS page, lower('[Page ' || i || ']' || chr(10) || substr(text, (i - 1) * 500 + 1, 500)) AS low
  FROM (SELECT doc_id, text, unnest(range(1, greatest(CAST(ceil(length(text) / 500.0) AS BIGINT), 1) + 1)) AS i FROM documents WHERE text IS NOT NULL) WHERE trim(substr(text, (i - 1) * 500 + 1, 500)) <> ''),
h AS (SELECT term, doc_id, page, row_number() OVER (PARTITION BY term, doc_id ORDER BY page) AS r FROM p, (VALUES ('the'), ('license'), ('die'), ('que')) q(term) WHERE contains(low, term))
SELECT term, doc_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM h WHERE r <= 20 GROUP BY ALL""")
def term_pages(spark, d):
    """The first 20 pages of documents, put together from their pages, that hold each of four terms."""
    docs = segment.assemble_documents(v_pages(spark, d).filter("text IS NOT NULL"))
    terms = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("the", "license", "die", "que")])).alias("term"))
    found = analyze.term_count(terms, docs, text="full_text", need_token=False)
    return found.select("term", "doc_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages")).filter("pages <> ''")


@register("term_frequency", """
WITH q(term) AS (VALUES ('license'), ('The'), ('zuständig'), ('que')),
h AS (SELECT term, doc_id, CAST((length(low) - length(replace(low, lower(term), ''))) / length(term) AS BIGINT) AS n, left(text, 200) AS snippet FROM (SELECT doc_id, text, lower(text || ' ' || source) AS low FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), q)
SELECT doc_id, term, n, md5(snippet) AS snippet, CAST(sum(n) OVER (PARTITION BY term) AS BIGINT) AS total FROM h WHERE n > 0""")
def term_frequency(spark, d):
    hits = t(spark, d, "documents").filter("text IS NOT NULL AND source IS NOT NULL").select("doc_id", "text", F.col("source").alias("abstract"))
    terms = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("license", "The", "zuständig", "que")])).alias("term"))
    return analyze.term_frequency(hits, terms).select("doc_id", "term", F.col("count").alias("n"), F.md5("snippet").alias("snippet"), "total")


@register("answer_references", """
WITH c AS (SELECT doc_id, 'Rule ' || doc_id || '.1' AS r, 'doc_' || doc_id || '.pdf' AS f FROM documents)
SELECT doc_id AS answer_id, CAST(0 AS INTEGER) AS position, r AS reference, f AS document, 7 AS page FROM c
UNION ALL SELECT doc_id, 1, 'doc_' || doc_id || '.pdf', f, 7 FROM c UNION ALL SELECT doc_id, 2, '§ 12-' || doc_id, 'other.pdf', 1 FROM c""")
def answer_references(spark, d):
    """References by rule, file and code in answers that cite two sources and name a third one's rule in vain."""
    from regspark.operators import audit

    docs, n = v_documents(spark, d), F.col("doc_id").cast("string")
    answers = docs.select(F.col("doc_id").alias("answer_id"), F.concat(F.lit("By Rule "), n, F.lit(".1 of "), F.col("filename"), F.lit(", § 12-"), n, F.lit(" and Chapter Z, one pays")).alias("text"))
    first = docs.select(F.col("doc_id").alias("answer_id"), F.col("filename").alias("document"), F.concat(F.lit("see rule "), n, F.lit(".1 below")).alias("section"), F.array(F.lit(7), F.lit(9)).alias("pages"), F.array().cast("array<string>").alias("statute_codes"))
    second = docs.select(F.col("doc_id").alias("answer_id"), F.lit("other.pdf").alias("document"), F.lit("").alias("section"), F.array().cast("array<int>").alias("pages"), F.array(F.concat(F.lit("§ 12-"), n)).alias("statute_codes"))
    return audit.link_references(answers, first.unionByName(second))
