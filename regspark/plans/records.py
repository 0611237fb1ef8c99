"""Queries of record projections, files that are written and read again, plans and source rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.functions.text import norm
from regspark.operators import analyze, audit, clean, links, project, segment
from regspark.plans.queries import register, t, v_documents, v_pages, v_results
from regspark.sources import records
from regspark.sources.scratch import scratch_path

_P = "p AS (SELECT doc_id, lang, source, n AS page_number, count(*) OVER (PARTITION BY doc_id) AS total, substr(text, CAST((n - 1) * 500 + 1 AS BIGINT), 500) AS text FROM (SELECT *, unnest(range(1, greatest(CAST(ceil(length(text) / 500.0) AS BIGINT), 1) + 1)) AS n FROM documents))"


def _extracted(spark, d):
    """What a model might have said of every other page: some fields missing, dates and fees as written."""
    pages = v_pages(spark, d).filter("(doc_id + page_number) % 2 = 0")
    n = F.col("doc_id").cast("string")
    fee = F.struct(F.concat(F.lit("Up to $"), n, F.lit(".50")).alias("amount"), F.lit(None).cast("string").alias("fee_type"), F.lit("late").alias("description"), F.lit("none").alias("statutory_cap"))
    none = F.struct(F.lit("varies").alias("amount"), F.lit("x").alias("fee_type"), F.lit("").alias("description"), F.lit("5").alias("statutory_cap"))
    return pages.select(
        F.concat_ws("_p", n, F.col("page_number").cast("string")).alias("page_id"), F.when(F.col("page_number") > 1, F.concat(F.lit("about "), n)).alias("abstract_text"), F.lit("rule").alias("core_rule"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("§ 1"), n)).alias("statute_codes"),
        F.array(fee, none).alias("fee_amounts"), F.when(F.col("doc_id") % 5 == 0, "soon").otherwise("2024-02-29").alias("effective_date"), F.when(F.col("doc_id") % 7 == 0, "statute").alias("document_type"),
    )


@register("page_record_columns", f"""
WITH {_P}, e AS (SELECT *, (doc_id + page_number) % 2 = 0 AS said FROM p)
SELECT doc_id || '_p' || page_number AS page_id, 'page' AS record_type, CAST(doc_id AS VARCHAR) AS doc_id, 'doc_' || doc_id || '.pdf' AS filename, lang || '/' || doc_id AS s3_key, CAST(page_number AS INTEGER) AS page_number, CAST(total AS INTEGER) AS total_pages, md5(text) AS raw_text,
  md5(CASE WHEN said AND page_number > 1 THEN 'about ' || doc_id ELSE substr(text, 1, 500) END) AS abstract_text, CASE WHEN said THEN 'rule' END AS core_rule, CASE WHEN said AND doc_id % 3 = 0 THEN '§ 1,' || doc_id ELSE '' END AS statute_codes,
  '' AS compliance_requirements, '' AS legal_entities, CAST(NULL AS VARCHAR) AS section_identifier, CASE WHEN said AND doc_id % 7 = 0 THEN 'statute' ELSE 'unknown' END AS document_type, CASE WHEN said THEN doc_id || '.5|other|late|' ELSE '' END AS fee_amounts,
  CASE WHEN said AND doc_id % 5 > 0 THEN '2024-02-29' END AS effective_date, CAST(NULL AS VARCHAR) AS amendment_date, '' AS license_categories, CAST(NULL AS VARCHAR) AS testing_requirements, '' AS statutory_authority_references, CAST(NULL AS VARCHAR) AS reciprocity_provisions,
  page_number % 4 = 0 AS is_table_page, false AS used_vision, CASE WHEN said THEN 'a model' ELSE '' END AS extraction_model, coalesce(lang, 'MS') AS state, coalesce(source, '') AS agency_type, '2024-03-01' AS ingested_at FROM e""")
def page_record_columns(spark, d):
    pages = v_pages(spark, d)
    n, p = F.col("doc_id").cast("string"), F.col("page_number")
    total = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_pages"))
    pages = pages.join(total, "doc_id").select(F.concat_ws("_p", n, p.cast("string")).alias("page_id"), n.alias("doc_id"), "filename", F.concat("state", F.lit("/"), n).alias("s3_key"), "page_number", "total_pages", "text", F.when(p % 4 > 0, None).otherwise(F.lit(True)).alias("has_tables"), "state", "agency_type")
    out = project.page_record_columns(pages, _extracted(spark, d), "a model", "MS", F.lit("2024-03-01 00:00:00").cast("timestamp"))
    lists = [f.name for f in out.schema if f.dataType.simpleString() == "array<string>"]
    fee = F.transform("fee_amounts", lambda f: F.concat_ws("|", f.amount.cast("string"), f.fee_type, f.description, F.coalesce(f.statutory_cap.cast("string"), F.lit(""))))
    out = out.withColumns({c: F.array_join(c, ",") for c in lists} | {"fee_amounts": F.array_join(fee, ";"), "raw_text": F.md5("raw_text"), "abstract_text": F.md5("abstract_text")})
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("effective_date", "amendment_date", "ingested_at")})


@register("hydrate_records", """
SELECT l_orderkey AS question_id, l_linenumber AS record_id, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS version, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS INTEGER) AS rank,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS state, CASE WHEN l_returnflag <> 'N' THEN l_shipdate END AS effective_date, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE '' END AS statute_codes, CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE '' END AS license_categories, CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus ELSE 'unknown' END AS document_type FROM lineitem""")
def hydrate_records(spark, d):
    n, some = F.col("l_linenumber"), F.when(F.col("l_linenumber") % 2 == 0, F.array("l_linestatus"))
    hits = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), n.alias("record_id"), F.col("l_extendedprice").alias("score"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("state"), F.col("l_shipdate").alias("effective_date"), some.alias("statute_codes"), some.alias("license_categories"), F.when(n % 3 == 0, F.col("l_linestatus")).alias("document_type"))
    out = project.hydrate_records(hits)
    return out.select("question_id", "record_id", "version", "rank", "state", "effective_date", F.array_join("statute_codes", ",").alias("statute_codes"), F.array_join("license_categories", ",").alias("license_categories"), "document_type")


@register("pages_of_results", """
WITH b AS (SELECT event_id, event_id % 4 AS k, user_id, event_type FROM events)
SELECT event_id, CAST(p AS INTEGER) AS page_number, said FROM (
  SELECT event_id, user_id AS p, event_type AS said FROM b WHERE k = 0 UNION ALL SELECT event_id, user_id + 1, 'second' FROM b WHERE k = 0 UNION ALL SELECT event_id, user_id + 2, event_type FROM b WHERE k = 1 UNION ALL SELECT event_id, user_id, event_type FROM b WHERE k = 2)""")
def pages_of_results(spark, d):
    """A list (of which one item has no page, and one page is given twice), an object with a page, one without, prose."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    item = lambda page, said: F.concat(F.lit('{"page_number": '), page, F.lit(', "said": "'), said, F.lit('"}'))
    next_, after = (F.col("user_id") + 1).cast("string"), (F.col("user_id") + 2).cast("string")
    listed = F.concat(F.lit("Sure:\n```json\n["), item(user, F.lit("first")), F.lit(", "), item(next_, F.lit("second")), F.lit(', {"said": "lost"}, '), item(user, kind), F.lit("]\n```"))
    raw = F.when(F.col("event_id") % 4 == 0, listed).when(F.col("event_id") % 4 == 1, item(after, kind)).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"said": "'), kind, F.lit('"}'))).otherwise("I can't.")
    batches = t(spark, d, "events").select("event_id", F.array(F.col("user_id").cast("int"), (F.col("user_id") + 1).cast("int")).alias("page_numbers"), raw.alias("raw"))
    return clean.pages_of_results(batches, "said: string").select("event_id", "page_number", "fields.said")


_INTENTS = ("fee_comparison", "term_frequency", "licensing_reciprocity", "fee_benchmarking", "amendment_history", "statutory_authority", "license_category_compare", "testing_requirements", "general_research", "unheard of")


@register("plan_route", f"""
WITH b AS (SELECT event_id, list_element([{", ".join(f"'{i}'" for i in _INTENTS)}], CAST(event_id % 10 AS INTEGER) + 1) AS i, CASE WHEN event_id % 11 = 0 THEN 'compare' WHEN event_id % 11 = 1 THEN 'count' ELSE 'auto' END AS mode,
  CASE event_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['TN'] ELSE ['TN', 'TX'] END AS ext, CASE WHEN event_id % 7 = 0 THEN ['GA'] ELSE [] END AS own, CASE WHEN event_id % 13 = 0 THEN 'AL' END AS one FROM events),
c AS (SELECT event_id, CASE mode WHEN 'compare' THEN 'fee_benchmarking' WHEN 'count' THEN 'term_frequency' ELSE CASE WHEN i = 'unheard of' THEN 'general_research' ELSE i END END AS intent, CASE WHEN len(own) > 0 THEN own ELSE ext END AS s, one FROM b),
a AS (SELECT *, array_to_string(s, ',') AS j, len(s) AS n, 'MS,AL,LA,TN,AR,GA,TX' AS every FROM c)
SELECT event_id, intent AS plan_intent, CASE WHEN intent IN ('fee_comparison', 'fee_benchmarking') THEN 'fees' WHEN intent = 'term_frequency' THEN 'terms' WHEN intent = 'licensing_reciprocity' THEN 'reciprocity' WHEN intent = 'statutory_authority' THEN 'authority' WHEN intent = 'general_research' THEN 'search' ELSE 'comparison' END AS specialist,
  CASE WHEN intent = 'fee_comparison' THEN nullif(j, '') WHEN intent IN ('fee_benchmarking', 'licensing_reciprocity', 'license_category_compare', 'testing_requirements') THEN coalesce(nullif(j, ''), every) WHEN intent = 'amendment_history' THEN coalesce(nullif(j, ''), 'MS') WHEN intent IN ('term_frequency', 'general_research') AND n > 1 THEN j END AS plan_states,
  CASE WHEN intent IN ('term_frequency', 'general_research') THEN coalesce(one, CASE WHEN n = 1 THEN s[1] END) WHEN intent = 'statutory_authority' THEN coalesce(one, s[1]) END AS single_state, CASE WHEN event_id % 4 = 0 THEN 'dental' WHEN event_id % 4 = 1 THEN 'medical' END AS agency FROM a""")
def plan_route(spark, d):
    n = F.col("event_id")
    pick = lambda *rows: F.when(n % 3 == 0, rows[0]).when(n % 3 == 1, rows[1]).otherwise(rows[2])
    empty = F.array().cast("array<string>")
    said = t(spark, d, "events").select(
        "event_id", F.element_at(F.array(*[F.lit(i) for i in _INTENTS]), (n % 10 + 1).cast("int")).alias("intent"), F.when(n % 11 == 0, "compare").when(n % 11 == 1, "count").otherwise("auto").alias("mode"),
        pick(empty, F.array(F.lit("TN")), F.array(F.lit("TN"), F.lit("TX"))).alias("extracted_states"), F.when(n % 4 <= 1, F.array(F.lit("medical"), F.lit("x"))).alias("extracted_agencies"), F.when(n % 7 == 0, F.array(F.lit("GA"))).alias("filter_states"), F.when(n % 13 == 0, "AL").otherwise("").alias("filter_state"), F.when(n % 4 == 0, "dental").alias("filter_agency"),
    )
    return analyze.plan_route(said).select("event_id", "plan_intent", "specialist", F.array_join("plan_states", ",").alias("plan_states"), "single_state", "agency")


@register("url_by_path", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id WHEN doc_id % 3 = 1 AND lang = 'en' THEN 'https://h.org/gac/doc_' || doc_id WHEN doc_id % 3 = 2 THEN 'v' || doc_id WHEN lang = 'de' THEN 'https://h.org/all' END AS url FROM documents""")
def url_by_path(spark, d):
    """Files by a saved path, by a name inside their path, by a state's pattern, and by none."""
    docs = v_documents(spark, d)
    n = F.col("doc_id").cast("string")
    files = docs.select("doc_id", "state", F.concat(F.lit("/data/crawled/"), F.col("state"), F.lit("/x/"), F.col("filename")).alias("path"))
    manifest = docs.filter("doc_id % 3 <> 1").select(F.concat(F.when(F.col("doc_id") % 3 == 0, "u").otherwise("v"), n).alias("url"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("crawled/"), F.col("state"), F.lit("/x/"), F.col("filename"))).otherwise("").alias("saved_path"), F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("/"), F.col("filename"))).otherwise("").alias("filename"))
    return project.source_urls(files, manifest, {"en": "https://h.org/gac/{}", "de": "https://h.org/all"}).select("doc_id", "url")


@register("source_rule_links", """
WITH k AS (SELECT page_id, page_id % 4 AS r, 'https://h.org/gac/dept' AS base FROM pages)
SELECT page_id, 'pdf' AS rule, 'https://h.org/gac/' || page_id || '.PDF' AS link, page_id || '.PDF' AS text FROM k WHERE r = 0
UNION ALL SELECT page_id, 'pdf_path', 'https://h.org/rules/pdf/' || page_id, 'one' FROM k WHERE r = 1 UNION ALL SELECT page_id, 'pdf_path', 'https://h.org/x.pdf?i=' || page_id, 'two' FROM k WHERE r = 1
UNION ALL SELECT page_id, 'department', 'https://h.org/gac/' || page_id || '-1', 'Chapter ' || page_id || '-1' FROM k WHERE r = 2 UNION ALL SELECT page_id, 'department', 'https://h.org/Download_pdf.aspx?d=' || page_id, 'Department ' || page_id || ' Full PDF' FROM k WHERE r = 2 UNION ALL SELECT page_id, 'department', 'https://h.org/f.docx', 'form' FROM k WHERE r = 2
UNION ALL SELECT page_id, 'volume', 'https://h.org/46v' || page_id || CASE WHEN page_id % 8 = 3 THEN '.docx' ELSE '.doc' END, '46V' || page_id FROM k WHERE r = 3""")
def source_rule_links(spark, d):
    i = F.col("page_id").cast("string")
    a = lambda href, text="": F.concat(F.lit('<a href="'), href, F.lit(f'">{text}</a>'))
    pdf = F.concat(a(F.concat(i, F.lit(".PDF"))), a(F.concat(i, F.lit(".PDF")), "again"), a(F.lit("y.html"), "no"))
    path = F.concat(a(F.concat(F.lit("/rules/pdf/"), i), "one"), a(F.concat(F.lit("/x.pdf?i="), i), "two"), a(F.lit("/z"), "no"))
    dept = F.concat(a(F.concat(F.lit("/gac/"), i, F.lit("-1"))), a(F.lit("/gac/other-1"), "no"), a(F.concat(F.lit("/Download_pdf.aspx?d="), i), "get it"), a(F.lit("/f.docx"), "form"))
    vol = F.concat(F.when(F.col("page_id") % 8 == 3, a(F.concat(F.lit("/46v"), i, F.lit(".docx")))).otherwise(""), F.when(F.col("page_id") % 8 == 3, a(F.concat(F.lit("/46v"), i, F.lit(".pdf")))).otherwise(""), F.when(F.col("page_id") % 8 != 3, a(F.concat(F.lit("/46v"), i, F.lit(".doc")))).otherwise(a(F.concat(F.lit("/old/46v"), i, F.lit(".doc")))))
    r = F.col("page_id") % 4
    pages = t(spark, d, "pages").select("page_id", F.lit("https://h.org/gac/dept").alias("base"), F.when(r == 0, "pdf").when(r == 1, "pdf_path").when(r == 2, "department").otherwise("volume").alias("rule"), F.when(r == 3, F.concat(F.lit("46V"), i)).otherwise(i).alias("param"), F.when(r == 0, pdf).when(r == 1, path).when(r == 2, dept).otherwise(vol).alias("html"))
    named = pages.withColumn("url", F.concat("base", F.lit("?page="), i))
    return links.source_links(named).select(F.regexp_extract("url", r"=(\d+)$", 1).cast("long").alias("page_id"), "rule", "link", "text")


@register("chapter_and_record_links", """
SELECT page_id, 'https://h.org/view/' || page_id || j AS link, 'Chapter ' || page_id || j AS text FROM pages, (VALUES ('-1'), ('-2')) v(j)
UNION ALL SELECT page_id, 'https://h.org/v?recordId=' || (page_id * 10 + j), CASE WHEN j = 1 THEN '§' || page_id || '.1' ELSE 'Ch' || page_id || '_Rule2' END FROM pages, (VALUES (1), (2)) v(j)""")
def chapter_and_record_links(spark, d):
    pages, i, n = t(spark, d, "pages"), F.col("page_id").cast("string"), F.col("page_id") * 10
    chapters = links.chapter_links(pages.select(F.col("page_id").alias("target"), F.array(F.concat(i, F.lit("-1")), F.concat(i, F.lit("-2"))).alias("chapters")), "https://h.org/view/")
    html = F.concat(F.lit("recordId="), (n + 1).cast("string"), F.lit(" recordId:"), (n + 1).cast("string"), F.lit(" recordId="), (n + 2).cast("string"))
    found = links.record_links(pages.select(i.alias("url"), i.alias("chapter"), html.alias("html"), F.concat(F.lit("Rules §"), i, F.lit(".1 and more")).alias("text")), "https://h.org/v?recordId=")
    return chapters.select(F.col("target").alias("page_id"), "link", "text").unionByName(found.select(F.col("url").cast("long").alias("page_id"), "link", "text"))


@register("manifest_entries", """
SELECT lang AS state, source AS agency_type, count(*) AS discovered, CAST(count(*) AS INTEGER) AS downloaded, md5(string_agg('f/' || doc_id || '.pdf:' || doc_id || '.pdf:' || coalesce(sha256(text), '') || ':' || coalesce(octet_length(encode(text)), 0) || ':2024-01-01', ';' ORDER BY 'f/' || doc_id || '.pdf')) AS documents
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2""")
def manifest_entries(spark, d):
    docs = t(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    files = docs.select(F.col("lang").alias("state"), F.col("source").alias("agency_type"), F.lit("u").alias("url"), F.format_string("f/%d.pdf", "doc_id").alias("saved_path"), F.col("text").alias("content"))
    targets = docs.groupBy(F.col("lang").alias("state"), F.col("source").alias("agency_type")).agg(F.count("*").alias("discovered"))
    out = links.manifest_entries(targets, files, F.lit("2024-01-01"))
    said = F.transform("documents", lambda x: F.concat_ws(":", x.saved_path, x.filename, x.file_hash, x.size_bytes.cast("string"), x.crawled_at))
    return out.select("state", "agency_type", "discovered", "downloaded", F.md5(F.array_join(said, ";")).alias("documents"))


@register("manifest_files", """
WITH x AS (SELECT doc_id, 'https://h.org/' || doc_id AS url FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT 'f/' || doc_id || '.pdf' AS key, url FROM x UNION ALL SELECT doc_id || '.pdf', url FROM x""")
def manifest_files(spark, d):
    """A manifest written as nested JSON, read again, and its addresses by saved path and filename."""
    docs = t(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    n, path = F.col("doc_id").cast("string"), scratch_path(spark, "manifest")
    flat = docs.select(F.lit("c1").alias("crawl_id"), F.col("lang").alias("state"), F.col("source").alias("agency_type"), F.concat(F.lit("https://h.org/"), n).alias("url"), F.concat(n, F.lit(".pdf")).alias("filename"), F.concat(F.lit("f/"), n, F.lit(".pdf")).alias("saved_path"), F.md5(F.coalesce("text", F.lit(""))).alias("file_hash"), F.col("n_chars").cast("long").alias("size_bytes"), F.lit("2024-01-01").alias("crawled_at"))
    records.write_manifest(flat, path)
    return records.url_lookup(records.read_manifest(spark, path))


@register("golden_files", "SELECT CAST(item_id AS VARCHAR) AS id, 'fees' AS pattern, text AS question, CAST(NULL AS VARCHAR) AS source_url, item_id % 2 = 0 AS in_corpus_verified FROM benchmark")
def golden_files(spark, d):
    """A golden set written as JSON lists, in sixteen files, and read with its declared schema."""
    path = scratch_path(spark, "golden")
    item = F.struct(F.col("item_id").cast("string").alias("id"), F.lit("fees").alias("pattern"), F.col("text").alias("question"), (F.col("item_id") % 2 == 0).alias("in_corpus_verified"), F.lit("beyond").alias("other"))
    lists = t(spark, d, "benchmark").groupBy(F.pmod("item_id", F.lit(16)).alias("part")).agg(F.to_json(F.collect_list(item)).alias("value"))
    lists.write.partitionBy("part").text(path)
    return records.read_golden(spark, path).select("id", "pattern", "question", "source_url", "in_corpus_verified")


@register("result_files", "SELECT doc_id AS id, source AS pattern, CAST(quality AS DOUBLE) AS groundedness FROM labels JOIN documents USING (doc_id)")
def result_files(spark, d):
    path = scratch_path(spark, "results")
    records.write_results(v_results(spark, d).select("id", "pattern", "groundedness"), path)
    return spark.read.schema("id long, pattern string, groundedness double").json(path)


@register("record_files", "SELECT CAST(doc_id AS VARCHAR) AS page_id, lang AS state, 'doc_' || doc_id || '.pdf' AS filename, md5(text) AS raw_text, CAST(NULL AS VARCHAR) AS section, CAST(doc_id % 5 AS INTEGER) AS page_number FROM documents WHERE doc_id % 3 > 0")
def record_files(spark, d):
    """Records of two types written by type and state; pages alone are read, with the declared schema."""
    path = scratch_path(spark, "records")
    kind = F.when(F.col("doc_id") % 3 > 0, "page").otherwise("document")
    v_documents(spark, d).select(kind.alias("record_type"), F.col("doc_id").cast("string").alias("page_id"), "state", "filename", F.col("text").alias("raw_text"), (F.col("doc_id") % 5).cast("int").alias("page_number")).write.partitionBy("record_type", "state").parquet(path)
    return records.read_records(spark, path, "page").select("page_id", "state", "filename", F.md5("raw_text").alias("raw_text"), "section", "page_number")


@register("abstract_ids", "SELECT doc_id, substr(sha256('doc_' || doc_id || '.pdf:[1, ' || (doc_id % 5 + 2) || ']:' || substr(text, 1, 500)), 1, 16) AS abstract_id FROM documents WHERE text IS NOT NULL")
def abstract_ids(spark, d):
    docs = v_documents(spark, d).filter("text IS NOT NULL")
    return docs.select("doc_id", segment.abstract_id(F.col("filename"), F.array(F.lit(1), (F.col("doc_id") % 5 + 2).cast("int")), F.col("text")).alias("abstract_id"))


@register("embed_stub", "SELECT doc_id, round(CASE WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) > 0 THEN 1.0 ELSE 0.0 END, 4) AS norm FROM documents")
def embed_stub(spark, d):
    return clean.embed(t(spark, d, "documents").select("doc_id", "text"), dim=64).select("doc_id", F.round(norm(F.col("vector")), 4).alias("norm"))


@register("eval_report", """
WITH r AS (SELECT doc_id AS id, source AS pattern, CAST(quality AS DOUBLE) AS groundedness, CAST(1 - toxic AS DOUBLE) AS inference_honesty, CAST(quality AS DOUBLE) AS correctness, CAST(1 - toxic AS DOUBLE) AS jurisdiction FROM labels JOIN documents USING (doc_id)),
s AS (SELECT *, (groundedness + inference_honesty) / 2 AS primary_score, (groundedness + inference_honesty + correctness + jurisdiction) / 4 AS overall FROM r),
v AS (SELECT 0 AS k, 'total' AS part, 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM s UNION ALL SELECT 0, 'total', 'valid', CAST(count(overall) AS DOUBLE) FROM s UNION ALL SELECT 2, 'pattern', pattern, avg(overall) FROM s GROUP BY pattern
UNION ALL SELECT 1, 'axis', name, avg(value) FROM (UNPIVOT (SELECT groundedness, inference_honesty, correctness, jurisdiction, primary_score, overall FROM s) ON groundedness, inference_honesty, correctness, jurisdiction, primary_score, overall INTO NAME name VALUE value) GROUP BY name),
w AS (SELECT 3 AS k, overall AS o, CAST(id AS VARCHAR) AS name, printf('worst %s: %.2f', CAST(id AS VARCHAR), round(overall, 2)) AS text FROM (SELECT id, overall FROM s ORDER BY overall, id LIMIT 5)),
l AS (SELECT k, -value AS o, name, printf('%s %s: %.2f', part, name, round(value, 2)) AS text FROM v UNION ALL SELECT * FROM w)
SELECT CAST(row_number() OVER (ORDER BY k, o, name) AS INTEGER) AS line, text FROM l""")
def eval_report(spark, d):
    return audit.report(v_results(spark, d))


@register("department_files", "SELECT page_id, 'https://h.org/d?pdf=' || page_id || '+PAGE%20NO.%20' || page_id || '/A%26B~C%2A' AS link, 'Department ' || page_id || ' Full PDF' AS text FROM pages WHERE page_id % 3 > 0")
def department_files(spark, d):
    """Pages of departments, of which each third one links its file."""
    i = F.col("page_id").cast("string")
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<a href="Download_pdf.aspx?i='), i, F.lit('">file</a>'))).otherwise(F.concat(F.lit('<a href="/gac/'), i, F.lit('-2">chapter</a>')))
    pages = t(spark, d, "pages").select("page_id", F.concat(F.lit("https://h.org/gac?p="), i).alias("url"), F.lit("department").alias("rule"), i.alias("param"), html.alias("html"), F.concat(F.lit("Page no. "), i, F.lit("/a&b~c*")).alias("title"))
    out = links.department_files(pages, links.source_links(pages), "https://h.org/d?pdf={dept}+{title}")
    return out.select(F.regexp_extract("url", r"=(\d+)$", 1).cast("long").alias("page_id"), "link", "text")
