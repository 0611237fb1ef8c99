"""Queries of the versioned store, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.operators import clean, links
from regspark.plans.queries import register, t
from regspark.sources.scratch import scratch_path
from regspark.sources.store import RecordStore

SCHEMA = "doc_id long, state string, filename string, n_chars long, ingested_at long"


def _batches(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("lang").alias("state"), F.format_string("doc_%d.pdf", "doc_id").alias("filename"), "n_chars", F.lit(1).cast("long").alias("ingested_at"))
    again = docs.filter("doc_id % 7 = 0").withColumn("state", F.when(F.col("doc_id") % 2 == 0, "moved").otherwise(F.col("state"))).withColumn("n_chars", -F.col("n_chars")).withColumn("ingested_at", F.lit(2).cast("long"))
    later = again.withColumn("ingested_at", F.lit(3).cast("long")).filter("doc_id % 3 = 0").withColumn("n_chars", F.col("n_chars") * 2)
    fresh = again.withColumn("doc_id", F.col("doc_id") + 1_000_000_000).withColumn("filename", F.lit("new.pdf"))
    return docs, again.unionByName(later).unionByName(fresh)


def _filled(spark, d):
    store = RecordStore(spark, scratch_path(spark, "store"), SCHEMA, key="doc_id", buckets=16)
    first, second = _batches(spark, d)
    store.upsert(first, "one")
    store.upsert(second, "two")
    store.upsert(second.withColumn("n_chars", F.lit(0)), "two")  # a replay changes nothing
    return store


_UPSERTED = """
WITH a AS (SELECT doc_id, lang AS state, 'doc_' || doc_id || '.pdf' AS filename, n_chars, 1::BIGINT AS ingested_at FROM documents),
b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'moved' ELSE state END AS state, filename, -n_chars AS n_chars, 2::BIGINT AS ingested_at FROM a WHERE doc_id % 7 = 0),
c AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT doc_id, state, filename, n_chars * 2, 3::BIGINT FROM b WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 1000000000, state, 'new.pdf', n_chars, ingested_at FROM b),
now AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) = 1)"""


@register("store_upsert", f"{_UPSERTED} SELECT * FROM now")
def store_upsert(spark, d):
    return _filled(spark, d).read()


@register("store_versions", f"""{_UPSERTED}
SELECT 1::BIGINT AS version, state, count(*) AS records, sum(n_chars)::BIGINT AS chars FROM a GROUP BY state
UNION ALL SELECT 2, state, count(*), sum(n_chars)::BIGINT FROM now GROUP BY state
UNION ALL SELECT 3, state, count(*), sum(n_chars)::BIGINT FROM now WHERE doc_id % 5 <> 0 GROUP BY state""")
def store_versions(spark, d):
    """Records of each version, as a reader finds them that names it: two upserts and a deletion."""
    store = _filled(spark, d)
    store.delete(store.read().filter("doc_id % 5 = 0"), "three")
    parts = [store.read(v).groupBy("state").agg(F.count("*").alias("records"), F.sum("n_chars").alias("chars")).select(F.lit(v).cast("long").alias("version"), "*") for v in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("store_statistics", f"""{_UPSERTED}
SELECT state AS "group", count(*) AS rows, true AS close FROM now WHERE doc_id % 5 <> 0 GROUP BY state""")
def store_statistics(spark, d):
    """Statistics kept with the parts of two upserts and a deletion: rows, and whether the estimate of different
    documents is within two percent of a recount."""
    store = RecordStore(spark, scratch_path(spark, "store"), SCHEMA, key="doc_id", buckets=16, sketch=("state", "filename"))
    first, second = _batches(spark, d)
    store.upsert(first, "one")
    store.upsert(second, "two")
    store.delete(store.read().filter("doc_id % 5 = 0"), "three")
    exact = store.read().groupBy(F.col("state").alias("g")).agg(F.count_distinct("filename").alias("n"))
    both = store.stats().join(exact, F.col("group").eqNullSafe(F.col("g")))
    return both.select("group", "rows", (F.abs(F.col("documents") - F.col("n")) <= 0.02 * F.col("n")).alias("close"))


@register("run_observed", "SELECT count(DISTINCT user_id) AS documents, count(*) AS pages, count(*) FILTER (event_type <> 'view') AS abstracts, count(*) FILTER (event_type = 'view') AS failures FROM events")
def run_observed(spark, d):
    failed = F.col("event_type") == "view"
    pages = t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.when(~failed, "x").alias("output"), F.when(failed, "e").alias("error"))
    seen = clean.write_observed(pages, scratch_path(spark, "pages"))
    return spark.createDataFrame([seen], "documents long, pages long, abstracts long, failures long")


def v_crawls(spark, d):
    """Three crawls, ten days apart: documents come, change, go, and come back as they were."""
    docs = t(spark, d, "documents").select(F.concat(F.lit("https://h.org/"), F.col("doc_id").cast("string")).alias("url"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    there = F.when(F.col("k") == 0, F.col("doc_id") % 5 > 0).when(F.col("k") == 1, F.col("doc_id") % 7 > 0).otherwise(F.col("doc_id") % 11 > 0)
    file_hash = F.when((F.col("k") == 1) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("x"), "h")).when((F.col("k") == 2) & (F.col("doc_id") % 6 == 1), F.concat(F.lit("y"), "h")).otherwise(F.col("h"))
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, k * 10)")
    return docs.filter(there).select("k", at.alias("crawled"), "url", file_hash.alias("file_hash"), F.lit(0).alias("position"))


_CRAWLS = """
WITH c AS (SELECT k, TIMESTAMP '2024-01-01' + to_days(CAST(k * 10 AS INTEGER)) AS crawled, 'https://h.org/' || doc_id AS url, CASE WHEN k = 1 AND doc_id % 3 = 0 THEN 'x' WHEN k = 2 AND doc_id % 6 = 1 THEN 'y' ELSE '' END || md5(coalesce(text, '')) AS file_hash
  FROM documents, range(3) r(k) WHERE CASE k WHEN 0 THEN doc_id % 5 > 0 WHEN 1 THEN doc_id % 7 > 0 ELSE doc_id % 11 > 0 END)"""


def _recorded(spark, d):
    """The history after three crawls, one by one."""
    crawls = v_crawls(spark, d)
    history = spark.createDataFrame([], links.HISTORY)
    for k in range(3):
        history = links.record_changes(history, crawls.filter(F.col("k") == k), F.lit(f"2024-01-{1 + 10 * k:02d} 00:00:00").cast("timestamp"))
    return history


@register("store_at_dates", f"""{_CRAWLS}
SELECT '2024-01-05' AS day, url, file_hash FROM c WHERE k = 0 UNION ALL SELECT '2024-01-11', url, file_hash FROM c WHERE k = 1 UNION ALL SELECT '2024-02-01', url, file_hash FROM c WHERE k = 2""")
def store_at_dates(spark, d):
    history = _recorded(spark, d)
    parts = [links.store_at(history, F.lit(f"{day} 00:00:00").cast("timestamp")).select(F.lit(day).alias("day"), "url", "file_hash") for day in ("2024-01-05", "2024-01-11", "2024-02-01")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("change_summary", f"""{_CRAWLS},
p AS (SELECT coalesce(a.k, b.k + 1) AS k, a.file_hash AS now, b.file_hash AS before FROM c a FULL JOIN c b ON a.url = b.url AND a.k = b.k + 1)
SELECT time_bucket(INTERVAL 7 DAY, TIMESTAMP '2024-01-01' + to_days(CAST(k * 10 AS INTEGER)), TIMESTAMP '1970-01-01') AS week, count(*) FILTER (before IS NULL) AS added, count(*) FILTER (now <> before) AS changed, count(*) FILTER (now IS NULL) AS removed
FROM p WHERE k < 3 AND now IS DISTINCT FROM before GROUP BY 1""")
def change_summary(spark, d):
    return links.change_summary(links.history_of(v_crawls(spark, d)))
