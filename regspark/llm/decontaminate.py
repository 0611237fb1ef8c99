"""Benchmark decontamination by a prefix-filtered set join.

A window of an item (10 consecutive words, or all words of a shorter item) occurs in a document only if all
its words do, so at a containment of 1 the necessary prefix of a window, with its words ordered by rarity in
the documents, is its rarest word alone. Documents are joined with those words; a pair is kept if the
document is long enough around that position for a window; and the run of equal words around it is measured
exactly. A run as long as a window is a hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.common import lower_ascii, require, table

NAME = "op6_benchmark_decontamination"
WINDOW, BLOCK = 10, 256
#: Items whose words are broadcast at most; beyond, words and items are joined by shuffling.
BROADCAST_WORDS = 200_000


def words(text):
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased; null has none."""
    cut = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(cut, lambda w: w != "")


def anchors(docs: DataFrame, items: DataFrame, window: int, small: bool) -> DataFrame:
    """(anchor, item_id, pre, post, need): for each window of an item its rarest word, once for each place,
    with the item's words before and after it that a window can hold."""
    hint = F.broadcast if small else (lambda df: df)
    vocabulary = items.select(F.explode("item").alias("word")).distinct()
    counts = docs.select(F.explode("w").alias("word")).join(hint(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    placed = items.select("item_id", "item", F.posexplode("item").alias("at", "word")).join(hint(counts), "word", "left")
    ranked = placed.groupBy("item_id", "item").agg(F.sort_array(F.collect_list(F.struct("at", "word", F.coalesce("n", F.lit(0)).alias("n")))).alias("places"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("places") - window + 1, F.lit(1)))
    rarest = F.transform(starts, lambda s: F.array_min(F.transform(F.slice("places", s, window), lambda p: F.struct(p.n.alias("n"), p["at"].alias("at"), p.word.alias("word")))))
    at = F.col("r.at")
    lead = F.least(at, F.lit(window - 1))
    return ranked.select("item_id", "item", F.explode(F.array_distinct(rarest)).alias("r")).select(
        F.col("r.word").alias("anchor"),
        "item_id",
        F.slice("item", at - lead + 1, lead).alias("pre"),
        F.slice("item", at + 2, window - 1).alias("post"),
        F.least(F.lit(window), F.size("item")).alias("need"),
    )


def blocks(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, b): a document's words in blocks b.words from place b.first on, the first b.lead of
    which, and all beyond BLOCK more, are there as neighbours only. What is joined carries a block, never a
    whole text."""
    near = window - 1
    firsts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(BLOCK))

    def block(s):
        lead = F.least(s, F.lit(near))
        return F.struct(s.alias("first"), lead.alias("lead"), F.slice("w", s - lead + 1, lead + BLOCK + near).alias("words"))

    return docs.select("doc_id", "digest", F.explode(F.transform(firsts, block)).alias("b"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, digest, start, stop, item_id): runs of words (0-based, stop excluded) of a document that are
    made of an item's windows. Equal documents (same id and text) share their runs."""
    items = require(benchmark, "item_id", "text").select("item_id", words(F.col("text")).alias("item")).filter(F.size("item") > 0).distinct()
    small = items.agg(F.sum(F.size("item"))).first()[0]
    small = small is None or small <= broadcast_words
    cut = require(docs, "doc_id", "text").select("doc_id", digest(F.col("text")), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    marks = anchors(cut, items, window, small)
    parts = blocks(cut, window)
    placed = parts.select("doc_id", "digest", "b", F.posexplode("b.words").alias("q", "word")).filter((F.col("q") >= F.col("b.lead")) & (F.col("q") < F.col("b.lead") + BLOCK))
    if small:
        found = placed.join(F.broadcast(marks), F.col("word") == F.col("anchor"))
    else:  # places without words are shuffled; only those with an anchor meet their block again
        placed = placed.select("doc_id", "digest", F.col("b.first").alias("first"), "q", "word")
        again = parts.dropDuplicates(["doc_id", "digest", "b"]).select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "b")
        found = placed.join(marks, F.col("word") == F.col("anchor")).join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")) & (F.col("first") == F.col("b.first")))
    left = F.least(F.col("q"), F.size("pre"))
    right = F.least(F.size("b.words") - F.col("q") - 1, F.size("post"))
    found = found.filter(left + right + 1 >= F.col("need"))
    same = lambda a, b: a == b
    before = F.zip_with(F.slice("b.words", F.col("q") - left + 1, left), F.slice("pre", F.size("pre") - left + 1, left), same)
    after = F.zip_with(F.slice("b.words", F.col("q") + 2, right), F.slice("post", 1, right), same)
    back = F.array_position(F.reverse(before), F.lit(False))
    ahead = F.array_position(after, F.lit(False))
    p = F.col("b.first") - F.col("b.lead") + F.col("q")
    found = found.select(
        "doc_id", "digest", "item_id", "need", p.alias("p"),
        F.when(back == 0, left).otherwise(back - 1).alias("back"),
        (F.when(ahead == 0, right).otherwise(ahead - 1) + 1).alias("ahead"),
    ).filter(F.col("back") + F.col("ahead") >= F.col("need"))
    return found.select("doc_id", "digest", (F.col("p") - F.col("back")).cast("int").alias("start"), (F.col("p") + F.col("ahead")).cast("int").alias("stop"), "item_id").distinct()


def digest(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside a window's occurrence), n_items,
    items (sorted item ids as strings), contaminated. Null and empty texts have no words; items without words
    match nothing; an item id that is null counts as none."""
    runs = hits(docs, benchmark, window)
    # a fold over a document's runs by their start adds what each reaches beyond those before it
    spans = F.sort_array(F.collect_set(F.struct("start", "stop")))
    longer = lambda acc, r: F.struct((acc.n + F.greatest(r.stop - F.greatest(r.start, acc.reach), F.lit(0))).alias("n"), F.greatest(acc.reach, r.stop).alias("reach"))
    covered = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), longer, lambda acc: acc.n)
    per_doc = runs.groupBy("doc_id", "digest").agg(covered.alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "n_hit", "items")
    all_docs = require(docs, "doc_id", "text").select("doc_id", digest(F.col("text")), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = all_docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    bad = hits(docs, benchmark, window).select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")).distinct()
    text = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["hit_id"]) & (text == bad["hit_digest"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS need FROM i WHERE len(w) > 0),
win AS (SELECT item_id, need, list_slice(w, s, s + need - 1) AS g FROM (SELECT item_id, w, need, unnest(range(1, len(w) - need + 2)) AS s FROM n)),
sizes AS (SELECT DISTINCT need FROM n),
occ AS (SELECT doc_id, s, need, list_slice(w, s, s + need - 1) AS g FROM (SELECT doc_id, w, need, unnest(range(1, len(w) - need + 2)) AS s FROM d, sizes)),
hit AS (SELECT DISTINCT o.doc_id, o.s, o.need, win.item_id FROM occ o JOIN win ON o.g = win.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + need)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, coalesce(i.h, sha256('')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
