"""Filters and projections (PRJ-1 to PRJ-8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark import schema as S
from regspark.functions.text import safe_date
from regspark.operators.clean import sanitize_fees
from regspark.operators.patterns import occurrences


def condition(record_type=None, state=None, agency_type=None, states=None, document=None):
    """The conjunction of the conditions that are given, or true."""
    tests = [F.col(c) == v for c, v in (("record_type", record_type), ("state", state), ("agency_type", agency_type), ("filename", document)) if v is not None]
    tests += [F.col("state").isin(*states)] if states else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def apply_filters(df: DataFrame, **given) -> DataFrame:
    """The rows that meet all conditions that are given (PRJ-1); they reach the Parquet scan."""
    return df.filter(condition(**given))


def shape_hits(df: DataFrame, text_chars: int = 600, home: str = "MS") -> DataFrame:
    """Hits with defaults: a state, lists instead of nulls, texts cut (PRJ-2)."""
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(c, empty).alias(c) for c in ("statute_codes", "authority_references", "entities") if c in df.columns]
    rest = [c for c in df.columns if c not in ("state", "text", "statute_codes", "authority_references", "entities")]
    return df.select(*rest, *lists, F.coalesce("state", F.lit(home)).alias("state"), F.substring("text", 1, text_chars).alias("text"))


def hydrate(df: DataFrame) -> DataFrame:
    """Adds the record's version (2 if it has a state) and rank from 1 within its question (PRJ-3). A record found
    twice with one score is ranked by its other columns in turn (maps, which have no order, aside)."""
    others = [f.name for f in df.schema if f.name not in ("question_id", "score", "record_id") and "map<" not in f.dataType.simpleString()]
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "record_id", *others)
    return df.withColumn("version", F.when(F.coalesce("state", F.lit("")) != "", 2).otherwise(1)).withColumn("rank", F.row_number().over(w))


def build_page_records(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """Page records: what was extracted, or the first 500 characters as abstract and no model (PRJ-4)."""
    e = extracted.select("page_id", F.col("abstract").alias("a"), F.col("model").alias("m"), *[c for c in extracted.columns if c not in ("page_id", "abstract", "model") and c not in pages.columns])
    out = pages.join(e, "page_id", "left")
    return out.withColumn("abstract", F.coalesce("a", F.substring("text", 1, 500))).withColumn("model", F.coalesce("m", F.lit(""))).drop("a", "m")


def hydrate_records(hits: DataFrame) -> DataFrame:
    """``hits`` (question_id, record_id, score and a record's fields) as results (PRJ-3): version 2 where a record has
    a state, else 1, whose version 2 fields are null; lists are empty instead of null, a document's type is unknown
    and its model empty where they aren't given; rank from 1 within the question."""
    out, new = hydrate(hits), F.col("version") == 2
    for f in hits.schema:
        value = F.col(f.name)
        if f.dataType.simpleString().startswith("array"):
            value = F.coalesce(value, F.array().cast(f.dataType))
        if f.name in ("document_type", "compression_model"):
            value = F.coalesce(value, F.lit("unknown" if f.name == "document_type" else ""))
        if f.name in S.VERSION_2:
            value = F.when(new, value)
        out = out.withColumn(f.name, value)
    return out


def page_record_columns(pages: DataFrame, extracted: DataFrame, model: str, state: str, ingested_at) -> DataFrame:
    """The 28 columns of page records (PRJ-4). pages: page_id, doc_id, filename, s3_key, page_number, total_pages,
    text, has_tables, state, agency_type; extracted: page_id and any of the extracted fields, a row for a page at most.
    Without a row a page has no model; an abstract that isn't given is the text's first 500 characters. Dates are those
    that are written as such, fees those with an amount."""
    said = {f.name for f in extracted.schema} - {"page_id"}
    e = extracted.select("page_id", F.struct(F.lit(True).alias("_any"), *sorted(said)).alias("e"))
    both = pages.join(e, "page_id", "left")
    page = {"record_type": F.lit("page"), "raw_text": F.col("text"), "is_table_page": F.coalesce("has_tables", F.lit(False)), "used_vision": F.lit(False), "extraction_model": F.when(F.col("e").isNotNull(), model).otherwise(""), "state": F.coalesce(F.nullif("state", F.lit("")), F.lit(state)), "agency_type": F.coalesce("agency_type", F.lit("")), "ingested_at": ingested_at}
    own = ("page_id", "doc_id", "filename", "s3_key", "page_number", "total_pages")

    def value(name: str, kind):
        if name in page or name in own:
            return page.get(name, F.col(name) if name in own else None)
        got = F.col(f"e.{name}") if name in said else F.lit(None)
        if name == "abstract_text":
            return F.coalesce(got, F.substring("text", 1, 500))
        if name in ("effective_date", "amendment_date"):
            return safe_date(got.cast("string"))
        if name == "fee_amounts" and name in said:
            got = sanitize_fees(got)
        if name == "document_type":
            return F.coalesce(got, F.lit("unknown"))
        return F.coalesce(got.cast(kind), F.array().cast(kind)) if kind.simpleString().startswith("array") else got

    return both.select(*[value(f.name, f.dataType).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(S.PAGE_RECORD)])


def to_citations(hits: DataFrame) -> DataFrame:
    """Document, section, pages, codes, score to three places, state, agency (PRJ-5)."""
    return hits.select("question_id", F.col("filename").alias("document"), "section", F.coalesce("page_numbers", F.array().cast("array<int>")).alias("pages"), "statute_codes", F.round("score", 3).alias("relevance"), "state", "agency_type")


def citation_text(document, section, pages):
    """``doc, section (pp. 1, 2)`` (PRJ-6)."""
    pp = F.when(F.size(pages) > 0, F.concat(F.lit(" (pp. "), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "), F.lit(")"))).otherwise("")
    return F.concat(document, F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", "), section)).otherwise(""), pp)


def resolve_keys(requests: DataFrame, inventory: DataFrame) -> DataFrame:
    """(request_id, key): the first candidate path of a file that the inventory has (PRJ-7): the hinted state
    and agency, that state's other agencies, the flat path; without a state all states and agencies."""
    agencies = F.array(*[F.lit(a) for a in S.AGENCY_TYPES])
    hinted = F.array_compact(F.array(F.when(F.col("state").isNotNull() & F.col("agency_type").isNotNull(), F.concat_ws("/", F.upper("state"), F.lower("agency_type"), "filename"))))
    own = F.when(F.col("state").isNotNull(), F.transform(agencies, lambda a: F.concat_ws("/", F.upper("state"), a, "filename"))).otherwise(
        F.flatten(F.transform(F.array(*[F.lit(s) for s in S.STATES]), lambda s: F.transform(agencies, lambda a: F.concat_ws("/", s, a, F.col("filename"))))))
    names = F.when(F.col("state").isNotNull(), F.concat(hinted, own, F.array("filename"))).otherwise(F.concat(F.array("filename"), own))
    tried = requests.select("request_id", F.posexplode(names).alias("priority", "key"))
    return tried.join(inventory.select(F.col("path").alias("key")).distinct(), "key").groupBy("request_id").agg(F.min_by("key", "priority").alias("key"))


def source_urls(files: DataFrame, manifest: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """``files`` (state, filename or path) with a url (PRJ-8): the manifest's, whose saved path or filename the
    file's path holds, the manifest's first if several do; else the state's pattern, in which {} stands for the
    name without extension. manifest: url and filename, saved_path or both. Manifest keys meet paths in an automaton."""
    path = "path" if "path" in files.columns else "filename"
    names = [c for c in ("saved_path", "filename") if c in manifest.columns]
    listed = manifest.filter("url <> ''").withColumn("_at", F.col("position") if "position" in manifest.columns else F.monotonically_increasing_id())
    keys = listed.select("url", F.posexplode(F.array(*names)).alias("_k", "term"), (F.col("_at") * 2 + F.col("_k")).alias("_order")).filter("term <> ''")
    first = keys.groupBy("term").agg(F.min("_order").alias("_order"), F.max_by("url", "_order").alias("url"))  # the last given for a key, in the first's place
    asked = files.select(F.col(path).alias("_path")).distinct()
    found = occurrences(asked.withColumn("parts", F.array(F.struct(F.lit(None).cast("int").alias("page"), F.col("_path").alias("text")))), first, ["_path"])
    known = found.join(first, "term").groupBy("_path").agg(F.min_by("url", "_order").alias("known"))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    other = F.lit(None).cast("string")
    for state, p in (patterns or {}).items():
        head, _, tail = p.partition("{}")
        other = F.when(F.col("state") == state, F.concat(F.lit(head), stem, F.lit(tail)) if "{}" in p else F.lit(p)).otherwise(other)
    return files.join(known, files[path] == known["_path"], "left").withColumn("url", F.coalesce("known", other)).drop("known", "_path")
