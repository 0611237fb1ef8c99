"""Counts, fees and routing (ANA-1 to ANA-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regspark import schema as S
from regspark.operators.patterns import occurrences
from regspark.operators.retrieve import small


def _asked(terms: DataFrame) -> DataFrame:
    """(term, low): asked terms beside what is looked for."""
    return terms.select("term").distinct().withColumn("low", F.lower("term"))


def term_count(terms: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", need_token: bool = True, markers: bool = True) -> DataFrame:
    """(term, key, count, pages): occurrences in each document that shares a token with the term, and the
    first 20 pages that hold it (ANA-1). Pages are told by ``[Page n]`` lines; ``markers=False`` leaves those
    lines out of the count. Any number of terms: each text is read once for a block of them."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?=\[Page \d+\])"), lambda p: F.struct(F.regexp_extract(p, r"^\[Page (\d+)\]", 1).try_cast("int").alias("page"), F.lower(p).alias("text")))
    body = F.lit(None).cast("string") if markers else F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[Page \d+\]", ""))
    asked = _asked(terms)
    found = occurrences(docs.select(key, parts.alias("parts"), body.alias("body")), asked.select(F.col("low").alias("term")), [key], body="body", need_token=need_token)
    found = found.withColumnsRenamed({"term": "low"}).join(small(asked), "low")
    return found.select("term", key, "count", F.slice("pages", 1, 20).alias("pages"))


def term_frequency(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Counts in each hit's text and abstract, with a snippet and the term's total (ANA-2)."""
    whole = F.array(F.struct(F.lit(None).cast("int").alias("page"), F.lower(F.concat_ws(" ", "text", "abstract")).alias("text")))
    asked = _asked(terms)
    found = occurrences(hits.withColumn("_parts_", whole), asked.select(F.col("low").alias("term")), hits.columns, "_parts_")
    df = found.drop("pages").withColumnsRenamed({"term": "low"}).join(small(asked), "low").drop("low").withColumn("snippet", F.substring("text", 1, 200))
    totals = df.groupBy("term").agg(F.sum("count").alias("total"))
    return df.join(small(totals), "term")


def term_by_state(freq: DataFrame) -> DataFrame:
    """Totals by state and their share of the largest (ANA-3)."""
    by = freq.groupBy("state").agg(F.sum("count").alias("total"))
    top = by.agg(F.max("total").alias("top"))
    return by.crossJoin(F.broadcast(top)).select("state", "total", (F.col("total") / F.col("top")).alias("share"))


def aggregate_fees(fees: DataFrame, states: int = 10, types: int = 20) -> DataFrame:
    """Average, largest and smallest fee by state (most rows first, ``states`` of them) and type (ANA-4).
    fees: state, fee_type, amount."""
    by = fees.groupBy("state", "fee_type").agg(F.count("*").alias("n"), F.avg("amount").alias("avg_amount"), F.max("amount").alias("max_amount"), F.min("amount").alias("min_amount"))
    per = by.groupBy("state").agg(F.sum("n").alias("state_n")).orderBy(F.desc("state_n"), "state").limit(states)
    w = Window.partitionBy("state").orderBy(F.desc("n"), "fee_type")
    return by.join(F.broadcast(per), "state").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= types).drop("r")


def fee_table(hits: DataFrame) -> DataFrame:
    """A row for each fee of each hit (ANA-5)."""
    return hits.select("state", "agency_type", "section", "page_numbers", F.col("filename").alias("source"), F.inline("fees"))


def exceeds_cap(amount, cap):
    """Whether a cap is there and exceeded (ANA-6)."""
    return F.coalesce(cap.isNotNull() & (amount > cap), F.lit(False))


def fee_line(state, fee_type, amount, cap):
    """One fee as text; the cap only if there is one (ANA-7)."""
    return F.concat(F.format_string("%s %s: $%.2f", state, fee_type, amount), F.when(F.coalesce(cap, F.lit(0.0)) != 0, F.format_string(" (cap $%.2f)", cap)).otherwise(""))


def reciprocity_rows(hits: DataFrame) -> DataFrame:
    return hits.filter((F.coalesce("reciprocity_provisions", F.lit("")) != "") | (F.size("license_categories") > 0))


def authority_chain(hits: DataFrame) -> DataFrame:
    return hits.filter(F.size("authority_references") > 0).select("state", "section", "core_rule", "authority_references")


def comparison_table(hits: DataFrame) -> DataFrame:
    provision = F.coalesce(F.nullif(F.col("core_rule"), F.lit("")), F.substring("abstract", 1, 200))
    return hits.select("state", provision.alias("provision"), F.col("filename").alias("citation"), "section", "statute_codes")


def store_stats(records: DataFrame, key: str = "doc_id", approx: bool = True) -> DataFrame:
    """Rows, rows by type and distinct documents (ANA-11)."""
    distinct = F.approx_count_distinct(key) if approx else F.count_distinct(key)
    return records.groupBy("record_type").agg(F.count("*").alias("rows"), distinct.alias("documents"))


def inventory_counts(inventory: DataFrame) -> DataFrame:
    """Counts by state, by agency type and of all, in one pass (ANA-12)."""
    cube = inventory.groupingSets([["state"], ["agency_type"], []], "state", "agency_type")
    return cube.agg(F.count("*").alias("n"), F.grouping_id("state", "agency_type").alias("level")).select("state", "agency_type", F.col("level").cast("int").alias("level"), "n")


def detect_states(text):
    """Codes of the states a question names, in table order (ANA-13): full names, or codes between spaces."""
    q = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    names = [F.when(q.contains(n), c) for c, n in S.STATES.items()] + [F.when(q.contains(f" {c.lower()} "), c) for c in S.STATES]
    return F.array_distinct(F.array_compact(F.array(*names)))


def detect_intent(text):
    """term_count, reciprocity, comparison or general, in this priority (ANA-14)."""
    q = F.lower(F.coalesce(text, F.lit("")))
    has = lambda phrases: q.rlike("|".join(phrases))
    compares = has(S.COMPARISON_PHRASES) | (F.size(detect_states(text)) >= 2)
    return F.when(has(S.COUNT_PHRASES), "term_count").when(has(S.RECIPROCITY_PHRASES), "reciprocity").when(compares, "comparison").otherwise("general")


#: Patterns that tell the term of a count question, tried in order after quoted strings.
TERM_PATTERNS = (
    r"""(?i)(?:term|word|phrase)\s+["']?(\w+)["']?""",
    r"""(?i)(?:does|do)\s+(?:the\s+)?(?:term\s+|word\s+)?["']?(\w+)["']?\s+appear""",
    r"""(?i)(?:times|occurrences?\s+of)\s+["']?(\w+)["']?""",
    r"""(?i)(?:count|frequency)\s+(?:of\s+)?["']?(\w+)["']?""",
)


def extract_term(text):
    """The term a count question asks for, or null (ANA-15)."""
    found = [F.regexp_extract(text, r"""["']([^"']+)["']""", 1)] + [F.regexp_extract(text, p, 1) for p in TERM_PATTERNS]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def resolve_states(given, text, intent):
    """The given states, else those named (home first for reciprocity), else all (ANA-16)."""
    named = detect_states(text)
    first = F.when((intent == "reciprocity") & ~F.array_contains(named, "MS"), F.array_prepend(named, "MS")).otherwise(named)
    return F.when(F.size(given) > 0, given).when(F.size(named) > 0, first).otherwise(F.array(*[F.lit(s) for s in S.STATES]))


def route(intent, mode):
    """The intent a question is routed by (ANA-17): modes override it, an unknown one is general."""
    known = F.when(intent.isin(*S.INTENTS), intent).otherwise("general_research")
    return F.when(mode == "compare", "fee_benchmarking").when(mode == "count", "term_frequency").otherwise(known)


#: Which specialist answers an intent; all others are searched.
SPECIALISTS = {"fee_comparison": "fees", "fee_benchmarking": "fees", "term_frequency": "terms", "licensing_reciprocity": "reciprocity", "statutory_authority": "authority", "license_category_compare": "comparison", "testing_requirements": "comparison", "amendment_history": "comparison"}
#: The states that are compared where none is named, in this order.
COMPARED = ("MS", "AL", "LA", "TN", "AR", "GA", "TX")


def plan_route(questions: DataFrame) -> DataFrame:
    """``questions`` with a plan (ANA-17): intent, specialist, states (an array or null), single_state, agency. Columns:
    intent, mode, extracted_states and extracted_agencies (arrays), and the user's own filter_states (an array),
    filter_state and filter_agency, which come before what was extracted."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    empty = F.array().cast("array<string>")
    intent, states = route(F.col("intent"), F.col("mode")), F.coalesce(some("filter_states"), some("extracted_states"), empty)
    known = questions.withColumn("plan_intent", intent).withColumn("_s", states)
    specialist = F.lit("search")
    for name, who in SPECIALISTS.items():
        specialist = F.when(F.col("plan_intent") == name, who).otherwise(specialist)
    named, n = F.when(F.size("_s") > 0, F.col("_s")), F.size("_s")
    is_ = lambda *names: F.col("plan_intent").isin(*names)
    every = F.array(*[F.lit(x) for x in COMPARED])
    lists = F.when(is_("fee_comparison"), named).when(is_("fee_benchmarking", "licensing_reciprocity", "license_category_compare", "testing_requirements"), F.coalesce(named, every)).when(is_("amendment_history"), F.coalesce(named, F.array(F.lit("MS"))))
    lists = lists.when(is_("term_frequency", "general_research") & (n > 1), F.col("_s"))
    given, first = F.nullif(F.col("filter_state"), F.lit("")), F.get("_s", F.lit(0))
    single = F.when(is_("term_frequency", "general_research"), F.coalesce(given, F.when(n == 1, first))).when(is_("statutory_authority"), F.coalesce(given, first))
    agency = F.coalesce(F.nullif(F.col("filter_agency"), F.lit("")), F.get("extracted_agencies", F.lit(0)))
    return known.withColumn("specialist", specialist).withColumn("plan_states", lists).withColumn("single_state", single).withColumn("agency", agency).drop("_s")


def collect_metadata(questions: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(question_id, metadata): JSON of the counts of each structure a question has (ANA-18)."""
    out = questions.select("question_id")
    for name, df in parts.items():
        out = out.join(df.groupBy("question_id").agg(F.count("*").alias(name)), "question_id", "left")
    return out.select("question_id", F.to_json(F.struct(*parts), {"ignoreNullFields": "true"}).alias("metadata"))
