"""Schemas and fixed values of the records."""

from __future__ import annotations

from pyspark.sql import types as T

#: States, agency types, retrieval boosts, fee words, document extensions, rule words.
STATES = {"AL": "alabama", "AR": "arkansas", "GA": "georgia", "LA": "louisiana", "MS": "mississippi", "TN": "tennessee", "TX": "texas"}
AGENCY_TYPES = ("medical", "dental", "real_estate")
BOOSTS = {"statute_codes": 4.0, "authority_references": 3.5, "section": 3.0, "abstract": 2.0, "core_rule": 2.0, "raw_text": 1.5, "compliance_requirements": 1.5, "testing_requirements": 1.5, "reciprocity_provisions": 1.5, "entities": 1.0}
FEE_WORDS = ("fee", "fine", "penalty", "charge", "cost", "rate", "schedule", "amount", "renewal", "application", "examination", "late fee", "reinstatement")
DOC_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "html", "htm")
RULE_WORDS = ("rule", "rules", "regulation", "regulations", "policy", "policies", "statute", "law", "chapter", "board minutes", "board meeting", "disciplinary", "fee", "fine", "penalty", "license", "licensure", "reciprocity", "examination", "amendment", "statutory authority", "renewal", "application", "administrative code", "admin code")
COUNT_PHRASES = ("how many times", "how often", "count of", "frequency of", "number of times", "appearances of", "occurrences")
RECIPROCITY_PHRASES = ("reciprocity", "reciprocal", "moved to", "moving to", "transfer license", "licensed in another state", "holds a license in", "held a license in")
COMPARISON_PHRASES = ("compare", "comparison", "how does", "differ", "difference", "versus", " vs ", "other states", "across states")
INTENTS = ("fee_comparison", "term_frequency", "licensing_reciprocity", "fee_benchmarking", "amendment_history", "statutory_authority", "license_category_compare", "testing_requirements", "general_research")
#: Where a page's content is looked for, in this order.
CONTENT_SELECTORS = ("#doc-content", "#content", ".content", "main", "article", ".rule-text")

FEE = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("fee_type", T.StringType()), T.StructField("description", T.StringType()), T.StructField("statutory_cap", T.DoubleType())])
_TEXTS = ("record_type", "doc_id", "page_id", "filename", "state", "agency_type", "agency_name", "section", "raw_text", "abstract", "core_rule", "compliance_requirements", "testing_requirements", "reciprocity_provisions", "model")
_LISTS = ("statute_codes", "authority_references", "entities", "license_categories")
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXTS]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in _LISTS]
    + [T.StructField("page_number", T.IntegerType()), T.StructField("page_numbers", T.ArrayType(T.IntegerType())), T.StructField("fees", T.ArrayType(FEE)), T.StructField("effective_date", T.DateType()), T.StructField("is_table", T.BooleanType()), T.StructField("is_scanned", T.BooleanType()), T.StructField("ingested_at", T.TimestampType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("scope", T.StringType())]
)
MANIFEST = T.StructType([
    T.StructField("crawl_id", T.StringType()), T.StructField("started_at", T.StringType()),
    T.StructField("entries", T.ArrayType(T.StructType([
        T.StructField("state", T.StringType()), T.StructField("agency_type", T.StringType()),
        T.StructField("documents", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "filename", "saved_path", "file_hash")] + [T.StructField("size_bytes", T.LongType()), T.StructField("crawled_at", T.StringType())]))),
    ]))),
])
GOLDEN = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "pattern", "question", "ideal_answer", "source_url", "source_date_checked", "expected_state", "expected_doc_filename_substring")] + [T.StructField("in_corpus_verified", T.BooleanType())])

#: Fixed value: how a text begins whose section has a title (in Java's form, with Unicode classes).
SECTION_TITLE = r"(?iU)^\s*((?:Rule|Section|§|Chapter|Part|Article)\s+[\d§][\w.\-]*(?:\s+[\w\-]+)?)"

#: The 28 columns of a page record, and the fields that only version 2 of a record has.
PAGE_RECORD = (
    "record_type string, page_id string, doc_id string, filename string, s3_key string, page_number int, total_pages int, raw_text string, abstract_text string, core_rule string, "
    "statute_codes array<string>, compliance_requirements array<string>, legal_entities array<string>, section_identifier string, document_type string, "
    "fee_amounts array<struct<amount:double,fee_type:string,description:string,statutory_cap:double>>, effective_date date, amendment_date date, license_categories array<string>, testing_requirements string, "
    "statutory_authority_references array<string>, reciprocity_provisions string, is_table_page boolean, used_vision boolean, extraction_model string, state string, agency_type string, ingested_at timestamp"
)
VERSION_2 = ("state", "agency_type", "agency_name", "fee_amounts", "effective_date", "amendment_date", "license_categories", "testing_requirements", "statutory_authority_references", "reciprocity_provisions")
