"""Model stages and cleansing (EXT-1 to EXT-10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from regspark.functions.text import first_number


def model_stage(df: DataFrame, fn: Callable[[list[str]], list[str]], text: str = "text", batch: int = 3, retries: int = 3, wait: float = 0.0) -> DataFrame:
    """``df`` with ``output`` and ``error``: a caller's function over batches of texts, tried again with growing
    waits; rows of a batch that keeps failing get the first 500 characters and the error (EXT-1)."""

    @F.pandas_udf("output string, error string")
    def run(texts):
        import time

        import pandas as pd

        out: list[str | None] = []
        errors: list[str | None] = []
        values = [t or "" for t in texts]
        for at in range(0, len(values), batch):
            part, said = values[at : at + batch], None
            for attempt in range(retries):
                try:
                    got = list(fn(part))
                    if len(got) != len(part):
                        raise ValueError("the model returned another number of outputs")
                    said = None
                    break
                except Exception as e:  # a failed batch must not stop the run
                    said = str(e)
                    time.sleep(wait * (attempt + 1))
            out += got if said is None else [p[:500] for p in part]
            errors += [said] * len(part)
        return pd.DataFrame({"output": out, "error": errors})

    return df.withColumn("made", run(F.col(text))).select("*", "made.*").drop("made")


def parse_model_json(df: DataFrame, schema: str, raw: str = "raw") -> DataFrame:
    """``df`` with ``parsed`` (an array of structs) and ``parse_error``: fences and prose are stripped; an
    object becomes a list of one (EXT-2)."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.col(raw), r"(?s)^.*?```(?:json)?\s*", ""), r"(?s)\s*```.*$", ""))
    inner = F.regexp_extract(body, r"(?s)(\[.*\]|\{.*\})", 1)
    as_list = F.when(inner.startswith("["), inner).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    parsed = F.from_json(as_list, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    good = F.filter(parsed, lambda x: x.isNotNull())
    return df.withColumn("parsed", F.coalesce(good, F.array().cast(f"array<struct<{schema}>>"))).withColumn("parse_error", F.when(F.coalesce(F.size(good), F.lit(0)) <= 0, "no JSON found"))


def pages_of_results(df: DataFrame, schema: str, raw: str = "raw", pages: str = "page_numbers") -> DataFrame:
    """``df`` exploded to a row for each page that a batch's answer speaks of, with ``page_number`` and ``fields``
    (EXT-2): a list's items by their page_number (items without one go, of two the later counts), an object's by its
    own, and an object without one stands for the batch's first page. ``pages`` is the batch's array of numbers."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.col(raw), r"(?s)^.*?```(?:json)?\s*", ""), r"(?s)\s*```.*$", ""))
    listed = F.regexp_extract(body, r"(?s)(\[.*\]|\{.*\})", 1).startswith("[")
    parsed = parse_model_json(df, f"page_number: int, {schema}", raw)
    item = lambda x, i: F.struct(F.when(listed, x.page_number).otherwise(F.coalesce(x.page_number, F.get(F.col(pages), F.lit(0)))).alias("page_number"), i.alias("at"), x.alias("fields"))
    rows = parsed.select(*df.columns, F.explode(F.transform("parsed", item)).alias("r")).filter("r.page_number IS NOT NULL")
    last = rows.groupBy(*df.columns, F.col("r.page_number").alias("page_number")).agg(F.max_by("r.fields", "r.at").alias("fields"))
    return last.select(*df.columns, "page_number", "fields")


def sanitize_fees(fees, strict: bool = False):
    """Clean fees out of an array of (amount, fee_type, description, statutory_cap) texts (EXT-3): amounts
    take their first number, and rows without a positive one go; strict casts amounts or drops them."""
    number = (lambda c: c.try_cast("double")) if strict else first_number
    made = F.transform(fees, lambda f: F.struct(number(f.amount).alias("amount"), F.coalesce(f.fee_type, F.lit("other")).alias("fee_type"), f.description.alias("description"), number(f.statutory_cap).alias("statutory_cap")))
    return F.filter(made, lambda f: f.amount.isNotNull() if strict else (f.amount > 0) & ~f.amount.isNull())


def extract_rules(pages: DataFrame, text: str = "text") -> DataFrame:
    """Statute and section references and dollar amounts by patterns (EXT-6)."""
    found = lambda p: F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(p), 1))
    amounts = F.transform(found(r"\$([\d,]*\d(?:\.\d{2})?)"), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return pages.withColumn("statute_codes", found(r"(§\s?[\d.\-]+(?:\([a-z0-9]+\))?)")).withColumn("rules", found(r"((?:Rule|Chapter)\s+[\d][\d.\-A-Z]*)")).withColumn("amounts", amounts)


def embed(df: DataFrame, fn: Callable | None = None, dim: int = 1024, text: str = "text", cut: int = 8000) -> DataFrame:
    """``df`` with a unit ``vector`` (EXT-7). Without a function, hashed term counts stand in for a model."""

    @F.pandas_udf("array<float>")
    def run(texts):
        import zlib

        import numpy as np
        import pandas as pd

        def stub(t):
            v = np.zeros(dim)
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % dim] += 1
            return v

        rows = [np.asarray((fn or stub)((t or "")[:cut]), float) for t in texts]
        return pd.Series([(v / (np.linalg.norm(v) or 1.0)).astype(np.float32).tolist() for v in rows])

    return df.withColumn("vector", run(F.col(text)))


#: Prices of a model call, a batched one, a scanned page, a table page and an embedding.
PRICES = {"call": 0.005, "batch": 0.012, "ocr": 0.0015, "table": 0.015, "embedding": 0.0001}


def estimate_cost(inventory: DataFrame, pages_per_doc: int = 20) -> DataFrame:
    """One row: documents, bytes, pages and costs with and without batching (EXT-8)."""
    pages = F.col("documents") * pages_per_doc
    part = lambda s: F.floor(pages * s)
    calls = (pages - part(0.10)) / 3
    common = part(0.05) * PRICES["ocr"] + part(0.25) * PRICES["table"]
    total = inventory.agg(F.count("*").alias("documents"), F.sum("size").alias("bytes"))
    return total.select("documents", "bytes", pages.alias("pages"), calls.alias("calls"), (calls * PRICES["batch"] + common + pages * PRICES["embedding"]).alias("cost"), (pages * PRICES["call"] + common).alias("cost_unbatched"))


def run_stats(pages: DataFrame) -> DataFrame:
    """Documents, pages, extracted pages and failures (EXT-9). pages: doc_id, output, error."""
    return pages.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("pages"), F.count_if(F.col("output").isNotNull() & F.col("error").isNull()).alias("abstracts"), F.count_if(F.col("error").isNotNull()).alias("failures"))


def write_observed(pages: DataFrame, path: str) -> dict[str, int]:
    """Writes pages and returns the figures of ``run_stats``, counted on the way by Spark: nothing is read twice
    (EXT-9). Documents are told by their first page, so pages are put together by document once."""
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lit(0))) == 1
    seen = Observation("run")
    done = F.col("output").isNotNull() & F.col("error").isNull()
    counted = pages.withColumn("_first", first & F.col("doc_id").isNotNull()).observe(seen, F.count_if(F.col("_first")).alias("documents"), F.count(F.lit(1)).alias("pages"), F.count_if(done).alias("abstracts"), F.count_if(F.col("error").isNotNull()).alias("failures"))
    counted.drop("_first").write.mode("overwrite").parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}


def with_agency_name(df: DataFrame, names: DataFrame) -> DataFrame:
    """Adds agency_name of (state, agency_type) from ``names``, else the two words (EXT-10)."""
    other = F.trim(F.concat_ws(" ", "state", "agency_type"))
    return df.join(F.broadcast(names.select("state", "agency_type", F.col("agency_name").alias("known"))) if names.limit(10_001).count() <= 10_000 else names.select("state", "agency_type", F.col("agency_name").alias("known")), ["state", "agency_type"], "left").withColumn("agency_name", F.coalesce("known", other)).drop("known")
