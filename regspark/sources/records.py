"""Inventories, record tables, manifests and other inputs (SRC-1 to SRC-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regspark import schema as S
from regspark.operators.retrieve import small


def inventory(paths: DataFrame, prefix: str = "", default_state: str = "MS", flat: str = "keep") -> DataFrame:
    """(path, state, agency_type, filename) of PDF paths (SRC-1): proposals and system files are left out; a
    path of three or more parts names state and agency, others are flat (``flat='drop'`` leaves them out)."""
    kept = paths.filter(F.lower("path").endswith(".pdf") & ~F.lower("path").contains("proposal") & ~F.col("path").contains(".DS_Store"))
    p = F.split(F.when(F.col("path").startswith(prefix), F.substring("path", len(prefix) + 1, 2**31 - 1)).otherwise(F.col("path")), "/")
    deep = F.size(p) >= 3
    out = kept.withColumn("state", F.when(deep, F.upper(p[0])).otherwise(default_state)).withColumn("agency_type", F.when(deep, F.lower(F.get(p, F.lit(1)))).otherwise("")).withColumn("filename", F.element_at(p, -1))
    return out.filter(deep) if flat == "drop" else out


def read_inventory(spark: SparkSession, root: str, **rules) -> DataFrame:
    """The inventory of a folder of files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    return inventory(files, **rules)


def read_records(spark: SparkSession, path: str, record_type: str | None = None) -> DataFrame:
    """Records with their declared schema (SRC-2); partitions of other types are not read."""
    df = spark.read.schema(S.RECORD).parquet(path)
    return df.filter(F.col("record_type") == record_type) if record_type else df


def newest(df: DataFrame, key: str, order_by: str) -> DataFrame:
    """The newest row of each key; ties by the whole row's hash, so the choice is stable."""
    w = Window.partitionBy(key).orderBy(F.desc(order_by), F.xxhash64(*df.columns))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert_records(df: DataFrame, path: str, key: str = "page_id", order_by: str = "ingested_at", partition: str = "state") -> int:
    """Writes rows over those with the same key (SRC-3), also where a key has moved to another partition, and
    returns how many were accepted. Only the partitions that hold or get any of the keys are rewritten, unless
    one of them loses its last row: then all are, for a write can't empty a partition. Meant for one writer; what
    is written stands complete in ``<path>__next`` before the table is touched, so a crash between loses nothing."""
    spark = df.sparkSession
    new = newest(df, key, order_by)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        new.write.partitionBy(partition).parquet(path)
        return spark.read.parquet(path).count()
    keys = new.select(key)
    left = old.join(keys, key, "left_semi").select(partition).distinct()
    touched = small(new.select(partition).union(left).distinct())
    merged = old.join(touched, partition, "left_semi").join(keys, key, "left_anti").unionByName(new)
    held = f"{path.rstrip('/')}__next"
    merged.write.mode("overwrite").partitionBy(partition).parquet(held)
    accepted = new.count()
    whole = not left.join(spark.read.parquet(held).select(partition).distinct(), partition, "left_anti").isEmpty()
    if whole:
        old.join(keys, key, "left_anti").unionByName(new).write.mode("overwrite").partitionBy(partition).parquet(held)
    mode = "static" if whole else "dynamic"
    spark.read.parquet(held).select(*old.columns).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(partition).parquet(path)
    return accepted


def delete_documents(df: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """All records but those of the given documents (SRC-4)."""
    return df.join(small(keys.select(key).distinct()), key, "left_anti")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's documents, flat, with their position (SRC-5)."""
    m = spark.read.schema(S.MANIFEST).option("multiLine", "true").json(path)
    e = m.select("crawl_id", F.posexplode("entries").alias("e", "entry"))
    return e.select("crawl_id", "entry.state", "entry.agency_type", (F.col("e") * F.lit(1_000_000)).alias("base"), F.posexplode("entry.documents").alias("d", "doc")).select("crawl_id", "state", "agency_type", (F.col("base") + F.col("d")).alias("position"), "doc.*")


def url_lookup(docs: DataFrame) -> DataFrame:
    """(key, url): a manifest's addresses by saved path and by filename; of a key given twice the last counts
    (SRC-5). docs: url, filename, saved_path, position."""
    keys = docs.filter("url <> ''").select("url", F.posexplode(F.array("saved_path", "filename")).alias("k", "key"), "position").filter("key <> ''")
    return keys.groupBy("key").agg(F.max_by("url", F.struct("position", "k")).alias("url"))


def write_manifest(docs: DataFrame, path: str) -> None:
    """Flat documents as nested JSON, one manifest a line."""
    entry = docs.groupBy("crawl_id", "state", "agency_type").agg(F.collect_list(F.struct("url", "filename", "saved_path", "file_hash", "size_bytes", "crawled_at")).alias("documents"))
    entry.groupBy("crawl_id").agg(F.collect_list(F.struct("state", "agency_type", "documents")).alias("entries")).write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.GOLDEN).option("multiLine", "true").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines, ordered by id (SRC-7)."""
    df.orderBy("id").write.mode("overwrite").json(path)


def skip_indexed(inventory: DataFrame, store: DataFrame, key: str = "filename", rebuild: bool = False) -> DataFrame:
    """Files that the store doesn't have yet (SRC-8)."""
    return inventory if rebuild else inventory.join(store.select(key).distinct(), key, "left_anti")


def targets(spark: SparkSession, states=None, agency_types=None, attributes: DataFrame | None = None) -> DataFrame:
    """The 21 crawl targets, filtered without regard to case (SRC-9), with the columns of ``attributes`` (a row for
    each state and agency_type at most: names, addresses, settings) where it has any for them."""
    state, agency = F.explode(F.array(*[F.lit(s) for s in S.STATES])), F.explode(F.array(*[F.lit(a) for a in S.AGENCY_TYPES]))
    df = spark.range(1).select(state.alias("state")).select("state", agency.alias("agency_type"))
    if states:
        df = df.filter(F.col("state").isin(*[s.upper() for s in states]))
    if agency_types:
        df = df.filter(F.col("agency_type").isin(*[a.lower() for a in agency_types]))
    if attributes is None:
        return df
    known = attributes.withColumn("state", F.upper("state")).withColumn("agency_type", F.lower("agency_type"))
    return df.join(known, ["state", "agency_type"], "left")


def target(targets_: DataFrame, state: str, agency_type: str) -> DataFrame:
    """The one target of a state and agency type, or none."""
    return targets_.filter((F.col("state") == state.upper()) & (F.col("agency_type") == agency_type.lower()))


def parse_listing(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(payload_id, total, position, file) of agency listings (SRC-10): a trailing ``|n`` is the total, files
    are cut at ``^``, their names after the last ``~`` and before ``|``, without quotes and brackets."""
    body = F.coalesce(F.get_json_object(payload, "$.d"), F.col(payload))
    total = F.nullif(F.regexp_extract(body, r"\|(\d+)\s*$", 1), F.lit("")).cast("long")
    names = F.transform(F.split(F.regexp_replace(body, r"\|\d+\s*$", ""), r"\^"), lambda x: F.trim(F.substring_index(F.trim(F.substring_index(x, "~", -1), F.lit("\"'[] ")), "|", 1), F.lit("\"'[] ")))
    names = F.filter(names, lambda x: x != "")
    return df.select("payload_id", F.coalesce(total, F.size(names).cast("long")).alias("total"), F.posexplode(names).alias("position", "file"))


def parse_options(df: DataFrame, html: str = "html") -> DataFrame:
    """(value, label) of a select's options with a label (SRC-11)."""
    p = r"(?is)<option[^>]*value\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</option>"
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(p), 1).alias("value"), F.regexp_extract_all(html, F.lit(p), 2).alias("label"))
    return df.select(F.inline(both)).select("value", F.trim(F.regexp_replace("label", r"(?s)<[^>]+>", "")).alias("label")).filter("label <> ''")
