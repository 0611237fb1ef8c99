"""What the operators share: tables, shared scratch tables, Arrow batches, small literal tables."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an ASCII-lower-casing translation; bytes of longer UTF-8 sequences stay as they are.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@lru_cache(maxsize=1)
def temporary_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only on a local master, as in tests, may
    it be unset; a temporary folder of the process then takes its place."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = temporary_dir()
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the lineage is cut, and an executor
    that is lost takes nothing with it."""
    path = path or scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def bounded_batches(df: DataFrame, rows: int = 2048, size: str = "16m") -> DataFrame:
    """Keeps Arrow batches small for the session, so that a Python worker's memory doesn't grow with the
    length of texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small DataFrame out of driver values, made by SQL functions alone."""
    text = F.lit(json.dumps(rows))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator works on; others, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
