"""Language ID by nearest centroids.

A text's vector counts hashed byte n-grams (1 to 3) of its lower-cased letters and spaces, damped by a square
root, weighted by inverse document frequency and scaled to unit length. Spherical k-means gives several
centroids per language. A text gets the language of the nearest centroid by cosine; one that is farther from
it than nearly all labelled texts of that length are is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regspark.llm.common import bounded_batches, free_name, require, stored, table

NAME = "op7_language_id"
ORACLE_SQL = None  # a trained model: tests measure held-out accuracy
DIMS = 1 << 12
#: Labelled texts a model is fitted on for each language (a documented bound); every language is learned.
SAMPLE, CENTROIDS = 600, 4
#: Languages whose cuts are broadcast at most; beyond that Spark joins by shuffling.
BROADCAST_LANGUAGES = 100_000
UNKNOWN = "und"
#: A text is rejected below this share of the cosine that its nearest centroid's own
#: labelled texts reach at least (their 2 % quantile).
REJECT_SHARE = 0.2
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}]+")


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of hashed n-gram counts, and whether each text has a letter. Works text by text, so only
    one text's n-grams are held at a time."""
    out, letters = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        text = " " + _OTHER.sub(" ", (text or "").lower()) + " "
        letters[i] = bool(_LETTER.search(text))
        b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(31337) + b[1:]
        three = two[:-1] * np.uint32(31337) + b[2:]
        for n, h in enumerate((b, two, three)):
            h = (h ^ np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(2654435761)
            out[i] += np.bincount(h >> np.uint32(20), minlength=DIMS)
    return np.sqrt(out), letters


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # a low cosine of each centroid's own texts


def clusters(points: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means; the start takes far points one after another."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(points)))]
    for _ in range(min(k, len(points)) - 1):
        picked.append(int((points @ points[picked].T).max(axis=1).argmin()))
    centers = points[picked]
    for _ in range(12):
        near = (points @ centers.T).argmax(axis=1)
        centers = unit(np.stack([points[near == j].sum(axis=0) if (near == j).any() else centers[j] for j in range(len(centers))]))
    return centers


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits on rows with a text that has letters and a language: on the ``sample`` distinct texts of each
    language whose hashes are smallest. Each language's centroids are made by a task; the driver gets those."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    w = Window.partitionBy("lang").orderBy("h")
    cuts = rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= sample).groupBy("lang").agg(F.max("h").alias("cut"))
    cuts = stored(cuts, "langid-cuts")  # a row a language; texts stay where they are unless there are very many
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_LANGUAGES else cuts
    chosen = rows.join(cuts, "lang").filter(F.col("h") <= F.col("cut")).select("lang", "text", "h").dropDuplicates(["lang", "h"])

    def run(batches):
        for b in batches:
            found, letters = vectors(b.column(1).to_pylist())
            data = [v.astype(np.float16).tobytes() for v in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(data, pa.binary()), pa.array(letters)], ["lang", "h", "v", "letters"])

    got = stored(bounded_batches(chosen).mapInArrow(run, "lang string, h long, v binary, letters boolean").filter("letters"), "langid-vectors")

    def present(batches):
        n, seen = 0, np.zeros(DIMS, np.int64)
        for b in batches:
            for v in b.column(0).to_pylist():
                n, seen = n + 1, seen + (np.frombuffer(v, np.float16) > 0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([seen.tobytes()], pa.binary())], ["n", "seen"])

    parts = bounded_batches(got.select("v")).mapInArrow(present, "n long, seen binary").collect()  # a row a task
    total = sum(r["n"] for r in parts)
    if not total:
        return Model([], np.zeros(0, int), np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros(0))
    idf = np.log((1 + total) / (1 + sum(np.frombuffer(r["seen"], np.int64) for r in parts))).astype(np.float32) + np.float32(0.05)

    def centre(group):
        import pandas as pd

        group = group.sort_values("h")
        own = unit(np.stack([np.frombuffer(v, np.float16) for v in group["v"]]).astype(np.float32) * idf)
        c = clusters(own, CENTROIDS)
        cosine = (own @ c.T).max(axis=1)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "centroids": [c.astype(np.float32).tobytes()], "least": [float(np.quantile(cosine, 0.02))]})

    made = sorted(got.select("lang", "h", "v").groupBy("lang").applyInPandas(centre, "lang string, centroids binary, least double").collect(), key=lambda r: r["lang"])
    centers = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMS) for r in made]
    size = [len(c) for c in centers]
    return Model([r["lang"] for r in made], np.repeat(np.arange(len(made)), size), np.concatenate(centers), idf, np.repeat([r["least"] for r in made], size))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1) and lang_accepted. A null text or one without letters is
    ``und`` with score 0 and not accepted; so is every text if the model has learned no language. Texts whose
    cosine is under a share of what the language's own texts reach keep their nearest language and aren't
    accepted. Rows are independent; whole texts are read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x dimensions numbers

    @F.pandas_udf("lang_pred string, lang_score double, lang_accepted boolean")
    def run(texts):
        import pandas as pd

        m, names, scores, accepted = sent.value, [], [], []
        for start in range(0, len(texts), 256):
            part = texts.iloc[start : start + 256].tolist()
            found, letters = vectors(part)
            if not m.languages:
                letters[:] = False
            else:
                cosine = unit(found * m.idf) @ m.centroids.T
                best = cosine.argmax(axis=1)
                by_lang = np.maximum.reduceat(cosine, np.searchsorted(m.of, np.arange(len(m.languages))), axis=1)
                odds = np.exp(12 * (by_lang - by_lang.max(axis=1, keepdims=True)))
                sure = odds.max(axis=1) / odds.sum(axis=1)
                near = cosine[np.arange(len(part)), best]
                far = near < REJECT_SHARE * m.least[best]
            for i in range(len(part)):
                ok = bool(letters[i])
                names.append(m.languages[m.of[best[i]]] if ok else UNKNOWN)
                scores.append(float(sure[i]) if ok else 0.0)
                accepted.append(ok and not far[i])
        return pd.DataFrame({"lang_pred": names, "lang_score": scores, "lang_accepted": accepted})

    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score", "lang_accepted")]
    found = free_name(docs, "lang_found")
    out = bounded_batches(docs).select(*[F.col(f"`{c}`") for c in keep], run(F.col(f"`{text}`")).alias(found))
    return out.select(*[F.col(f"`{c}`") for c in keep], f"{found}.*")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = require(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))
