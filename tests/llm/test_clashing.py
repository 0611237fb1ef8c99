"""Extra columns whose names the operators use inside change nothing."""

from pyspark.sql import functions as F

from regspark.llm import chat_format, lm_score, topk, toxicity

NAMES = "row key word n doc c known base model number tokens total place part rank score query_id page block digest slots label weight windows shown system new_ text_ loss first stop of h".split()


def with_names(df):
    taken = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("x").alias(n) for n in NAMES if n not in taken])


def test_chats(spark):
    df = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " * (i % 5 + 1)) for i in range(40)], "conv_id long, turn long, role string, text string")
    read = lambda d: sorted(map(str, chat_format.read_back(chat_format.format_chats(d, budget=60, history=20)).collect()))
    assert read(with_names(df)) == read(df) and read(df)


def test_top_k(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    found = lambda d: sorted(map(tuple, topk.top_k(d, F.col("vec_id") % 50 == 0).collect()))
    assert found(with_names(df)) == found(df) and len(found(df)) == 20


def test_language_model(odd):
    docs = odd.withColumn("learn", F.lit(True))
    base = lambda d: sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm_score.score(d).collect()), key=str)
    assert base(with_names(docs)) == base(docs) and len(base(docs)) == odd.count()


def test_toxicity(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.join(labels, "doc_id"))
    scores = lambda d: sorted(((r.doc_id, round(r.score, 9)) for r in toxicity.score(d, model).collect()), key=str)
    assert scores(with_names(odd)) == scores(odd) and len(scores(odd)) == odd.count()
