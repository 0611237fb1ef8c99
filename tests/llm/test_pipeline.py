import corpus_pipeline as P


def test_stages_keep_columns_and_clean_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, d), f"test-{name}")
        assert docs.columns == first.columns, name
        assert docs.count() > 0.8 * first.count(), name
    assert P.STAGES[-1][1](spark, docs, d).count() == docs.count()


def test_odd_rows_pass_all_stages(spark, odd):
    docs = odd
    for name, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, "/root/testdata/sf0.001"), f"odd-{name}")
    assert docs.count() > 0


def test_run_equals_brute_force_stage_by_stage(spark, tmp_path):
    """Each stage's output against SQL, brute force or the library, on what its predecessor kept."""
    import hashlib

    import duckdb
    from tokenizers import Tokenizer

    from regspark.llm import bpe, decontaminate, langid, line_dedup
    from tests.llm.test_search import brute_classes

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = P.stored(P.identify_language(spark, docs, d), "brute-1").toPandas()
    said = langid.predict(docs, langid.fit(docs)).filter("lang_accepted").select("doc_id").toPandas()
    assert set(kept["doc_id"]) == set(said["doc_id"]) and kept["text"].str.contains(r"[^\\W\\d_]").all()
    db = duckdb.connect()

    def sql(table, query):
        db.register("documents", table)
        return db.execute(query).df().set_index("doc_id")

    lines = P.stored(P.dedup_lines(spark, spark.createDataFrame(kept, docs.schema), d), "brute-2").toPandas()
    want = sql(kept, line_dedup.ORACLE_SQL)["kept_sha256"]
    assert len(lines) == len(want) and all(hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id] and r.n_chars == len(r.text) for r in lines.itertuples())
    near = P.stored(P.dedup_documents(spark, spark.createDataFrame(lines, docs.schema), d), "brute-3").toPandas()
    words = [(r.doc_id, " ".join(decontaminate_words(r.text))) for r in lines.itertuples()]
    first, least = brute_classes([w for w in words if len(w[1].split()) >= 5]), {}
    for i, text in sorted(words):
        least.setdefault(text if len(text.split()) < 5 else first[i], i)
    assert {i for i in near["doc_id"] if len(dict(words)[i].split()) >= 5} == {i for i, c in first.items() if least[c] == i}
    db.execute(f"create view benchmark as select * from '{d}/benchmark.parquet'")
    clean = P.stored(P.decontaminate_documents(spark, spark.createDataFrame(near, docs.schema), d), "brute-4").toPandas()
    bad = sql(near, decontaminate.ORACLE_SQL)["contaminated"]
    assert set(clean["doc_id"]) == {i for i in near["doc_id"] if not bad[i]}
    library = Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    out = {r.doc_id: r for r in P.run(spark, d).collect()}
    assert set(out) == set(clean["doc_id"])
    for r in clean.itertuples():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert out[r.doc_id].n_tokens == len(ids) and out[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def decontaminate_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_run_on_an_empty_table(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = P.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_keeps_only_the_last_stage(spark):
    import os

    from regspark.llm.common import shared_dir

    def stages():
        path = shared_dir(spark).removeprefix("file:")
        return {n for n in (os.listdir(path) if os.path.isdir(path) else []) if n.startswith("pipeline-")}

    before = stages()
    P.run(spark, "/root/testdata/sf0.001")
    (left,) = stages() - before
    assert left.startswith("pipeline-bpe-")
