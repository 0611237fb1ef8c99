"""Operators on hand-made rows: what the given tables don't hold."""

import json

from pyspark.sql import functions as F
from regspark import schema as S
from regspark.functions.text import first_number, match_tier, safe_date, safe_str
from regspark.operators import analyze, audit, clean, links, project, retrieve, segment
from regspark.sources import records


def one(spark, **values):
    """A row of text columns."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def test_scalar_functions(spark):
    df = spark.createDataFrame([("$1,250.00",), ("Up to 5",), ("varies",), (None,)], "a string")
    assert [r[0] for r in df.select(first_number(F.col("a"))).collect()] == [1250.0, 5.0, None, None]
    df = spark.createDataFrame([(" null ",), ("  ",), (" x ",), ("2024-02-30",), ("2024-02-29",)], "a string")
    got = df.select(safe_str(F.col("a")), safe_date(F.col("a")).cast("string")).collect()
    assert [r[0] for r in got] == [None, None, "x", "2024-02-30", "2024-02-29"] and [r[1] for r in got] == [None, None, None, None, "2024-02-29"]
    assert [r[0] for r in spark.createDataFrame([(0.06,), (0.03,), (None,)], "s double").select(match_tier(F.col("s"))).collect()] == ["strong", "moderate", "weak"]


def test_fees(spark):
    fees = [[("$1,250.00", None, "a", "$2,000"), ("varies", "late", "b", None), ("0", "x", "c", ""), (None, "y", "d", "1")]]
    df = spark.createDataFrame([(f,) for f in fees], "fees array<struct<amount string, fee_type string, description string, statutory_cap string>>")
    got = df.select(clean.sanitize_fees(F.col("fees"))).first()[0]
    assert [(r.amount, r.fee_type, r.statutory_cap) for r in got] == [(1250.0, "other", 2000.0)]


def test_model_stage_goes_on_after_failures(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "text string").coalesce(1)
    got = [(r.output, r.error) for r in clean.model_stage(df, model, batch=1).collect()]
    assert got == [("A", None), ("bad", "no"), ("", None)]


def test_model_json(spark):
    raws = ['```json\n[{"page": 1}, {"page": 2}]\n```', '{"page": 3}', "nothing", 'Sure: {"page": 4} done', "{broken", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    got = {r.id: [p.page for p in r.parsed] for r in clean.parse_model_json(df, "page: int").collect()}
    assert got[0] == [1, 2] and got[1] == [3] and got[2] == [] and got[3] == [4] and got[5] == []


def test_pages_and_sections(spark):
    pages = spark.createDataFrame([("d", 1, "Title"), ("d", 2, ""), ("d", 3, "Fees\n\n$5"), ("e", 1, None)], "doc_id string, page_number int, text string")
    docs = segment.assemble_documents(pages)
    assert docs.collect()[0].full_text == "[Page 1]\nTitle\n\n[Page 3]\nFees\n\n$5" and docs.count() == 1
    assert sorted(tuple(r) for r in segment.split_pages(docs).collect()) == [("d", 1, "Title"), ("d", 3, "Fees\n\n$5")]
    text = spark.createDataFrame([(1, "Intro\nSection 1 a\nRule 2 b"), (2, "Nothing\nSection 1 alone")], "doc_id int, full_text string")
    got = {(r.doc_id, r.section_index): r.text for r in segment.split_sections(text).collect()}
    assert got == {(1, 0): "Intro", (1, 1): "Section 1 a", (1, 2): "Rule 2 b", (2, 0): "Nothing\nSection 1 alone"}


def test_merge_sections(spark):
    df = spark.createDataFrame([(["a" * 5, "b" * 5, "c" * 30, "d"],)], "sections array<string>")
    assert segment.merge_sections(df, 20).first().chunks == ["aaaaa\n\nbbbbb", "c" * 30, "d"]


def test_grid(spark):
    cells = spark.createDataFrame([("t", 1, 1, ["Fee"]), ("t", 1, 2, ["Amount", "due"]), ("t", 2, 2, ["$5"]), ("t", 3, 1, ["Late"])], "table_id string, row int, col int, words array<string>")
    text = segment.grid_to_text(segment.cells_to_grid(cells)).first().text
    assert text == "[TABLE t]\nFee | Amount due\n" + "-" * 40 + "\nAmount due: $5\nFee: Late"


def test_grid_text_and_titles(spark):
    df = spark.createDataFrame([("t", [["Fee", "Due"], ["Late", "$5"], [" ", ""], ["one"]])], "table_id string, grid array<array<string>>")
    assert segment.grid_to_text(df).first().text == "[TABLE t]\nFee | Due\n" + "-" * 40 + "\nFee: Late, Due: $5\none"
    texts = [("Section 12A-3 Fees due", "Section 12A-3 Fees"), (" rule 4.1(b) x", "rule 4.1"), ("Part x", None), ("The Section 3", None), ("§ 7", "§ 7")]
    got = spark.createDataFrame(texts, "t string, want string").select(segment.section_title(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got


def test_html(spark):
    html = "<html><head><style>x</style></head><body><nav>menu</nav><main><p>One</p><p>Two <b>bold</b></p></main></body></html>"
    df = spark.createDataFrame([("u", html)], "url string, html string")
    assert df.select(segment.clean_html(F.col("html"))).first()[0] == "One\nTwo bold"
    assert segment.clean_html_selected(df).first().text == "One\nTwo\nbold"
    chosen = '<body>out<br><article>second</article><div class="x content"><p>in<script>no</script></p> it<img></div> out</body>'
    texts = spark.createDataFrame([(chosen,), ("<title>t</title><body>all <p>of it</body>",), ("bare",), (None,)], "html string").coalesce(1)
    assert [r.text for r in segment.clean_html_selected(texts).collect()] == ["in\nit", "all\nof it", "bare", ""]
    table = spark.createDataFrame([("| a | b |\n|---|:-:|\n| 1 | 2 |\ntext",)], "t string")
    assert table.select(segment.strip_md_tables(F.col("t"))).first()[0] == "a  |  b\n1  |  2\ntext"


def test_questions(spark):
    def ask(text):
        df = one(spark, t=text)
        return df.select(analyze.detect_intent(F.col("t")), analyze.detect_states(F.col("t")), analyze.extract_term(F.col("t"))).first()

    assert ask("How many times does 'late fee' appear?")[0] == "term_count" and ask("How many times does 'late fee' appear?")[2] == "late fee"
    assert tuple(ask("I moved to Texas")[:2]) == ("reciprocity", ["TX"])
    assert tuple(ask("Georgia and Texas rules")[:2]) == ("comparison", ["GA", "TX"]) and ask("plain question")[0] == "general"
    routed = one(spark, i="nonsense", m="compare").select(analyze.route(F.col("i"), F.col("m")), analyze.route(F.col("i"), F.lit("auto"))).first()
    assert tuple(routed) == ("fee_benchmarking", "general_research")


def test_fusion_keeps_the_first_rankings_order_on_ties(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "question_id int, record_id string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 3)], "question_id int, record_id string, rank int")
    assert [r.record_id for r in retrieve.rrf([a, b], "record_id").orderBy("rank").collect()] == ["y", "x", "z"]


def test_answers(spark):
    text = "Fact.\n[INFERENCE]: guess one\n\nMore.\n[INFERENCE]: guess two\nGrounding summary: 3 grounded, 2 inferred"
    df = spark.createDataFrame([(1, text), (2, "no line"), (3, "x\nGrounding summary: 1 grounded, 0 inferred")], "answer_id int, text string")
    assert [r.content for r in audit.inference_blocks(df).orderBy("position").collect()] == ["guess one", "guess two"]
    assert {r.answer_id: r.status for r in audit.grounding(df).collect()} == {1: "amber", 2: "red", 3: "green"}
    kinds = [r.kind for r in audit.answer_segments(df.filter("answer_id = 1")).orderBy("position").collect()]
    assert kinds.count("inference") == 2
    c = spark.createDataFrame([(1, "a.pdf", "Rule 5.1", [7], ["§ 12"]), (1, "b.pdf", None, None, None)], "answer_id int, document string, section string, pages array<int>, statute_codes array<string>")
    refs = spark.createDataFrame([(1, "See Rule 5.1 and b.pdf and § 12 and Rule 9")], "answer_id int, text string")
    assert [(r.reference, r.document, r.page) for r in audit.link_references(refs, c).orderBy("position").collect()] == [("Rule 5.1", "a.pdf", 7), ("b.pdf", "b.pdf", 1), ("§ 12", "a.pdf", 7)]


def test_rule_names(spark):
    names = ["§189.3.pdf", "540-X-22.pdf", "46v33.pdf", "038.00.04-002F.pdf", "00000050c.pdf", "0460-01.20230919.pdf", "Other.PDF"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(audit.rule_id(F.col("n"))).collect()]
    assert got == ["Rule §189.3", "Chapter 540-X-22", "Title 46, Vol. 33", "Rule 038.00.04-002F", "Regulation 00000050c", "Chapter 0460-01.20230919", "Other"]


def test_urls(spark):
    from urllib.parse import urldefrag, urljoin

    base = "https://a.org/x/y.html?q=1#f"
    hrefs = ["https://b.org/z#t", "//c.org/d", "/root", "rel/page.pdf", "?p=2", "#top", "./here"]
    got = [r[0] for r in spark.createDataFrame([(base, h) for h in hrefs], "b string, h string").select(links.normalize_url(F.col("b"), F.col("h"))).collect()]
    assert got == [urldefrag(urljoin(base, h))[0] for h in hrefs]


def test_two_tiers(spark):
    page = lambda url, *links: (url, "".join(f'<a href="{h}">{t}</a>' for h, t in links))
    pages = spark.createDataFrame([page("https://a.org/", ("/rules", "Board rules"), ("/one.pdf", "One"), ("https://else.org/rules", "rules"), ("/one.pdf", "Again")), page("https://a.org/rules", ("two.docx", "Two"), ("/one.pdf", "One"), ("/rules/more", "more rules"))], "url string, html string")
    got = links.two_tier(pages.limit(1).select("url"), pages, allowed_domains=["a.org"]).orderBy("tier", "link").collect()
    assert [(r.link, r.tier, r.source) for r in got] == [("https://a.org/one.pdf", 1, "https://a.org/"), ("https://a.org/two.docx", 2, "https://a.org/rules")]


def test_inventory_and_listing(spark):
    paths = ["in/MS/medical/a.pdf", "in/tx/Dental/B.PDF", "in/flat.pdf", "in/x/y/proposal1.pdf", "in/.DS_Store", "in/a.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = sorted((r.filename, r.state, r.agency_type) for r in records.inventory(df, prefix="in/").collect())
    assert got == [("B.PDF", "TX", "dental"), ("a.pdf", "MS", "medical"), ("flat.pdf", "MS", "")]
    assert records.inventory(df, prefix="in/", flat="drop").count() == 2
    p = spark.createDataFrame([(1, 'x~"a.pdf|1"^y~b.pdf|7'), (2, json.dumps({"d": "z~c.pdf"}))], "payload_id int, payload string")
    assert sorted((r.payload_id, r.total, r.file) for r in records.parse_listing(p).collect()) == [(1, 7, "a.pdf"), (1, 7, "b.pdf"), (2, 1, "c.pdf")]
    options = spark.createDataFrame([('<select><option value="1">One</option><option value="2"></option></select>',)], "html string")
    assert [tuple(r) for r in records.parse_options(options).collect()] == [("1", "One")]
    assert records.targets(spark).count() == 21 and records.targets(spark, ["ms"], ["Dental"]).count() == 1
    about = spark.createDataFrame([("ms", "Dental", "Board of Dental Examiners"), ("XX", "dental", "none")], "state string, agency_type string, agency_name string")
    known = records.targets(spark, attributes=about)
    assert known.count() == 21 and records.target(known, "MS", "DENTAL").first().agency_name == "Board of Dental Examiners"
    assert records.target(known, "tx", "medical").first().agency_name is None and records.target(known, "NY", "dental").count() == 0


def test_manifest_round_trip(spark, tmp_path):
    doc = {"url": "u", "filename": "f.pdf", "saved_path": "p", "file_hash": "h", "size_bytes": 3, "crawled_at": "t"}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"crawl_id": "c", "started_at": "s", "entries": [{"state": "MS", "agency_type": "medical", "documents": [doc, doc]}]}))
    flat = records.read_manifest(spark, str(path))
    assert flat.count() == 2
    records.write_manifest(flat, str(tmp_path / "out"))
    assert records.read_manifest(spark, str(tmp_path / "out")).count() == 2
    assert links.diff_manifests(flat, flat).filter("change <> 'unchanged'").count() == 0


def test_upserts_follow_moved_keys(spark, tmp_path):
    schema = "page_id string, state string, text string, ingested_at timestamp"
    row = lambda i, s, x, day: (i, s, x, __import__("datetime").datetime(2024, 1, day))
    path = str(tmp_path / "store")
    first = spark.createDataFrame([row("a", "MS", "old", 1), row("b", "TX", "b", 1), row("a", "MS", "new", 2)], schema)
    assert records.upsert_records(first, path) == 2
    assert records.upsert_records(spark.createDataFrame([row("a", "MS", "newer", 3), row("c", "MS", "c", 3)], schema), path) == 2
    assert sorted((r.page_id, r.text) for r in spark.read.parquet(path).collect()) == [("a", "newer"), ("b", "b"), ("c", "c")]
    moves = spark.createDataFrame([row("a", "TX", "moved", 4)], schema)  # leaves a row behind in its partition
    assert records.upsert_records(moves, path) == 1
    assert sorted((r.page_id, r.state) for r in spark.read.parquet(path).collect()) == [("a", "TX"), ("b", "TX"), ("c", "MS")]
    assert records.upsert_records(spark.createDataFrame([row("c", "LA", "moved", 5)], schema), path) == 1  # empties its partition
    assert sorted((r.page_id, r.state) for r in spark.read.parquet(path).collect()) == [("a", "TX"), ("b", "TX"), ("c", "LA")]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "records")
    spark.createDataFrame([("page", "MS", "f"), ("document", "TX", "g")], "record_type string, state string, filename string").write.partitionBy("record_type").parquet(path)
    df = project.apply_filters(records.read_records(spark, path, "page"), state="MS")
    plan = df.select("filename")._jdf.queryExecution().toString()
    assert "EqualTo(state,MS)" in plan and "PartitionFilters: [isnotnull(record_type" in plan and df.count() == 1
    assert len(S.RECORD.fields) >= 28


def test_plans_have_no_cartesian_product(spark):
    from regspark.plans import queries as Q

    for name in ("bm25_topk", "page_overlap", "manifest_diff", "pending"):
        plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name


def test_neighbours_by_blocks(spark):
    from regspark.operators import retrieve

    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(60, [1.0]), (61, None)]
    records = spark.createDataFrame(rows, "record_id long, vector array<double>")
    asked = records.filter("record_id < 23").selectExpr("record_id question_id", "vector q")
    whole = {tuple(r) for r in retrieve.with_questions(records, asked).select("question_id", "record_id").collect()}
    assert len(whole) == 23 * 62
    assert {tuple(r) for r in retrieve.with_questions(records, asked, 4).select("question_id", "record_id").collect()} == whole
    found = retrieve.knn(asked, records, 100).groupBy("question_id").count().collect()
    assert {r["count"] for r in found} == {60}


def test_hybrid_filters_both_sides(spark):
    from regspark.operators import retrieve

    records = spark.createDataFrame([(1, "a", "fee due", [1.0, 0.0]), (2, "b", "fee due", [1.0, 0.1]), (3, "b", "none", [0.0, 1.0])], "record_id long, state string, text string, vector array<double>")
    asked = spark.createDataFrame([(9, ["fee"], [1.0, 0.0])], "question_id long, terms array<string>, q array<double>")
    assert [r.record_id for r in retrieve.hybrid(asked, records, {"text": 1.0}, "record_id", state="b").orderBy("rank").collect()] == [2, 3]
    scores = [{r.record_id: r.score for r in retrieve.bm25(asked, records, {"text": 1.0}, "record_id", kept=k).collect()} for k in (None, F.col("state") == "b")]
    assert set(scores[0]) == {1, 2} and set(scores[1]) == {2} and scores[0][2] == scores[1][2]


def test_equal_links_are_numbered_by_page(spark, tmp_path):
    """However the rows are dealt; the query's SQL leaves the order of equal links open."""
    from regspark.registry import QUERIES

    rows = [(n, "https://x.org/a/b?page=2") for n in range(40, 0, -1)] + [(41, "https://x.org/a/b"), (42, "https://x.org/c.pdf")]
    want = {41: "b.html", 1: "b_2.html", 42: "c.pdf"} | {n: f"b_{n + 1}.html" for n in range(2, 41)}
    for parts in (1, 7):
        d = str(tmp_path / str(parts))
        spark.createDataFrame(rows, "page_id long, url string").repartition(parts).write.parquet(f"{d}/pages.parquet")
        assert {r.page_id: r.filename for r in QUERIES["assign_filenames"](spark, d).collect()} == want


def test_a_record_found_twice_is_ranked_alike_however_rows_are_dealt(spark):
    rows = [(q, 7, 1.0, f"S{n:02}", {"n": n}) for n in range(20, 0, -1) for q in (1, 2)] + [(1, 3, 1.0, "Z", None), (2, 9, 2.0, None, None)]
    hits = spark.createDataFrame(rows, "question_id int, record_id int, score double, state string, extra map<string, int>")
    want = {(1, "Z"): 1, (2, None): 1} | {(q, f"S{n:02}"): n + 1 for n in range(1, 21) for q in (1, 2)}
    for parts in (1, 7):
        assert {(r.question_id, r.state): r["rank"] for r in project.hydrate_records(hits.repartition(parts)).collect()} == want


def _neighbours(records, asked, metric):
    """(question, record): score, pair by pair."""
    import math

    def score(v, q):
        fold = lambda f: __import__("functools").reduce(lambda s, p: s + f(*p), zip(v, q, strict=True), 0.0)
        if metric == "euclidean":
            return math.sqrt(fold(lambda x, y: (x - y) * (x - y)))
        return fold(lambda x, y: x * y) / (math.sqrt(fold(lambda x, y: x * x)) * math.sqrt(fold(lambda x, y: y * y)))

    return {(n, i): score(v, q) for n, q in asked for i, v, *_ in records if len(v) == len(q)}


def test_neighbours_equal_all_pairs(spark, monkeypatch):
    """Copies, scores that are equal only when rounded, two lengths, several blocks and pieces, groups with a null."""
    import random

    from regspark.operators import retrieve, vectors

    monkeypatch.setattr(vectors, "PAIRS", 64)
    monkeypatch.setattr(vectors, "CELLS", 40)
    monkeypatch.setattr(vectors, "WAITING", 30)
    rng = random.Random(3)
    base = [[rng.choice((-1.0, 0.5, 2.0)) for _ in range(4)] for _ in range(30)]
    rows = [(i, [x * rng.choice((1.0, 3.0)) + rng.choice((0.0, 1e-8)) for x in base[i % 30]], rng.choice(("a", "b", None))) for i in range(200)]
    rows += [(200 + i, [rng.gauss(0, 1) for _ in range(3)], "a") for i in range(20)]
    records = spark.createDataFrame(rows, "record_id long, vector array<double>, state string").repartition(3)
    asked = [(i, v) for i, v, _ in rows[::9]]
    questions = spark.createDataFrame(asked, "question_id long, q array<double>")
    monkeypatch.setattr(retrieve, "in_blocks", lambda q, size=7, f=retrieve.in_blocks: f(q, size))
    state = {i: s for i, _, s in rows}
    for metric, sign in (("cosine", -1), ("euclidean", 1)):
        pairs = {p: round(x, 6) + 0.0 for p, x in _neighbours(rows, asked, metric).items()}
        for reverse in (False, True):
            for group in (None, "state"):
                want = {}
                for (q, i), x in sorted(pairs.items(), key=lambda p: (p[0][0], sign * p[1], -p[0][1] if reverse else p[0][1])):
                    if len(slot := want.setdefault((q, state[i] if group else ""), [])) < 4:
                        slot.append((i, x))
                found = {}
                for r in retrieve.near(questions, records, 4, metric=metric, digits=6, group=group, reverse=reverse).collect():
                    found.setdefault((r.question_id, r.state if group else ""), []).append((r.record_id, round(r.score, 9)))
                order = lambda p: (sign * p[1], -p[0] if reverse else p[0])
                assert {s: sorted(x, key=order)[:4] for s, x in found.items()} == {s: [(i, round(x, 9)) for i, x in v] for s, v in want.items()}, (metric, reverse, group)
    exact = _neighbours(rows, asked, "cosine")
    got = {(r.question_id, r.record_id): r.score for r in retrieve.knn(questions, records, None).collect()}
    assert got == {p: x + 0.0 for p, x in exact.items()}
    bound = sorted(exact.values())[len(exact) // 2]
    want = {p for p, x in exact.items() if x >= bound}
    assert {(r.question_id, r.record_id) for r in retrieve.knn(questions, records, None, min_similarity=bound).collect()} == want
    assert {r.question_id: r.n for r in retrieve.count_near(questions, records, bound).collect()} == {q: sum(p[0] == q for p in want) for q in {p[0] for p in want}}


def test_neighbours_of_odd_vectors(spark):
    """Nulls give no score, other odd vectors what doubles give, NaN first as in SQL; none stops the job."""
    from regspark.operators import retrieve

    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, None]), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, None), (8, []), (9, [1e-200, 0.0])]
    records = spark.createDataFrame(rows, "record_id long, vector array<double>")
    asked = records.filter("record_id IN (1, 4, 7, 8)").selectExpr("record_id question_id", "vector q")
    got = {}
    for r in retrieve.knn(asked, records, 100).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.record_id, r.score if r.score is None else str(r.score)))
    assert got == {1: [(4, "nan"), (5, "nan"), (6, "nan"), (9, "inf"), (1, "1.0"), (2, "0.0"), (3, None)], 4: [(i, "nan") for i in (1, 2, 4, 5, 6, 9)] + [(3, None)], 8: [(8, "nan")]}
    assert {r.question_id: r.n for r in retrieve.count_near(asked, records, 0.5).collect()} == {1: 5, 4: 6, 8: 1}


def test_vector_queries_on_small_odd_tables(spark, tmp_path):
    """Vectors that are null, copied, or equal when rounded; states with fewer vectors than hits; against the SQL."""
    import random

    import duckdb
    from conftest import normal
    from regspark.registry import QUERIES, SQL

    rng = random.Random(4)
    rows = [(i, [rng.choice((0.25, 0.5, 1.0)) + rng.choice((0.0, 1e-7)) for _ in range(3)], i % 7 if i % 11 else None) for i in range(405)]
    rows = [(i, None if i % 7 == 2 and i > 100 or i % 7 == 3 and i != 101 and i % 100 else v, s) for i, v, s in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("knn_topk", "knn_min_similarity", "rrf_fusion", "hybrid_budget"):
        assert normal(QUERIES[name](spark, str(tmp_path)).toPandas()) == normal(c.execute(SQL[name]).df()), name


def test_vector_queries_make_no_row_a_pair(spark):
    from regspark.registry import QUERIES

    for name in ("knn_topk", "knn_min_similarity", "rrf_fusion"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "Cartesian" not in plan and "MapInArrow" in plan, name
    plan = QUERIES["hybrid_budget"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("zip_with") == 0 and "MapInArrow" in plan
