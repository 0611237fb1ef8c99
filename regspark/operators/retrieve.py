"""Retrieval and ranking over tables of questions (RET-2 to RET-12)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from regspark.functions.text import dot, norm, tokens
from regspark.operators import vectors
from regspark.sources.scratch import stored

#: Rows, and bytes of them as JSON, that are broadcast at most; beyond that Spark joins by shuffling.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcasts ``df`` only if it is known to be small: by its rows and by their bytes."""
    rows, total = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if rows <= limit and (total or 0) <= size else df


#: Questions with vectors that one block holds and broadcasts.
QUESTION_BLOCK = 5_000


def with_questions(records: DataFrame, questions: DataFrame, size: int = QUESTION_BLOCK) -> DataFrame:
    """Every record beside every question of a stated set, block by block of about ``size`` questions, so that
    what is broadcast has a bound and no record moves. Ranks cut to the k best are cut before their shuffle."""
    return reduce(DataFrame.unionByName, [records.crossJoin(F.broadcast(p)) for p in in_blocks(questions, size)])


def in_blocks(questions: DataFrame, size: int = QUESTION_BLOCK) -> list[DataFrame]:
    blocks = max(1, math.ceil(questions.count() / size))
    return [questions.filter(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [questions]


def bm25(questions: DataFrame, records: DataFrame, fields: dict[str, float], key: str = "doc_id", k1: float = 1.2, b: float = 0.75, stop: bool = True, kept=None) -> DataFrame:
    """(question_id, key, score): boosted sum of each field's BM25 (RET-2, RET-3). questions: question_id and
    terms, an array. Statistics cover all records, scores those that meet ``kept``, a Column. Texts are read once:
    the postings of asked terms are stored, and fields' lengths are counted on the way. Document frequencies are as many
    as asked terms and fields, and are broadcast where the terms are."""
    asked = questions.select("question_id", F.explode(F.array_distinct("terms")).alias("term"))
    terms = asked.select("term").distinct()
    few = F.broadcast if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)
    inside = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))
    seen, words = Observation(), [f"_w{i}" for i in range(len(fields))]
    cut = records.select(F.col(key), inside.alias("inside"), *[tokens(F.col(f), stop).alias(w) for f, w in zip(fields, words, strict=True)])
    cut = cut.observe(seen, *[x for w in words for x in (F.count_if(F.size(w) > 0).alias(f"n{w}"), F.sum(F.size(w)).alias(f"s{w}"))])
    long = cut.select(key, "inside", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(w).alias("t")) for f, w in zip(fields, words, strict=True)])).alias("x")).select(key, "inside", "x.field", F.size("x.t").alias("len"), F.explode("x.t").alias("term"))
    hits = stored(long.join(few(terms), "term", "left_semi").groupBy(key, "inside", "field", "len", "term").agg(F.count("*").alias("tf")), "bm25-postings")
    total = seen.get
    of = lambda f, w: F.struct(F.lit(f).alias("field"), F.lit(float(fields[f])).alias("boost"), F.lit(total[f"n{w}"] or 0).cast("long").alias("n_docs"), F.lit((total[f"s{w}"] or 0) / (total[f"n{w}"] or 1)).cast("double").alias("avg_len"))
    stats = records.sparkSession.range(1).select(F.inline(F.array(*[of(f, w) for f, w in zip(fields, words, strict=True)])))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hits.filter("inside").join(few(df), ["field", "term"]).join(F.broadcast(stats), "field").join(few(asked), "term")
    return scored.groupBy("question_id", key).agg(F.sum(F.col("boost") * idf * tf).alias("score"))


def ranked(scores: DataFrame, key: str, k: int, by: str = "score", partition: tuple = ("question_id",)) -> DataFrame:
    """The k best of each question, ties by key."""
    w = Window.partitionBy(*partition).orderBy(F.desc(by), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def near(questions: DataFrame, records: DataFrame, k: int | None, key: str = "record_id", metric: str = "cosine", min_similarity: float | None = None, digits: int | None = None, group: str | None = None, reverse: bool = False) -> DataFrame:
    """(question_id, key, score, and ``group`` if one is named): pairs among which are each question's k best, in each
    group if one is named, and no more of them than a task's k best; without k all pairs. metric: cosine, dot, or
    euclidean (a distance, less is better). Scores are rounded to ``digits`` before they count; equal ones are ordered by
    key, backwards if ``reverse``. Vectors of another length than a question's are no candidates of it."""
    names = ["question_id", key, "score", *([group] if group else [])]
    schema = vectors.schema_of(questions, records, names)
    if k is None:
        out = vectors.over(in_blocks(questions), records, [key, "vector"], schema, lambda b, ids, held: vectors.all_within(b, ids, held, metric, min_similarity, names))
        return out if digits is None else out.withColumn("score", F.round("score", digits))
    return vectors.over(in_blocks(questions), records, [key, "vector", *names[3:]], schema, lambda b, ids, held: vectors.k_best(b, ids, held, metric, k, digits, min_similarity, reverse, names))


def knn(questions: DataFrame, records: DataFrame, k: int | None, key: str = "record_id", metric: str = "cosine", min_similarity: float | None = None, digits: int | None = None) -> DataFrame:
    """(question_id, key, score, rank; without k, all of them unranked): exact neighbours among records with a vector (RET-4, PRJ-9). questions:
    question_id, q (a vector). The stated question set goes to all records in blocks. Scores are ranked as rounded to
    ``digits``. Vectors of another length than a question's are no candidates of it."""
    scored = near(questions, records, k, key, metric, min_similarity, digits)
    return scored if k is None else ranked(scored, key, k)


def count_near(questions: DataFrame, records: DataFrame, min_similarity: float, metric: str = "cosine") -> DataFrame:
    """(question_id, n): how many records reach ``min_similarity``, of questions that some do (PRJ-9). Tasks count; no pair leaves them."""
    schema = vectors.schema_of(questions, records, ["question_id"]).add("n", "long")
    parts = vectors.over(in_blocks(questions), records, ["vector"], schema, lambda b, ids, held: vectors.counted(b, ids, held, metric, min_similarity))
    return parts.groupBy("question_id").agg(F.sum("n").alias("n"))


def rrf(rankings: list[DataFrame], key: str, k: int = 60, top_k=5, by: tuple = ("question_id",)) -> DataFrame:
    """Reciprocal rank fusion (RET-6): sum of 1 / (k + rank); ties keep the first ranking's order, then the
    next one's. Rankings are those of a question, or of whatever ``by`` names; top_k, a Column of them or number."""
    parts = None
    for i, r in enumerate(rankings):
        part = r.select(*by, key, F.col("rank").alias("r"), F.lit(i).alias("source"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy(*by, key).agg(F.sum(1.0 / (k + F.col("r"))).alias("score"), F.min(F.struct("source", "r")).alias("first"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("first"), F.asc(key))
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).select(*by, key, "score", "rank")


def hybrid(questions: DataFrame, records: DataFrame, fields: dict[str, float], key: str, top_k: int = 5, stop: bool = True, **filters) -> DataFrame:
    """Fuses the 3 x top_k best by vector and by text (RET-7) among the records that meet ``filters`` (as in
    ``project.condition``). questions: question_id, terms, q. Text scores are ranked by nine places, so that
    the order in which they were summed doesn't matter."""
    from regspark.operators.project import condition

    pool, kept = 3 * top_k, condition(**filters)
    said = bm25(questions, records, fields, key, stop=stop, kept=kept).withColumn("score", F.round("score", 9))
    return rrf([knn(questions, records.filter(kept), pool, key), ranked(said, key, pool)], key, top_k=top_k)


def state_budget(n_states, mode: str = "research", top_k: int = 10):
    """Hits for each state: 6 up to two states, 4 up to four, else 3; in mode ``comparison`` 3 each, in mode
    ``fees`` an equal share of top_k and one more (all of top_k for one state)."""
    if mode == "comparison":
        return F.lit(3)
    if mode == "fees":
        return F.when(n_states <= 1, top_k).otherwise(F.floor(top_k / n_states).cast("int") + 1)
    return F.when(n_states <= 2, 6).when(n_states <= 4, 4).otherwise(3)


def hybrid_by_state(questions: DataFrame, records: DataFrame, fields: dict[str, float], key: str, mode: str = "research", top_k: int = 10, stop: bool = True) -> DataFrame:
    """(question_id, state, key, score, state_rank, rank): hybrid search in each state that a question asks for
    (RET-8). questions: question_id, terms, q, states (an array). Both rankings are scored once for all states and
    cut to three times a state's budget, then fused per state; a question's hits are ordered by score, equal ones
    by the order of its states. States asked twice count once."""
    states = F.array_distinct("states")
    asked = questions.select("question_id", "q", states.alias("states"), state_budget(F.size(states), mode, top_k).alias("budget"))
    inside = F.array_contains("states", F.col("state"))
    value = dot(F.col("vector"), F.col("q")) / (norm(F.col("vector")) * norm(F.col("q")))
    near = with_questions(records.filter("vector IS NOT NULL AND state IS NOT NULL").select(key, "state", "vector"), asked)
    near = near.filter(inside & (F.size("vector") == F.size("q"))).select("question_id", "state", "budget", key, value.alias("score"))
    said = bm25(questions, records, fields, key, stop=stop).withColumn("score", F.round("score", 9))
    said = said.join(records.select(key, "state"), key).join(small(asked.select("question_id", "states", "budget")), "question_id").filter(inside)
    by = ("question_id", "state")
    pool = lambda df: ranked(df, key, 3 * F.col("budget"), partition=by)
    fused = rrf([pool(near), pool(said)], key, top_k=18 if mode == "research" else 3 * (top_k + 1), by=by)
    kept = fused.join(small(asked.select("question_id", "states", "budget")), "question_id").filter(F.col("rank") <= F.col("budget"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.array_position("states", F.col("state")), "rank")
    return kept.withColumn("all", F.row_number().over(order)).select("question_id", "state", key, "score", F.col("rank").alias("state_rank"), F.col("all").alias("rank"))


def by_state(scores: DataFrame, key: str, budget) -> DataFrame:
    """Cuts scored hits (question_id, state, key, score) to each state's budget, a Column or number (RET-8)."""
    w = Window.partitionBy("question_id", "state").orderBy(F.desc("score"), F.asc(key))
    kept = scores.withColumn("state_rank", F.row_number().over(w)).filter(F.col("state_rank") <= budget)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc(key))
    return kept.withColumn("rank", F.row_number().over(order))


def expand(questions: DataFrame, prefix: str, text: str = "text") -> DataFrame:
    """Puts a specialist's words before each question (RET-9)."""
    return questions.withColumn(text, F.concat_ws(" ", F.lit(prefix), F.col(text)))


#: How a hit is written out for a model, a state's heading, and what is said where there is no hit.
CONTEXT_BLOCK = "---\nSTATE: %s\nSOURCE: %s (Section: %s, {}: %s)\nRELEVANCE SCORE: %.4f\nSTATUTE CODES: %s\n\nSUMMARY: %s\n\nCORE RULE: %s\n\nORIGINAL TEXT (for precise citation):\n%s\n---"
STATE_HEADING = "\n=== %s ==="
NO_HITS = "No relevant legal documents found for this query."


def context_block(pages: bool = False):
    """A hit written out (columns state, filename, section, page_number or page_numbers, score, statute_codes,
    abstract, core_rule, raw_text)."""
    some = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    page = F.array_join(F.transform(F.coalesce("page_numbers", F.array().cast("array<int>")), lambda p: p.cast("string")), ", ") if pages else F.coalesce(F.col("page_number").cast("string"), F.lit("0"))
    codes = some(F.array_join(F.coalesce("statute_codes", F.array().cast("array<string>")), ", "), "None identified")
    text = lambda name, other="": F.coalesce(name, F.lit(other))
    return F.format_string(CONTEXT_BLOCK.format("Pages" if pages else "Page"), text("state", "MS"), text("filename"), some(F.col("section"), "N/A"), page, F.col("score"), codes, text("abstract"), text("core_rule", "N/A"), text("raw_text"))


def format_context(hits: DataFrame, questions: DataFrame | None = None, pages: bool = False, states: bool = False) -> DataFrame:
    """(question_id, context): a question's hits written out in rank order (RET-11). With ``states`` they stand
    under a heading for each state, in the order of the question's states (questions: question_id, states); a state
    without hits has the fixed sentence. So has a question (of ``questions``) without hits."""
    by = ("question_id", "state") if states else ("question_id",)
    made = hits.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", context_block(pages).alias("b")))).alias("x"))
    made = made.select(*by, F.array_join(F.transform("x", lambda x: x.b), "\n").alias("context"))
    if not states:
        return made if questions is None else questions.select("question_id").join(made, "question_id", "left").select("question_id", F.coalesce("context", F.lit(NO_HITS)).alias("context"))
    asked = questions.select("question_id", F.posexplode(F.array_distinct("states")).alias("at", "state"))
    every = asked.join(made, ["question_id", "state"], "left")
    part = F.concat(F.format_string(STATE_HEADING, "state"), F.lit("\n"), F.coalesce("context", F.lit(NO_HITS)))
    return every.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", part.alias("p")))), lambda x: x.p), "\n").alias("context"))


def scope(questions: DataFrame, home: str = "MS") -> DataFrame:
    """The record set and state filters of a question's mode (RET-12): chat reads one state's records, home
    unless a state is given, and ignores the list of states."""
    chat = F.coalesce(F.col("mode"), F.lit("chat")) == "chat"
    return questions.withColumn("scope", F.when(chat, "single").otherwise("multi")).withColumn("state", F.when(chat, F.coalesce("state", F.lit(home))).otherwise(F.col("state"))).withColumn("states", F.when(~chat, F.col("states")))
