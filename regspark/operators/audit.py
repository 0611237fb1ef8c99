"""Answer audit and evaluation (AUD-1 to AUD-11)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regspark import schema as S
from regspark.operators.clean import parse_model_json
from regspark.operators.patterns import automaton, occurrences

SUMMARY = r"(?m)^[ \t]*Grounding summary:\s*(\d+)\s+grounded,\s*(\d+)\s+inferred[ \t]*$"
BLOCK = r"(?s)\[INFERENCE\]:\s*(.*?)(?=\n\s*\n|\n\[INFERENCE\]:|\z)"


def _body(text):
    found = F.regexp_extract(text, SUMMARY, 1) != ""
    return F.when(found, F.regexp_replace(F.regexp_replace(text, SUMMARY, ""), r"\n+\z", "")).otherwise(text)


def inference_blocks(answers: DataFrame) -> DataFrame:
    """(answer_id, position, content): marked inferences in order (AUD-1)."""
    blocks = F.regexp_extract_all(_body(F.coalesce("text", F.lit(""))), F.lit(BLOCK), 1)
    return answers.select("answer_id", F.posexplode(F.transform(blocks, lambda b: F.trim(b, F.lit(" \t\r\n")))).alias("position", "content"))


def answer_segments(answers: DataFrame) -> DataFrame:
    """(answer_id, position, kind, content): the answer's text and its inferences in order."""
    marked = F.regexp_replace(_body(F.coalesce("text", F.lit(""))), BLOCK, "\u0001I$1\u0001T")
    parts = F.filter(F.split(F.concat(F.lit("T"), marked), "\u0001"), lambda p: F.char_length(p) > 1)
    rows = answers.select("answer_id", F.posexplode(parts).alias("position", "p"))
    inferred = F.col("p").startswith("I")
    content = F.substring("p", 2, 2**31 - 1)
    return rows.select("answer_id", "position", F.when(inferred, "inference").otherwise("text").alias("kind"), F.when(inferred, F.trim(content, F.lit(" \t\r\n"))).otherwise(content).alias("content"))


def grounding(answers: DataFrame) -> DataFrame:
    """Counts of the summary line and its colour (AUD-2): red if it is missing, green without inferences."""
    n = lambda i: F.coalesce(F.nullif(F.regexp_extract("text", SUMMARY, i), F.lit("")).cast("int"), F.lit(0))
    found = F.coalesce(F.regexp_extract("text", SUMMARY, 1) != "", F.lit(False))
    out = answers.select("answer_id", n(1).alias("grounded"), n(2).alias("inferred"), found.alias("found"))
    return out.withColumn("status", F.when(~F.col("found"), "red").when(F.col("inferred") == 0, "green").otherwise("amber"))


#: What a reference in an answer looks like.
REFERENCES = r"([A-Za-z0-9§.\-_]+\.pdf|§\s?[\d.\-]+(?:\([a-z0-9]+\))?|Rule\s+[\d.\-]+[A-Z]?|Chapter\s+[\d.\-A-Z]+)"


def link_references(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(answer_id, position, reference, document, page): each reference of an answer with the citation it means
    (AUD-3): equal to a file, section or code, else contained either way; page is the citation's first, or 1.
    One pattern finds references from left to right, so none overlap. An answer's references and keys meet in
    two automata, not pair by pair."""
    refs = answers.select("answer_id", F.regexp_extract_all("text", F.lit(REFERENCES), 1).alias("refs")).filter(F.size("refs") > 0)
    keys = F.array_compact(F.concat(F.array("document", "section"), F.coalesce("statute_codes", F.array().cast("array<string>"))))
    c = citations.select(F.col("answer_id").alias("a"), F.struct("document", F.try_element_at("pages", F.lit(1)).cast("int").alias("page"), F.transform(keys, lambda k: F.lower(k)).alias("keys")).alias("c"))
    c = c.groupBy("a").agg(F.collect_list("c").alias("citations"))
    both = refs.join(c, F.col("answer_id") == F.col("a")).select("answer_id", "refs", F.transform("refs", lambda r: F.lower(r)).alias("low"), "citations")

    @F.pandas_udf("array<struct<position int, document string, page int>>")
    def meant(low, citations):
        return pd.Series([_meant(list(r), list(c)) for r, c in zip(low, citations, strict=True)])

    found = both.select("answer_id", "refs", F.explode(meant("low", "citations")).alias("m"))
    return found.select("answer_id", "m.position", F.get("refs", F.col("m.position")).alias("reference"), "m.document", F.coalesce("m.page", F.lit(1)).alias("page"))


def _meant(refs: list[str], citations: list) -> list[dict]:
    """For each reference that has one: the citation of an equal key, else of a key that holds it or that it
    holds; of several the first by document and page."""
    order = lambda c: (c["document"] is not None, c["document"] or "", c["page"] is not None, c["page"] or 0)
    best: dict[str, dict] = {}
    for c in citations:
        for k in c["keys"]:
            if k and (k not in best or order(c) < order(best[k])):
                best[k] = c
    keys, asked = list(best), list(dict.fromkeys(r for r in refs if r))
    near: dict[str, set] = {r: set() for r in asked}
    if keys and asked:
        inside, around = automaton(keys), automaton(asked)
        for r in asked:
            near[r].update(keys[k] for _, k in inside.iter(r))
        for k in keys:
            for _, r in around.iter(k):
                near[asked[r]].add(k)
    out = []
    for i, r in enumerate(refs):
        if near.get(r):
            c = best[min(near[r], key=lambda k: (k != r, order(best[k])))]
            out.append({"position": i, "document": c["document"], "page": c["page"]})
    return out


def rule_id(filename):
    """A readable rule name out of a file name. The six patterns and the words before them."""
    base = F.regexp_replace(filename, r"(?i)\.pdf$", "")
    title = F.concat(F.lit("Title "), F.regexp_extract(base, r"^(\d+)v(\d+)$", 1), F.lit(", Vol. "), F.regexp_extract(base, r"^(\d+)v(\d+)$", 2))
    named = lambda w: F.concat(F.lit(f"{w} "), base)
    return (
        F.when(base.startswith("§"), named("Rule")).when(base.rlike(r"(?i)^\d{2,4}-[A-Z]-\d+$"), named("Chapter")).when(base.rlike(r"^\d+v\d+$"), title)
        .when(base.rlike(r"^\d{3}\.\d{2}"), named("Rule")).when(base.rlike(r"(?i)^\d{8}[a-z]?$"), named("Regulation")).when(base.rlike(r"^\d{4}-"), named("Chapter")).otherwise(base)
    )


def citation_label(filename, state, agency_type, agency_name=None, short: bool = False):
    """A citation's label (AUD-4): state and board names and the rule, or their short forms."""
    rule = rule_id(filename)
    if short:
        agency = F.when(F.lower(agency_type) == "medical", "Med.").when(F.lower(agency_type) == "dental", "Dent.").when(F.lower(agency_type) == "real_estate", "RE").otherwise(agency_type)
        return F.when(state.isNotNull() & agency_type.isNotNull(), F.concat(state, F.lit("/"), agency, F.lit(" — "), rule)).when(state.isNotNull(), F.concat(state, F.lit(" — "), rule)).otherwise(rule)
    name = F.coalesce(*[F.when(F.upper(state) == c, n.capitalize()) for c, n in S.STATES.items()])
    board = agency_name if agency_name is not None else F.lit(None).cast("string")
    return F.when(name.isNotNull() & board.isNotNull(), F.concat(name, F.lit(" "), board, F.lit(" — "), rule)).when(name.isNotNull(), F.concat_ws(" ", name, rule)).otherwise(rule)


def claim_summary(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims, unsupported ones and mean confidence to 3 places, 0.5 without claims (AUD-5)."""
    by = claims.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if(~F.col("supported")).alias("unsupported"), F.round(F.avg("confidence"), 3).alias("confidence"))
    return answers.select("answer_id").join(by, "answer_id", "left").select("answer_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("claims", "unsupported")], F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


AXES = ("groundedness", "inference_honesty", "correctness", "jurisdiction")


def judge_scores(raw: DataFrame) -> DataFrame:
    """Axis scores of a judge's JSON, primary (mean of the first two) and overall; nulls where it can't be
    read (AUD-6)."""
    got = parse_model_json(raw, ", ".join(f"{a}: double" for a in AXES)).withColumn("s", F.try_element_at("parsed", F.lit(1)))
    out = got.select("id", *[F.col(f"s.{a}").alias(a) for a in AXES])
    return with_means(out)


def with_means(df: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(x) for x in AXES)
    return df.withColumn("primary_score", (a + b) / 2).withColumn("overall", (a + b + c + d) / 4)


def evaluate(results: DataFrame) -> DataFrame:
    """(part, name, value): totals, means of the axes and of each pattern (AUD-7); one scan, one shuffle."""
    row = lambda part, name, x: F.struct(F.lit(part).alias("part"), name.alias("name"), x.cast("double").alias("x"))
    rows = F.array(
        row("total", F.lit("rows"), F.lit(1)),
        row("total", F.lit("valid"), F.col("overall").isNotNull()),
        *[row("axis", F.lit(a), F.col(a)) for a in (*AXES, "primary_score", "overall")],
        row("pattern", F.col("pattern"), F.col("overall")),
    )
    long = results.select(F.inline(rows))
    return long.groupBy("part", "name").agg(F.when(F.col("part") == "total", F.sum("x")).otherwise(F.avg("x")).alias("value"))


def lowest(results: DataFrame, n: int = 5) -> DataFrame:
    """The n lowest overall scores, ties by id."""
    return results.filter("overall IS NOT NULL").orderBy("overall", "id").limit(n)


def report(results: DataFrame) -> DataFrame:
    """(line, text): headline, axes, patterns from the best, the worst five (AUD-8)."""
    roll = evaluate(results)
    section = F.when(F.col("part") == "total", 0).when(F.col("part") == "axis", 1).otherwise(2)
    lines = roll.select(section.alias("s"), (-F.col("value")).alias("o"), "name", F.format_string("%s %s: %.2f", "part", "name", "value").alias("text"))
    worst = lowest(results).select(F.lit(3).alias("s"), F.col("overall").alias("o"), F.col("id").cast("string").alias("name"), F.format_string("worst %s: %.2f", F.col("id").cast("string"), "overall").alias("text"))
    return lines.unionByName(worst).select(F.row_number().over(Window.orderBy("s", "o", "name")).alias("line"), "text")


def golden_coverage(golden: DataFrame, records: DataFrame) -> DataFrame:
    """(id, hits): records of the expected state whose file name holds the expected part (AUD-9). An empty part is
    in every name, a null one in none."""
    files = records.filter("state IS NOT NULL AND filename IS NOT NULL").groupBy("state", "filename").agg(F.count("*").alias("n"))
    name = F.array(F.struct(F.lit(None).cast("int").alias("page"), F.col("filename").alias("text")))
    g = golden.select("id", F.col("expected_state").alias("state"), F.col("expected_doc_filename_substring").alias("term"))
    found = occurrences(files.withColumn("parts", name), g, ["state", "n"]).groupBy("state", "term").agg(F.sum("n").alias("n"))
    every = files.groupBy("state").agg(F.sum("n").alias("n")).select("state", F.lit("").alias("term"), "n")
    hit = g.join(found.unionByName(every), ["state", "term"]).groupBy("id").agg(F.sum("n").alias("hits"))
    return golden.select("id").join(hit, "id", "left").select("id", F.coalesce("hits", F.lit(0)).alias("hits"))


def pattern_distribution(golden: DataFrame, targets: DataFrame) -> DataFrame:
    """(pattern, n, target, missing) (AUD-10)."""
    by = golden.groupBy("pattern").agg(F.count("*").alias("n"))
    out = by.join(targets, "pattern", "full_outer").select("pattern", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce(F.col("target").cast("long"), F.lit(0).cast("long")).alias("target"))
    return out.withColumn("missing", F.greatest(F.col("target") - F.col("n"), F.lit(0).cast("long")))


def history(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each turn with the earlier ones as (role, text), without error turns (AUD-11)."""
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    kept = conversations.filter(F.coalesce(F.col("role"), F.lit("")) != "error")
    return kept.withColumn("history", F.collect_list(F.struct("role", "text")).over(w))
