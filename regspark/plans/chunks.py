"""Queries of the splitters, the whole chunker and links in all forms, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.operators import links, segment
from regspark.plans.queries import register, t, v_pages


def _rfind(mark: str, low: str, high: str) -> str:
    """SQL: the last place of a mark that lies wholly in [low, high) of text, or -1."""
    part = f"substr(text, CAST({low} + 1 AS BIGINT), CAST(greatest(least({high}, n) - ({low}), 0) AS BIGINT))"
    back = mark if mark == mark[::-1] else mark[::-1]
    quoted = "'" + back.replace("\n", "' || chr(10) || '") + "'"
    return f"CASE WHEN instr(reverse({part}), {quoted}) > 0 THEN {low} + length({part}) - instr(reverse({part}), {quoted}) + 1 - {len(mark)} ELSE -1 END"


def _split_sql(end: str, stop: str) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, text, n, CAST(0 AS BIGINT) AS start, CAST(-1 AS BIGINT) AS stop FROM d WHERE n > 0
  UNION ALL
  SELECT doc_id, text, n, CASE WHEN stop < 0 THEN start ELSE greatest(start + 1, stop - 200) END, CASE WHEN stop < 0 THEN {end} ELSE -1 END FROM w
  WHERE stop < 0 OR (greatest(start + 1, stop - 200) < n{stop})),
c AS (SELECT doc_id, start, least(stop, n) AS stop FROM w WHERE stop >= 0 AND trim(substr(text, start + 1, least(stop, n) - start), ' ' || chr(9) || chr(10) || chr(13)) <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM c"""


_PARAGRAPH = f"""CASE WHEN start + 2000 >= n THEN start + 2000 WHEN {_rfind(chr(10) * 2, "(start + 1000)", "(start + 2200)")} > start THEN {_rfind(chr(10) * 2, "(start + 1000)", "(start + 2200)")}
  WHEN {_rfind(". ", "(start + 1000)", "(start + 2100)")} > start THEN {_rfind(". ", "(start + 1000)", "(start + 2100)")} + 1 ELSE start + 2000 END"""
_MARKS = " ".join(f"WHEN {_rfind(m, 'start', '(start + 2000)')} > start + 1000 THEN {_rfind(m, 'start', '(start + 2000)')} + 2" for m in ("\n\n", *segment.SENTENCE_ENDS))


@register("size_split", _split_sql(_PARAGRAPH, ""))
def size_split(spark, d):
    return segment.size_split(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "start", "end")


@register("size_split_sentences", _split_sql(f"CASE WHEN start + 2000 >= n THEN start + 2000 {_MARKS} ELSE start + 2000 END", " AND stop - 200 < n - 200"))
def size_split_sentences(spark, d):
    return segment.size_split(t(spark, d, "documents").select("doc_id", "text"), mode="sentence").select("doc_id", "chunk_index", "start", "end")


@register("section_merge", r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
f AS (
  SELECT doc_id, s, 1 AS i, CAST([] AS VARCHAR[]) AS done, s[1] AS buf FROM d
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN buf = '' OR length(buf) + length(s[i + 1]) < 2000 THEN done ELSE list_append(done, buf) END,
    CASE WHEN buf = '' THEN s[i + 1] WHEN length(buf) + length(s[i + 1]) < 2000 THEN buf || chr(10) || chr(10) || s[i + 1] ELSE s[i + 1] END FROM f WHERE i < len(s))
SELECT doc_id, md5(array_to_string(CASE WHEN buf = '' THEN done ELSE list_append(done, buf) END, '|')) AS chunks FROM f WHERE i = len(s)""")
def section_merge(spark, d):
    docs = t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("sections"))
    return segment.merge_sections(docs).select("doc_id", F.md5(F.array_join("chunks", "|")).alias("chunks"))


@register("section_starts", """
WITH p AS (SELECT doc_id, source, generate_series AS i, chr(10) || CASE WHEN generate_series % 2 = 0 THEN 'Rule ' ELSE 'CHAPTER ' END || (doc_id + generate_series) || ' ' || source || ' ' AS part FROM documents, generate_series(1, CAST(doc_id % 4 + 2 AS BIGINT)))
SELECT doc_id, CAST(i - 1 AS INTEGER) AS section_index, trim(part, ' ' || chr(10)) AS text, CAST(coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p WHERE source IS NOT NULL""")
def section_starts(spark, d):
    """Texts that begin with a heading, two to five sections each."""
    i = lambda k: F.when(k % 2 == 0, "Rule ").otherwise("CHAPTER ")
    part = lambda k: F.concat(F.lit("\n"), i(k), (F.col("doc_id") + k).cast("string"), F.lit(" "), "source", F.lit(" "))
    text = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 4 + 2).cast("int")), part), "")
    return segment.split_sections(t(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", text.alias("full_text"))).withColumn("start", F.col("start").cast("long"))


@register("chunk_documents")
def chunk_documents(spark, d):
    """Documents' pages, each third of which begins with a heading, through the whole chunker."""
    heading = F.when(F.col("page_number") % 3 == 1, F.concat(F.lit("x\nRule "), F.col("page_number").cast("string"), F.lit(" "))).otherwise(F.lit(""))
    pages = v_pages(spark, d).select("doc_id", "page_number", F.concat(heading, F.coalesce("text", F.lit(""))).alias("text"))
    out = segment.chunk_pages(pages)
    return out.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")).withColumn("text", F.md5("text"))


#: Addresses in a page https://example.org/a/<id>/c.html?q=1, and what they mean there (None: no link).
FORMS = (
    ('href="../{i}.pdf"', "https://example.org/a/{i}.pdf"), ('href="./x/./{i}.pdf#p2"', "https://example.org/a/{i}/x/{i}.pdf"), ("href='?a=1&amp;b={i}'", "https://example.org/a/{i}/c.html?a=1&b={i}"), ("href=/q{i}.pdf", "https://example.org/q{i}.pdf"), ('href=""', None),
    ('href="  "', None), ('href="#top"', "https://example.org/a/{i}/c.html?q=1"), ('href="../../../../{i}"', "https://example.org/{i}"), ('href="//h.org/{i}/.."', "https://h.org/{i}/.."), ('HREF="http&#58;//k.org/&eacute;{i}"', "http://k.org/é{i}"),
    ('href="HTTPS:y{i}"', "https://example.org/a/{i}/y{i}"), ('title="href=no" href="b c.pdf"', "https://example.org/a/{i}/b c.pdf"), ('name="{i}"', None), ('href="mailto:a{i}@b.org"', "mailto:a{i}@b.org"), ('href=".."', "https://example.org/a/"),
)


def _filled(text: str) -> str:
    return "'" + text.replace("'", "''").replace("{i}", "' || page_id || '") + "'"


_KEPT = [(html, link) for html, link in FORMS if link]


@register("link_forms", "WITH l AS (" + " UNION ALL ".join(f"SELECT page_id, {k} AS position, {_filled(link)} AS link, 'no. {k} & more' AS text FROM pages" for k, (_, link) in enumerate(_KEPT)) + ") SELECT page_id, CAST(position AS INTEGER) AS position, link, text FROM l")
def link_forms(spark, d):
    """Relative, dotted, encoded, empty and unquoted addresses, made for every page."""
    i, n, parts = F.col("page_id").cast("string"), 0, []
    for html, link in FORMS:
        said = [x for s in html.split("{i}") for x in (F.lit(s), i)][:-1]
        parts += [F.lit("<p><a class=x "), *said, F.lit(f">no.<!-- --> <b>{n} &amp;</b>\n more</a></p><script>'<a href=z>'</script>")]
        n += link is not None
    pages = t(spark, d, "pages").select("page_id", F.concat(F.lit("https://example.org/a/"), i, F.lit("/c.html?q=1")).alias("url"), F.concat(*parts).alias("html"))
    return links.anchors(pages, "page_id").select("page_id", "position", "link", "text")
