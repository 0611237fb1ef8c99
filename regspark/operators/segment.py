"""Documents to pages to chunks (SEG-1 to SEG-16). Folds run inside a document's row; nothing is shuffled but
to put pages together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regspark import schema as S


def assemble_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, full_text): ``[Page n]`` lines and texts, in page order; pages without text are left out, and
    so are documents without any (SEG-1)."""
    kept = pages.filter(F.coalesce(F.trim("text"), F.lit("")) != "")
    page = F.struct("page_number", F.concat(F.lit("[Page "), F.col("page_number").cast("string"), F.lit("]\n"), "text").alias("t"))
    return kept.groupBy("doc_id").agg(F.sort_array(F.collect_list(page)).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda p: p.t), "\n\n").alias("full_text"))


def split_pages(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """(doc_id, page_number, text): the inverse (SEG-2)."""
    parts = docs.select("doc_id", F.explode(F.split(text, r"(?:^|\n\n)(?=\[Page \d+\]\n)")).alias("p")).filter(F.col("p").rlike(r"^\[Page \d+\]\n"))
    return parts.select("doc_id", F.regexp_extract("p", r"^\[Page (\d+)\]", 1).cast("int").alias("page_number"), F.regexp_replace("p", r"^\[Page \d+\]\n", "").alias("text"))


#: A line feed before words that open a section.
SECTION_START = r"\n(?=(?:Rule|Section|§|Chapter|Part|Article|Subchapter|RULE|SECTION|CHAPTER)\s+[\d§])"
#: All white space, as Python strips it.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def split_sections(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """(doc_id, section_index, text, start): cut before section headings where there are two or more, white
    space around a section left out; a document with fewer is one section as it is (SEG-3). A heading counts if a
    line feed stands before it, also at the very beginning; start is where the cut lies."""
    whole = F.col(text)
    many = F.regexp_count(whole, F.lit(SECTION_START)) >= 2
    parts = F.when(many, F.split(whole, "(?=" + SECTION_START + ")")).otherwise(F.array(whole))
    before = lambda acc, p: F.struct(F.array_append(acc.out, F.struct(p.alias("text"), acc.at.alias("start"))).alias("out"), (acc.at + F.char_length(p)).alias("at"))
    zero = F.struct(F.array().cast("array<struct<text:string,start:int>>").alias("out"), F.lit(0).alias("at"))
    trimmed = lambda p: F.struct(F.when(many, F.trim(p.text, F.lit(BLANKS))).otherwise(p.text).alias("text"), p.start.alias("start"))
    kept = F.filter(F.transform(F.aggregate(parts, zero, before, lambda acc: acc.out), trimmed), lambda p: F.trim(p.text, F.lit(BLANKS)) != "")
    return docs.select("doc_id", F.posexplode(kept).alias("section_index", "s")).select("doc_id", "section_index", "s.text", "s.start")


def merge_sections(docs: DataFrame, chunk_size: int = 2000, sections: str = "sections") -> DataFrame:
    """``docs`` with ``chunks``: its array of sections merged greedily while a chunk stays under the size
    (SEG-4)."""
    step = lambda acc, s: F.when(acc.buf == "", F.struct(acc.out.alias("out"), s.alias("buf"))).when(
        F.char_length(acc.buf) + F.char_length(s) < chunk_size, F.struct(acc.out.alias("out"), F.concat(acc.buf, F.lit("\n\n"), s).alias("buf"))
    ).otherwise(F.struct(F.array_append(acc.out, acc.buf).alias("out"), s.alias("buf")))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))
    folded = F.aggregate(F.col(sections), zero, step, lambda acc: F.when(acc.buf == "", acc.out).otherwise(F.array_append(acc.out, acc.buf)))
    return docs.withColumn("chunks", folded)


#: Marks a sentence ends with, and how far past a window's end a blank line or sentence may lie.
SENTENCE_ENDS = (". ", ".\n", "? ", "?\n", "! ", "!\n")
PARAGRAPH_REACH, SENTENCE_REACH = 200, 100


def window_end(text: str, start: int, size: int, mode: str) -> int:
    """Where the window that begins at ``start`` ends: at the last good place in its second half, or after
    ``size`` characters, be that beyond the text."""
    end, half = start + size, start + size // 2
    if end >= len(text):
        return end
    if mode == "paragraph":  # before a blank line, or after a full stop; both may lie a little past the window
        at = text.rfind("\n\n", half, end + PARAGRAPH_REACH)
        if at > start:
            return at
        at = text.rfind(". ", half, end + SENTENCE_REACH)
        return at + 1 if at > start else end
    found = ((text.rfind(mark, start, end), len(mark)) for mark in ("\n\n", *SENTENCE_ENDS))
    return next((at + n for at, n in found if at > half), end)  # after the mark, which lies inside


def cuts(text: str, size: int, overlap: int, mode: str, drop_tail: bool) -> list[tuple[int, int]]:
    """The spans of a text's chunks. Mode ``paragraph`` goes on while the next start lies inside the text, and so
    ends with short chunks that the one before holds already; ``drop_tail`` leaves those out. Mode ``sentence``
    stops where less than an overlap is left."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = window_end(text, start, size, mode)
        if not (drop_tail and out and out[-1][1] >= n):
            out.append((start, min(end, n)))
        start = max(start + 1, end - overlap)
        if mode == "sentence" and start >= n - overlap:
            break
    return [(a, b) for a, b in out if text[a:b].strip()]


def size_split(docs: DataFrame, chunk_size: int = 2000, overlap: int = 200, mode: str = "paragraph", drop_tail: bool = False, text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, start, end, text): windows that end at a blank line or sentence where they can
    (SEG-5); texts without white space around, blank windows left out."""

    @F.pandas_udf("array<struct<start int, end int, text string>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "text": t[a:b].strip()} for a, b in cuts(t or "", chunk_size, overlap, mode, drop_tail)])

    return docs.select("doc_id", F.posexplode(split(F.col(text))).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")


def chunk_pages(pages: DataFrame, chunk_size: int = 2000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, section, start, end, pages, section_title, text): the whole chunker
    (SEG-1, SEG-3 to SEG-8). A document's pages are put together, cut at section headings, small sections merged,
    and what is over twice the size, or has no sections, cut by size. Pages are those that a chunk's own place
    touches. pages: doc_id, page_number, text."""
    said = F.struct("page_number", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n")).alias("t"))
    docs = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(said)).alias("p"))
    docs = docs.select("doc_id", F.array_join(F.transform("p", lambda p: p.t), "").alias("full_text"), F.transform("p", lambda p: F.struct(p.page_number.alias("n"), F.char_length(p.t).alias("size"))).alias("p"))
    ends = F.aggregate("p", F.array().cast("array<struct<n:int,size:int>>"), lambda acc, p: F.array_append(acc, F.struct(p.n.cast("int").alias("n"), (p["size"] + F.when(F.size(acc) > 0, F.element_at(acc, -1)["size"]).otherwise(0)).alias("size"))))
    page_map = docs.select("doc_id", F.posexplode(F.zip_with("p", ends, lambda p, e: F.struct(p.n.alias("page_number"), (e["size"] - p["size"]).alias("page_start"), e["size"].alias("page_end")))).alias("i", "m")).select("doc_id", "m.*")
    sections = split_sections(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section_index", "text", "start"))).alias("s"))
    empty = F.array().cast("array<struct<text:string,start:int>>")
    piece = lambda text, start: F.struct(text.alias("text"), start.alias("start"))
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, s: F.array_append(F.slice(acc, 1, F.size(acc) - 1), piece(F.concat(last(acc).text, F.lit("\n\n"), s.text), last(acc).start))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (F.char_length(F.try_element_at(acc, F.lit(-1)).text) + F.char_length(s.text) < chunk_size), joined(acc, s)).otherwise(F.array_append(acc, piece(s.text, s.start)))
    merged = sections.select("doc_id", (F.size("s") < 2).alias("alone"), F.posexplode(F.aggregate("s", empty, step)).alias("section", "c")).select("doc_id", "alone", "section", F.col("c.text").alias("text"), F.col("c.start").alias("at"))

    @F.pandas_udf("array<struct<start int, end int, text string>>")
    def split(texts: pd.Series, alone: pd.Series) -> pd.Series:
        whole = lambda t: [{"start": 0, "end": len(t), "text": t}]
        some = lambda t: [{"start": a, "end": b, "text": t[a:b].strip()} for a, b in cuts(t, chunk_size, overlap, "paragraph", False)]
        return pd.Series([some(t) if one or len(t) > 2 * chunk_size else whole(t) for t, one in zip(texts, alone, strict=True)])

    chunks = merged.select("doc_id", "section", "at", F.posexplode(split("text", "alone")).alias("sub", "c")).select("doc_id", "section", "sub", (F.col("at") + F.col("c.start")).alias("start"), (F.col("at") + F.col("c.end")).alias("end"), "c.text")
    placed = pages_for_ranges(chunks, page_map)
    w = Window.partitionBy("doc_id")
    numbered = placed.withColumn("chunk_index", F.row_number().over(w.orderBy("section", "sub")) - 1).withColumn("total_chunks", F.count("*").over(w).cast("int"))
    return numbered.select("doc_id", "chunk_index", "total_chunks", "section", "start", "end", "pages", section_title(F.col("text")).alias("section_title"), "text")


def pages_for_ranges(chunks: DataFrame, page_map: DataFrame) -> DataFrame:
    """``chunks`` (doc_id, start, end) with the pages (doc_id, page_number, page_start, page_end) they touch,
    ascending; page 1 if none (SEG-6). A document's chunks and pages meet in one row, as arrays, and are looked up
    by binary search: no chunk is joined with a page."""
    m = page_map.groupBy(F.col("doc_id").alias("_doc")).agg(*[F.collect_list(c).alias(f"_{c}") for c in ("page_start", "page_end", "page_number")])
    c = chunks.groupBy("doc_id").agg(F.collect_list(F.struct(*chunks.columns)).alias("_chunks"))
    both = c.join(m, F.col("doc_id") == F.col("_doc"), "left")
    kind = page_map.schema["page_number"].dataType.simpleString()

    @F.pandas_udf(f"array<array<{kind}>>")
    def touched(start: pd.Series, end: pd.Series, page_start: pd.Series, page_end: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series([_touched(*row) for row in zip(start, end, page_start, page_end, number, strict=True)])

    pages = touched("_chunks.start", "_chunks.end", "_page_start", "_page_end", "_page_number")
    rows = both.select(F.explode(F.arrays_zip(F.col("_chunks").alias("c"), pages.alias("pages"))).alias("r"))
    return rows.select("r.c.*", "r.pages")


def _touched(start, end, page_start, page_end, number) -> list[list]:
    if page_start is None or not len(page_start):
        return [[1] for _ in start]
    by = np.argsort(page_start, kind="stable")
    first, last, n = (np.asarray(x)[by] for x in (page_start, page_end, number))
    reach = np.maximum.accumulate(last)  # of pages up to here: ascending, also where ranges overlap
    low, high = np.searchsorted(reach, start, "right"), np.searchsorted(first, end, "left")
    found = [sorted(set(n[i:j][last[i:j] > s].tolist())) for s, i, j in zip(start, low, high, strict=True)]
    return [f or [1] for f in found]


def section_title(text, mode: str = "regex"):
    """A chunk's heading, or null (SEG-7)."""
    if mode == "regex":
        return F.nullif(F.trim(F.regexp_extract(text, S.SECTION_TITLE, 1)), F.lit(""))
    line = F.trim(F.substring_index(F.trim(text, F.lit(" \t\r\n")), "\n", 1))
    words = F.upper(line).rlike("^(SECTION|CHAPTER|PART|ARTICLE|RULE|REGULATION)")
    caps = (F.upper(line) == line) & (F.lower(line) != line) & (F.char_length(line) > 5)
    return F.when(F.char_length(line) >= 100, None).when(words, line).when(line.rlike(r"^[\d§]"), F.substring(line, 1, 80)).when(caps, line)


def with_ids(docs: DataFrame) -> DataFrame:
    """Adds doc_key (from state, agency and file) and page_key (SEG-8)."""
    key = F.substring(F.sha2(F.concat_ws("/", "state", "agency_type", "filename"), 256), 1, 16)
    return docs.withColumn("doc_key", key).withColumn("page_key", F.concat(key, F.lit("_p"), F.col("page_number").cast("string")))


def chunk_id(name, index, text):
    return F.substring(F.sha2(F.concat_ws(":", name, index.cast("string"), F.substring(text, 1, 100)), 256), 1, 12)


def abstract_id(name, pages, text):
    """16 hex digits of a chunk's abstract (SEG-8): of its document's name, its pages as a list, and its first 500
    characters."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "), F.lit("]"))
    return F.substring(F.sha2(F.concat_ws(":", name, listed, F.substring(text, 1, 500)), 256), 1, 16)


def table_page_score(text):
    """How much a page looks like a fee table; 3 or more is one (SEG-9). Null or short pages score 0."""
    dollars = F.regexp_count(text, F.lit(r"\$[\d,]+(?:\.\d{2})?"))
    low = F.lower(text)
    words = sum((low.contains(w).cast("int") for w in S.FEE_WORDS), F.lit(0))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.char_length(x) < 60))
    numbered = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"\d+")) >= 3))
    steps = lambda n: F.when(n >= 3, 1).otherwise(0)
    score = F.when(dollars >= 3, 3).when(dollars >= 1, 1).otherwise(0) + F.when(words >= 3, 2).when(words >= 1, 1).otherwise(0) + F.when((F.size(lines) > 5) & (short > 0.6 * F.size(lines)), 2).otherwise(0) + 2 * steps(numbered)
    return F.when(F.char_length(text) >= 50, score).otherwise(0)


def is_low_value(text):
    """Pages not worth a model's time: empty, under 80 characters or 30 letters (SEG-10)."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    return (F.char_length(t) < 80) | (F.regexp_count(t, F.lit(r"\p{L}")) < 30)


def cells_to_grid(cells: DataFrame) -> DataFrame:
    """(table_id, grid): dense rows of cells (table_id, row, col, words), 1-based, gaps empty (SEG-11). Of a
    cell given twice the larger text counts."""
    cells = cells.groupBy("table_id", "row", "col").agg(F.max(F.array_join("words", " ")).alias("said"))
    width = cells.groupBy("table_id").agg(F.max("col").alias("width"), F.max("row").alias("height"))
    filled = cells.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "said"))).alias("m")).join(width, "table_id")
    grid = F.transform(F.sequence(F.lit(1), F.col("height")), lambda r: F.transform(F.sequence(F.lit(1), F.col("width")), lambda c: F.coalesce(F.try_element_at("m", F.struct(r.alias("row"), c.alias("col"))), F.lit(""))))
    return filled.select("table_id", grid.alias("grid"))


def grid_to_text(grids: DataFrame, index: str = "table_id") -> DataFrame:
    """(table_id, text): the header, a rule, and each row as ``Header: value`` pairs joined by commas (SEG-12).
    Rows without a value are left out; rows of another width stay as they are."""
    head = F.col("grid")[0]
    pairs = lambda r: F.nullif(F.array_join(F.filter(F.zip_with(head, r, lambda h, v: F.when(F.trim(v) != "", F.concat(h, F.lit(": "), v))), lambda x: x.isNotNull()), ", "), F.lit(""))
    rows = F.transform(F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0))), lambda r: F.when(F.size(r) == F.size(head), pairs(r)).otherwise(F.array_join(r, " | ")))
    lines = F.concat(F.array(F.concat(F.lit("[TABLE "), F.col(index).cast("string"), F.lit("]")), F.array_join(head, " | "), F.lit("-" * 40)), F.filter(rows, lambda r: r.isNotNull()))
    return grids.select(index, F.array_join(lines, "\n").alias("text"))


def embedding_text(variant: str = "page"):
    """The text that stands for a record's vector (SEG-13)."""
    cut = 2000 if variant == "page" else 1500
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    core = some(F.col("core_rule")) if variant == "page" else F.coalesce("core_rule", F.lit(""))
    return F.concat_ws(" | ", some(F.col("abstract")), core, some(F.array_join("statute_codes", ", ")), some(F.col("compliance_requirements")), some(F.col("section")), some(F.substring("raw_text", 1, cut)))


def clean_html(html):
    """Text of a page by patterns (SEG-14): scripts, styles, navigation and tags go, blank runs shrink."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style|nav|header|footer)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<(img|link)\b[^>]*>", " ")
    t = F.regexp_replace(t, r"(?i)</(p|div|h[1-6]|li|tr|section|article)>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n"))


def clean_html_selected(pages: DataFrame, selectors: tuple = S.CONTENT_SELECTORS) -> DataFrame:
    """The text of the first selector that a page has, else the body's, else all, by the standard library's
    parser (SEG-14). Null pages have an empty text."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        from regspark.functions.html import content

        return rows.map(lambda h: content(h or "", selectors))

    return pages.withColumn("text", text("html"))


def strip_md_tables(text):
    """Markdown tables as plain rows (SEG-15)."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"))
    cells = lambda x: F.array_join(F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)), "  |  ")
    return F.array_join(F.transform(lines, lambda x: F.when(F.trim(x).startswith("|"), cells(x)).otherwise(x)), "\n")


def page_batches(pages: DataFrame, n: int = 3, cut: int = 3000, single: int = 6000) -> DataFrame:
    """(doc_id, batch, pages): n consecutive pages each, texts cut for the model (SEG-16)."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    numbered = pages.withColumn("batch", F.floor((F.row_number().over(w) - 1) / n).cast("int"))
    made = numbered.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("pages"))
    size = F.when(F.size("pages") == 1, single).otherwise(cut)
    return made.withColumn("pages", F.transform("pages", lambda p: F.struct(p.page_number.alias("page_number"), F.left(p.text, size).alias("text"))))
