"""Links of stored HTML and crawl manifests (LNK-1 to LNK-12)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regspark import schema as S
from regspark.operators.retrieve import small


#: A reference's scheme, authority (with its slashes), path and query (with its mark).
_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def without_dots(segments):
    """Path segments after a fold over them with a stack: ``.`` is nothing, ``..`` takes the one before away."""
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", up(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s)))
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)


def normalize_url(base, href):
    """An absolute URL without fragment (LNK-1): a reference resolved against its page, as RFC 3986 (5.2) has it,
    where one of the page's own scheme without an authority counts as relative. Absolute references stay as written."""
    h = F.trim(href, F.lit(" \t\r\n\x0b\x0c"))
    scheme, authority, path, query = (F.regexp_extract(h, _URL, i) for i in (1, 2, 3, 4))
    own, host, folder, asked = (F.regexp_extract(base, _URL, i) for i in (1, 2, 3, 4))
    plain = F.regexp_replace(h, "#.*$", "")
    middle = F.slice(F.split(folder, "/"), 1, F.greatest(F.size(F.split(folder, "/")) - 1, F.lit(0)))
    beside = F.concat(F.filter(middle, lambda s, i: (i == 0) | (s != "")), F.split(path, "/"))
    beside = F.when((folder == "") & (host != ""), F.concat(F.array(F.lit("")), F.split(path, "/"))).otherwise(beside)
    resolved = F.array_join(without_dots(F.when(path.startswith("/"), F.split(path, "/")).otherwise(beside)), "/")
    rooted = F.when((host != "") & ~resolved.startswith("/"), F.concat(F.lit("/"), resolved)).otherwise(resolved)
    made = F.when(path == "", F.concat(folder, F.when(query != "", query).otherwise(asked))).otherwise(F.concat(rooted, query))
    return (
        F.when((scheme != "") & (F.lower(scheme) != F.lower(own)), plain).when((scheme != "") & (authority != ""), plain)
        .when(authority != "", F.concat(own, F.lit(":"), plain)).otherwise(F.concat(own, F.lit(":"), host, made))
    )


def is_document(url, extensions=S.DOC_EXTENSIONS):
    """Whether a URL's path ends in a document's extension (LNK-2)."""
    return F.lower(F.regexp_replace(url, r"[?#].*$", "")).rlike(r"\.(" + "|".join(extensions) + ")$")


def keyword_match(text, url, keywords=S.RULE_WORDS):
    """Whether a link's text or URL holds one of the words (LNK-3)."""
    return F.lower(F.concat_ws(" ", text, url)).rlike("|".join(keywords))


def anchors(pages: DataFrame, *keep: str) -> DataFrame:
    """(url, position, link, text): every anchor of a page with an address, its link made absolute. Pages are read by
    the standard library's parser: attributes with or without quotes, entities decoded, comments and scripts left out."""

    @F.pandas_udf("array<struct<href string, text string>>")
    def found(rows: pd.Series) -> pd.Series:
        from regspark.functions.html import page_anchors

        return rows.map(lambda h: [{"href": a, "text": t} for a, t in page_anchors(h or "")])

    rows = pages.select("url", *keep, F.posexplode(found("html")).alias("position", "a"))
    return rows.select("url", *keep, "position", normalize_url(F.col("url"), F.col("a.href")).alias("link"), F.col("a.text").alias("text"))


def extract_links(pages: DataFrame, allowed_domains=None, keywords=S.RULE_WORDS, extensions=S.DOC_EXTENSIONS) -> DataFrame:
    """(url, link, text, kind, position): documents, and subpages on allowed hosts with a keyword; the first
    of equal links of a page (LNK-4)."""
    found = anchors(pages)
    host = F.lower(F.regexp_extract("link", r"^https?://([^/:?#]+)", 1))
    allowed = host != ""
    if allowed_domains:
        inside = F.lit(False)
        for d in allowed_domains:
            inside = inside | (host == d) | host.endswith(f".{d}")
        allowed = allowed & inside
    kind = F.when(is_document(F.col("link"), extensions), "document").when(allowed & keyword_match(F.col("text"), F.col("link"), keywords), "subpage")
    kept = found.withColumn("kind", kind).filter("kind IS NOT NULL")
    first = kept.groupBy("url", "link", "kind").agg(F.min(F.struct("position", "text")).alias("f"))
    return first.select("url", "link", "f.text", "kind", "f.position")


def two_tier(roots: DataFrame, pages: DataFrame, max_subpages: int = 20, **rules) -> DataFrame:
    """(root, link, text, tier, source): documents of root pages and of their first subpages, each URL once in
    discovery order (LNK-5). roots: url. Subpages are not followed further."""
    root_pages = pages.join(small(roots.select("url").distinct()), "url", "left_semi")
    first = extract_links(root_pages, **rules).withColumnRenamed("url", "root")
    w = Window.partitionBy("root").orderBy("position", "link")
    subs = first.filter("kind = 'subpage'").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max_subpages).select("root", F.col("link").alias("url"), "r")
    second = extract_links(pages.join(subs.select("url").distinct(), "url", "left_semi"), **rules).filter("kind = 'document'").join(subs, "url")
    rows = first.filter("kind = 'document'").select("root", "link", "text", F.lit(1).alias("tier"), F.lit(0).alias("r"), "position", F.col("root").alias("source"))
    rows = rows.unionByName(second.select("root", "link", "text", F.lit(2).alias("tier"), "r", "position", F.col("url").alias("source")))
    best = rows.groupBy("root", "link").agg(F.min(F.struct("tier", "r", "position", "text", "source")).alias("f"))
    return best.select("root", "link", "f.text", "f.tier", "f.source")


def links_by_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(source, url, link, text): links that match a source's pattern (LNK-6). pages: source, url, html; rules:
    source, pattern."""
    found = anchors(pages, "source").join(small(rules), "source")
    return found.filter(F.expr("link rlike pattern")).select("source", "url", "link", "text").distinct()


def paired_records(pages: DataFrame, id_pattern: str, label_pattern: str) -> DataFrame:
    """(url, id, label): ids and labels of a page, paired by position (LNK-6)."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(id_pattern), 1).alias("id"), F.regexp_extract_all("html", F.lit(label_pattern), 1).alias("label"))
    return pages.select("url", F.inline(both))


#: What sources' addresses hold, and how their records and labels are written.
RULE_PATH, CHAPTER_PATH, WHOLE_FILE = "/rules/pdf/", "/gac/", "Download_pdf"
RECORD_ID, RECORD_LABEL = r"recordId[=:](\d+)", r"(§[\d.]+)"


def source_links(pages: DataFrame) -> DataFrame:
    """(url, rule, link, text, position): a page's links by its source's rule, each once (LNK-6). pages: url, html,
    rule and param. Rules: ``pdf``, links that end in .pdf; ``pdf_path``, those with .pdf or /rules/pdf/ in them;
    ``department``, PDF and Word files, chapter pages of department param, and its one file (Download_pdf);
    ``volume``, .docx files of volume param, or, if there is none, Word files. A link without a text is called by the
    last part of its path, a chapter, a department's file or a volume by what it is."""
    found = anchors(pages, "rule", "param")
    low, param, rule = F.lower("link"), F.col("param"), F.col("rule")
    is_file, whole = low.rlike(r"\.(pdf|docx?)$"), F.col("link").contains(WHOLE_FILE)
    chapter = F.col("link").contains(F.concat(F.lit(CHAPTER_PATH), param, F.lit("-")))
    kept = F.when(rule == "pdf", low.endswith(".pdf")).when(rule == "pdf_path", low.contains(".pdf") | low.contains(RULE_PATH)).when(rule == "department", is_file | chapter | whole).when(rule == "volume", low.contains(F.lower(param)) & low.contains(".doc"))
    last = F.element_at(F.split("link", "/"), -1)
    name = F.when(rule == "volume", param).when((rule == "department") & ~is_file & chapter, F.concat(F.lit("Chapter "), last)).otherwise(last)
    text = F.when((rule == "department") & whole & ~is_file & ~chapter, F.format_string("Department %s Full PDF", param)).otherwise(F.coalesce(F.nullif("text", F.lit("")), name))
    rows = found.filter(kept).withColumn("text", text).withColumn("worse", ((rule == "volume") & ~low.endswith(".docx")).cast("int"))
    rows = rows.withColumn("least", F.min("worse").over(Window.partitionBy("url", "rule", "param"))).filter("worse = least")
    first = rows.groupBy("url", "rule", "link").agg(F.min(F.struct("position", "text")).alias("f"))
    return first.select("url", "rule", "link", "f.text", "f.position")


def department_files(pages: DataFrame, found: DataFrame, template: str) -> DataFrame:
    """(url, rule, link, text): the address of a department's one file for pages on which none was found (LNK-6).
    pages: url, rule, param, title; found: what ``source_links`` gives; template: an address with {dept} and {title}."""
    have = found.filter((F.col("rule") == "department") & F.col("link").contains(WHOLE_FILE)).select("url").distinct()
    title = F.url_encode(F.upper("title"))
    for java, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        title = F.replace(title, F.lit(java), F.lit(plain))
    link = F.replace(F.replace(F.lit(template), F.lit("{dept}"), F.col("param")), F.lit("{title}"), title)
    rest = pages.filter("rule = 'department'").join(have, "url", "left_anti")
    return rest.select("url", "rule", link.alias("link"), F.format_string("Department %s Full PDF", "param").alias("text"))


def chapter_links(targets: DataFrame, base: str) -> DataFrame:
    """(target, link, text): the addresses of a target's list of chapters (LNK-6). targets: target, chapters."""
    return targets.select("target", F.explode("chapters").alias("c")).select("target", F.concat(F.lit(base.rstrip("/") + "/"), "c").alias("link"), F.concat(F.lit("Chapter "), "c").alias("text"))


def record_links(pages: DataFrame, base: str, id_pattern: str = RECORD_ID, label_pattern: str = RECORD_LABEL) -> DataFrame:
    """(url, position, link, text): a chapter page's record ids, each once, with its labels by position (LNK-6); a
    record without a label is called by chapter and number. pages: url, chapter, html (ids), text (labels)."""
    ids = F.array_distinct(F.regexp_extract_all("html", F.lit(id_pattern), 1))
    rows = pages.select("url", "chapter", F.regexp_extract_all("text", F.lit(label_pattern), 1).alias("labels"), F.posexplode(ids).alias("position", "id"))
    text = F.coalesce(F.get("labels", F.col("position")), F.format_string("Ch%s_Rule%d", F.col("chapter"), F.col("position") + 1))
    return rows.select("url", "position", F.concat(F.lit(base), "id").alias("link"), text.alias("text"))


def page_title(html, fallback: str = "board"):
    """The title's text, or the fallback (LNK-7)."""
    t = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(fallback)).otherwise(t)


def assign_filenames(links: DataFrame, *key: str) -> DataFrame:
    """``links`` (directory, link, extension) with a file name: the path's last part or ``document``, with an
    extension, numbered by link where names of a directory collide (LNK-8). A link that stands there more than once
    is numbered by ``key``, columns that tell its rows apart; without one their order is open."""
    last = F.regexp_extract(F.regexp_replace("link", r"[?#].*$", ""), r"([^/]+)$", 1)
    last = F.when(F.col("link").rlike(r"^[a-z]+://[^/]*/?$") | (last == ""), "document").otherwise(last)
    named = F.when(last.rlike(r"\.[A-Za-z0-9]{1,5}$"), last).otherwise(F.concat(last, F.coalesce("extension", F.lit(".html"))))
    w = Window.partitionBy("directory", "name").orderBy("link", *key)
    n = F.row_number().over(w)
    numbered = F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat(F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.lit("_"), F.col("n").cast("string"), F.regexp_extract("name", r"(\.[^.]*)$", 1)))
    return links.withColumn("name", named).withColumn("n", n).withColumn("filename", numbered).drop("name", "n")


def build_manifest(files: DataFrame) -> DataFrame:
    """Documents and bytes by state and agency with totals (LNK-9); ``files`` has state, agency_type, content."""
    rows = files.select("state", "agency_type", F.sha2("content", 256).alias("file_hash"), F.octet_length("content").alias("size_bytes"))
    return rows.rollup("state", "agency_type").agg(F.count("*").alias("documents"), F.sum("size_bytes").alias("bytes"), F.count_distinct("file_hash").alias("distinct_files"))


def manifest_entries(targets: DataFrame, files: DataFrame, crawled_at) -> DataFrame:
    """A row for each target (state, agency_type, discovered, errors) with its counts and the list of its documents:
    url, filename, saved_path, file_hash, size_bytes, crawled_at, by saved path (LNK-9). files: state, agency_type,
    url, saved_path, content (null where a file could not be read: no hash, size 0)."""
    doc = F.struct(F.coalesce("saved_path", F.lit("")).alias("saved_path"), "url", F.coalesce(F.element_at(F.split("saved_path", "/"), -1), F.lit("")).alias("filename"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("file_hash"), F.coalesce(F.octet_length("content").cast("long"), F.lit(0).cast("long")).alias("size_bytes"), crawled_at.cast("string").alias("crawled_at"))
    docs = files.groupBy("state", "agency_type").agg(F.sort_array(F.collect_list(doc)).alias("documents"))
    out = targets.join(docs, ["state", "agency_type"], "left")
    return out.withColumn("documents", F.coalesce("documents", F.array().cast(docs.schema["documents"].dataType))).withColumn("downloaded", F.size("documents"))


def latest_by_url(docs: DataFrame) -> DataFrame:
    return docs.groupBy("url").agg(F.max_by("file_hash", "position").alias("file_hash"))


def diff_manifests(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(url, change): new, removed, changed or unchanged; of a repeated URL the last counts (LNK-10).
    Both: url, file_hash, position."""
    a = latest_by_url(current).withColumnRenamed("file_hash", "now")
    b = latest_by_url(previous).withColumnRenamed("file_hash", "before")
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed").otherwise("unchanged")
    return a.join(b, "url", "full_outer").select("url", change.alias("change"))


def apply_diff(store: DataFrame, current: DataFrame, diff: DataFrame) -> DataFrame:
    """The store after a crawl: removed and changed rows go, new and changed ones come (LNK-11)."""
    out = diff.filter("change IN ('removed', 'changed')").select("url")
    into = diff.filter("change IN ('new', 'changed')").select("url")
    return store.join(out, "url", "left_anti").unionByName(current.join(into, "url", "left_semi"))


HISTORY = "url string, file_hash string, valid_from timestamp, valid_to timestamp"


def history_of(manifests: DataFrame) -> DataFrame:
    """(url, file_hash, valid_from, valid_to): when each URL had which content (LNK-11). manifests: crawled (a
    time), url, file_hash, position; of a URL given twice in a crawl the last counts. An interval begins with the
    crawl that first finds the content and ends with the one that finds another or none; open ones end in null."""
    crawls = manifests.groupBy("crawled").agg(F.lit(1).alias("one")).select("crawled", F.row_number().over(Window.orderBy("crawled")).alias("turn"))  # a row a crawl
    seen = manifests.groupBy("crawled", "url").agg(F.max_by("file_hash", "position").alias("file_hash")).join(small(crawls), "crawled")
    w = Window.partitionBy("url").orderBy("turn")
    fresh = ~(F.col("file_hash").eqNullSafe(F.lag("file_hash").over(w)) & (F.lag("turn").over(w) == F.col("turn") - 1))
    runs = seen.withColumn("run", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(w))
    runs = runs.groupBy("url", "run", "file_hash").agg(F.min("crawled").alias("valid_from"), F.max("turn").alias("last"))
    after = crawls.select((F.col("turn") - 1).alias("last"), F.col("crawled").alias("valid_to"))
    return runs.join(small(after), "last", "left").select("url", "file_hash", "valid_from", "valid_to")


def record_changes(history: DataFrame, current: DataFrame, crawled) -> DataFrame:
    """``history`` after one more crawl (``current``: url, file_hash, position) at the time ``crawled``, later than
    all before: only open intervals meet the crawl; closed ones pass through."""
    now = latest_by_url(current).withColumnRenamed("file_hash", "now")
    open_ = history.filter("valid_to IS NULL")
    same = F.col("file_hash").eqNullSafe(F.col("now")) & F.col("valid_from").isNotNull() & F.col("seen").isNotNull()
    both = open_.join(now.withColumn("seen", F.lit(1)), "url", "full_outer").withColumn("same", same)
    kept = both.filter("valid_from IS NOT NULL").select("url", "file_hash", "valid_from", F.when(~F.col("same"), crawled).alias("valid_to"))
    new = both.filter("seen IS NOT NULL AND NOT same").select("url", F.col("now").alias("file_hash"), crawled.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return history.filter("valid_to IS NOT NULL").unionByName(kept).unionByName(new)


def store_at(history: DataFrame, at) -> DataFrame:
    """(url, file_hash): what the store held at a time."""
    return history.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("url", "file_hash")


def change_summary(history: DataFrame, every: str = "7 days") -> DataFrame:
    """(week, added, changed, removed): changes in each window. Content that ends where other content of the same
    URL begins has changed; else it was added or removed."""
    begins = history.select("url", F.col("valid_from").alias("at"), F.lit(1).alias("begin"), F.lit(0).alias("end"))
    ends = history.filter("valid_to IS NOT NULL").select("url", F.col("valid_to").alias("at"), F.lit(0).alias("begin"), F.lit(1).alias("end"))
    events = begins.unionByName(ends).groupBy("url", "at").agg(F.max("begin").alias("begin"), F.max("end").alias("end"))
    by = events.groupBy(F.window("at", every).alias("w")).agg(F.count_if(F.col("begin") > F.col("end")).alias("added"), F.count_if(F.col("begin") == F.col("end")).alias("changed"), F.count_if(F.col("begin") < F.col("end")).alias("removed"))
    return by.select(F.col("w.start").alias("week"), "added", "changed", "removed")


def crawl_summary(results: DataFrame) -> DataFrame:
    """Targets, documents and bytes by source type (LNK-12)."""
    return results.groupBy("source_type").agg(F.count("*").alias("targets"), F.sum("documents").alias("documents"), F.sum("bytes").alias("bytes"))
