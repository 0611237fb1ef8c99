"""Splitters and the chunker against plain restatements; references as RFC 3986 resolves them."""

import re

from pyspark.sql import functions as F
from regspark.operators import links, segment


def test_windows_end_where_they_should():
    text = "a" * 1500 + "\n\n" + "b" * 3000
    assert segment.cuts(text, 2000, 200, "paragraph", True)[:2] == [(0, 1500), (1300, 3300)]
    assert segment.cuts("a" * 1900, 2000, 200, "paragraph", False) == [(0, 1900), (1800, 1900)]
    assert segment.cuts("a" * 1900, 2000, 200, "paragraph", True) == [(0, 1900)]
    assert segment.cuts("a" * 1500 + ". " + "b" * 2000, 2000, 200, "paragraph", True)[0] == (0, 1501)
    assert segment.cuts("a" * 2150 + "\n\n" + "b" * 900, 2000, 200, "paragraph", True)[0] == (0, 2150)  # past the window
    assert segment.cuts("a" * 1500 + "?\n" + "b" * 2000, 2000, 200, "sentence", False)[:2] == [(0, 1502), (1302, 3302)]
    assert segment.cuts("a" * 1200 + "! " + "b" * 200 + ". " + "c" * 3000, 2000, 200, "sentence", False)[0] == (0, 1404)  # of marks the first kind
    assert segment.cuts("a" * 900 + "\n\n" + "b" * 3000, 2000, 200, "sentence", False)[0] == (0, 2000)  # in the first half
    assert segment.cuts("", 2000, 200, "paragraph", False) == [] and segment.cuts(" \n " * 900, 2000, 200, "sentence", False) == []


def test_every_character_is_in_a_chunk():
    for mode in ("paragraph", "sentence"):
        for text in ("x" * 5000, "One. Two.\n\nThree. " * 400, "a b. " * 1000):
            spans = segment.cuts(text, 2000, 200, mode, True)
            assert all(b > a for a, b in spans) and spans[0][0] == 0
            assert spans[-1][1] == len(text) or mode == "sentence" and len(text) - spans[-1][1] <= 200
            assert all(c <= b for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_sections_at_the_very_beginning(spark):
    texts = [(1, "\nRule 1 a\nRule 2 b"), (2, "x\nRule 1 only"), (3, "Rule 0 \nSection 1\n\n\nChapter 2 "), (4, None), (5, " \n ")]
    got = [(r.doc_id, r.section_index, r.text, r.start) for r in segment.split_sections(spark.createDataFrame(texts, "doc_id int, full_text string")).orderBy("doc_id", "section_index").collect()]
    assert got == [(1, 0, "Rule 1 a", 0), (1, 1, "Rule 2 b", 9), (2, 0, "x\nRule 1 only", 0), (3, 0, "Rule 0", 0), (3, 1, "Section 1", 7), (3, 2, "Chapter 2", 19)]


def chunks_of(pages, size=2000, overlap=200):
    """The chunker, stated plainly: (start, end, pages, text)."""
    text, places = "", []
    for number, page in pages:
        places.append((len(text), len(text) + len(page) + 2, number))
        text += page + "\n\n"
    heads = [m.start() for m in re.finditer(r"\n(?=(?:Rule|Section|§|Chapter|Part|Article|Subchapter|RULE|SECTION|CHAPTER)\s+[\d§])", text)]
    out = []
    if len(heads) < 2:
        out = [(a, b, text[a:b].strip()) for a, b in segment.cuts(text, size, overlap, "paragraph", False)]
    else:
        merged = []
        for a, b in zip([0, *heads], [*heads, len(text)], strict=True):
            part = text[a:b].strip()
            if part and merged and len(merged[-1][1]) + len(part) < size:
                merged[-1][1] += "\n\n" + part
            elif part:
                merged.append([a, part])
        for a, part in merged:
            out += [(a, a + len(part), part)] if len(part) <= 2 * size else [(a + x, a + y, part[x:y].strip()) for x, y in segment.cuts(part, size, overlap, "paragraph", False)]
    return [(a, b, [p for s, e, p in places if a < e and b > s] or [1], t) for a, b, t in out]


def test_the_whole_chunker(spark):
    import random

    rng = random.Random(3)
    docs = {}
    for d in range(30):
        words = lambda n: " ".join(rng.choice(["fee", "rule.", "board", "license,", "pay\n\nnow"]) for _ in range(n))
        head = lambda: rng.choice(["", "", "\nRule 5.1 ", "intro\nSection 7 ", "\nCHAPTER 12 of"]) if d % 3 else ""
        docs[d] = [(p, head() + words(rng.choice([0, 5, 100, 900]))) for p in range(1, rng.randint(2, 9))]
    df = spark.createDataFrame([(d, p, t) for d, pages in docs.items() for p, t in pages], "doc_id int, page_number int, text string").repartition(3)
    got = {}
    for r in segment.chunk_pages(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, list(r.pages), r.text))
        assert r.total_chunks > r.chunk_index
    want = {d: chunks_of(p) for d, p in docs.items()}
    assert got == {d: c for d, c in want.items() if c} and sum(map(len, got.values())) > 60
    titles = {r.section_title for r in segment.chunk_pages(df).collect()}
    assert {"Rule 5.1 fee", None} & titles and any(t and t.startswith("Section 7") for t in titles)


#: References against http://a/b/c/d;p?q, as RFC 3986 lists them in 5.4 (fragments dropped).
NORMAL = "g:h=g:h g=http://a/b/c/g ./g=http://a/b/c/g g/=http://a/b/c/g/ /g=http://a/g //g=http://g ?y=http://a/b/c/d;p?y g?y=http://a/b/c/g?y #s=http://a/b/c/d;p?q g#s=http://a/b/c/g g?y#s=http://a/b/c/g?y ;x=http://a/b/c/;x g;x=http://a/b/c/g;x g;x?y#s=http://a/b/c/g;x?y .=http://a/b/c/ ./=http://a/b/c/ ..=http://a/b/ ../=http://a/b/ ../g=http://a/b/g ../..=http://a/ ../../=http://a/ ../../g=http://a/g"
ABNORMAL = "../../../g=http://a/g ../../../../g=http://a/g /./g=http://a/g /../g=http://a/g g.=http://a/b/c/g. .g=http://a/b/c/.g g..=http://a/b/c/g.. ..g=http://a/b/c/..g ./../g=http://a/b/g ./g/.=http://a/b/c/g/ g/./h=http://a/b/c/g/h g/../h=http://a/b/c/h g;x=1/./y=http://a/b/c/g;x=1/y g;x=1/../y=http://a/b/c/y g?y/./x=http://a/b/c/g?y/./x g?y/../x=http://a/b/c/g?y/../x g#s/./x=http://a/b/c/g g#s/../x=http://a/b/c/g http:g=http://a/b/c/g"


def test_references_of_the_rfc(spark):
    cases = [c.rsplit("=http", 1) if "=http" in c else c.split("=", 1) for c in f"{NORMAL} {ABNORMAL}".split()]
    cases = [(h, ("http" + w) if not w.startswith(("g:", "http")) else w) for h, w in cases] + [("", "http://a/b/c/d;p?q")]
    df = spark.createDataFrame(cases, "h string, want string")
    bad = df.withColumn("got", links.normalize_url(F.lit("http://a/b/c/d;p?q"), F.col("h"))).filter("NOT got <=> want").collect()
    assert len(cases) == 42 and bad == []


def test_bases_of_other_forms(spark):
    from urllib.parse import urldefrag, urljoin

    bases = ["https://h.org", "https://h.org/", "https://h.org/a/b/c.html", "https://h.org?x=1", "https://h.org/a//b/c?d#e"]
    hrefs = ["../x.pdf", "rules/./y.pdf", "z", "/z/../w", "?p", "#f", "//o.org/a/../b", "https://o.org/a/../b", "..", "a/..", "  pad  ", "mailto:x@y"]
    df = spark.createDataFrame([(b, h, urldefrag(urljoin(b, h.strip()))[0]) for b in bases for h in hrefs], "b string, h string, want string")
    bad = df.withColumn("got", links.normalize_url(F.col("b"), F.col("h"))).filter("NOT got <=> want").collect()
    assert bad == []


def test_empty_and_odd_pages(spark):
    pages = spark.createDataFrame([("https://h.org/", None), ("https://h.org/", ""), ("https://h.org/", "<a href=x>one<a href=y>two"), ("https://h.org/", "<a>no</a><!-- <a href=z> --><A HREF=w>w</A>")], "url string, html string")
    assert [(r.link, r.text) for r in links.anchors(pages).orderBy("link").collect()] == [("https://h.org/w", "w"), ("https://h.org/x", "one two"), ("https://h.org/y", "two")]
