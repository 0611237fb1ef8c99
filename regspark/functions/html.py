"""Text of HTML by the standard library."""

from __future__ import annotations

from html.parser import HTMLParser

DROPPED = {"script", "style", "nav", "header", "footer"}
#: Elements without an end.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def selects(selector: str, tag: str, attrs: dict) -> bool:
    """Whether ``#id``, ``.class`` or a tag name means this element."""
    if selector[0] == "#":
        return attrs.get("id") == selector[1:]
    if selector[0] == ".":
        return selector[1:] in (attrs.get("class") or "").split()
    return tag == selector


class _Reader(HTMLParser):
    """Collects all text and that of the first element of each selector."""

    def __init__(self, selectors):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list[str]] = {}
        self.selectors, self.drop = selectors, 0
        self.stack: list[tuple[str, list[str]]] = []
        self.all: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.drop += tag in DROPPED
        new = [s for s in self.selectors if s not in self.found and not self.drop and selects(s, tag, dict(attrs))]
        self.found.update((s, []) for s in new)
        self.stack.append((tag, new))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while True:
            last, _ = self.stack.pop()
            self.drop -= last in DROPPED
            if last == tag:
                return

    def handle_data(self, data):
        text = data.strip()
        if text and not self.drop:
            self.all.append(text)
            for _, new in self.stack:
                for s in new:
                    self.found[s].append(text)


def content(html: str, selectors) -> str:
    reader = _Reader((*selectors, "body"))
    reader.feed(html)
    reader.close()
    for s in reader.selectors:
        if s in reader.found:
            return "\n".join(reader.found[s])
    return "\n".join(reader.all)


class _Anchors(HTMLParser):
    """Addresses of all anchors that have one, with the texts inside them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int | None]] = []
        self.found: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        href = (dict(attrs).get("href") or "").strip() if tag == "a" else ""
        if href:
            self.found.append((href, []))
        self.stack.append((tag, len(self.found) - 1 if href else None))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        text = data.strip()
        if text and not any(t in ("script", "style") for t, _ in self.stack):
            for _, i in self.stack:
                if i is not None:
                    self.found[i][1].append(text)


def page_anchors(html: str) -> list[tuple[str, str]]:
    reader = _Anchors()
    reader.feed(html)
    reader.close()
    return [(href, " ".join(" ".join(texts).split())) for href, texts in reader.found]
