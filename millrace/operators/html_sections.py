"""Pages to sections: content container, pruning, block extraction, one record for each section."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

BLOCK = "struct<type:string,text:string,items:array<string>,rows:array<array<string>>,language:string>"
SECTIONS = f"document_id string, section_order int, section_id string, section_path string, heading string, level int, blocks array<{BLOCK}>, raw_text string, cleaned_text string"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PRUNED = {"nav", "aside", "script", "style", "noscript", "template", "footer", "form", "button", "head"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Containers tried in order: tag and a class or id the element has (None: any).
CONTAINERS = (("article", "doc"), ("div", "content"), ("div", "body"), ("article", None), ("main", None), ("body", None))
ADMONITIONS = ("note", "tip", "warning", "caution", "important")


class Element:
    def __init__(self, tag: str, attrs: dict, parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.content: list[Element | str] = []

    def names(self) -> set[str]:
        return {*(self.attrs.get("class") or "").split(), *([self.attrs["id"]] if self.attrs.get("id") else [])}

    def walk(self) -> Iterator[Element]:
        yield self
        for c in self.content:
            if isinstance(c, Element):
                yield from c.walk()

    def text(self, keep: bool = False) -> str:
        parts = [c if isinstance(c, str) else "" if c.tag in PRUNED else c.text(True) for c in self.content]
        joined = "".join(parts) if keep else " ".join("".join(parts).split())
        return joined


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("#page", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th") or tag in HEADINGS or tag in ("ul", "ol", "div", "table", "section", "pre"):
            closes = {"li": {"li"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}.get(tag, {"p"})
            at = self.now
            while at is not None and at.tag not in closes and at.tag not in ("table", "ul", "ol", "div", "section", "article", "body"):
                at = at.parent
            if at is not None and at.tag in closes:
                self.now = at.parent
        child = Element(tag, dict(attrs), self.now)
        self.now.content.append(child)
        if tag not in VOID:
            self.now = child

    def handle_endtag(self, tag: str) -> None:
        at = self.now
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.now = at.parent

    def handle_data(self, data: str) -> None:
        self.now.content.append(data)


def container(root: Element) -> Element:
    every = list(root.walk())
    for tag, name in CONTAINERS:
        for e in every:
            if e.tag == tag and (name is None or name in e.names()):
                return e
    return root


def block_of(e: Element) -> dict | None:
    """The block of a block-level element, or None if it is only a frame around others."""
    empty = {"type": "paragraph", "text": None, "items": None, "rows": None, "language": None}
    if e.tag == "p":
        return empty | {"text": e.text()}
    if e.tag == "pre":
        code = next((x for x in e.walk() if x.tag == "code"), e)
        language = next((n.removeprefix("language-") for n in code.names() if n.startswith("language-")), None)
        return empty | {"type": "code", "text": e.text(True).strip("\n"), "language": language}
    if e.tag in ("ul", "ol"):
        return empty | {"type": "list", "items": [x.text() for x in e.content if isinstance(x, Element) and x.tag == "li"]}
    if e.tag == "table":
        rows = [[c.text() for c in x.content if isinstance(c, Element) and c.tag in ("td", "th")] for x in e.walk() if x.tag == "tr"]
        return empty | {"type": "table", "rows": [r for r in rows if any(r)]}
    if e.tag == "div" and (kind := next((a for a in ADMONITIONS if a in e.names()), None)):
        return empty | {"type": "admonition", "text": f"{kind.upper()}: {e.text()}"}
    return None


def block_text(b: dict) -> str:
    if b["type"] == "list":
        return "\n".join(f"- {i}" for i in b["items"] if i)
    if b["type"] == "table":
        return "\n".join(" | ".join(r) for r in b["rows"])
    return b["text"] or ""


def page_sections(document_id: str, html: str | None) -> list[tuple]:
    """Section rows of a page, in page order; a section repeated with equal path and text comes once."""
    builder = _Builder()
    builder.feed(html or "")
    found: list[tuple[list[tuple[int, str]], list[dict]]] = [([], [])]
    path: list[tuple[int, str]] = []

    def walk(e: Element) -> None:
        nonlocal path
        loose: list[str] = []

        def flush() -> None:
            text = " ".join("".join(loose).split())
            loose.clear()
            if text:
                found[-1][1].append({"type": "paragraph", "text": text, "items": None, "rows": None, "language": None})

        for c in e.content:
            if isinstance(c, str):
                loose.append(c)
                continue
            if c.tag in PRUNED or c.tag in VOID:
                continue
            block = block_of(c)
            if c.tag in HEADINGS:
                flush()
                level = HEADINGS[c.tag]
                path = [x for x in path if x[0] < level] + [(level, c.text())]
                found.append((path, []))
            elif block is not None:
                flush()
                if block_text(block):
                    found[-1][1].append(block)
            elif c.tag in ("div", "section", "article", "main", "body", "header", "blockquote", "dl", "dd", "dt", "figure", "details", "html"):
                flush()
                walk(c)
            else:
                loose.append(c.text(True))
        flush()

    walk(container(builder.root))
    rows, seen = [], set()
    for own, blocks in found:
        text = "\n\n".join(filter(None, map(block_text, blocks)))
        section_path = " > ".join(t for _, t in own) or "Document"
        if not (text or own) or (section_path, text) in seen:
            continue
        seen.add((section_path, text))
        section_id = "sec_" + hashlib.sha1(f"{document_id}:{section_path}:{len(rows)}".encode()).hexdigest()[:16]
        raw = "\n\n".join(f"[{b['type'].upper()}]\n{block_text(b)}" for b in blocks)
        rows.append((document_id, len(rows), section_id, section_path, own[-1][1] if own else None, own[-1][0] if own else None, blocks, raw, text))
    return rows


def normalize_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Sections of every page, in a narrow stage."""
    names = [c.strip().split()[0] for c in ("document_id", "section_order", "section_id", "section_path", "heading", "level", "blocks", "raw_text", "cleaned_text")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for d, h in zip(pdf["d"], pdf["h"], strict=True) for r in page_sections(d, h)]
            out = pd.DataFrame(rows, columns=names)
            out["level"] = out["level"].astype("Int32")
            yield out

    return pages.selectExpr(f"cast({id_col} AS string) AS d", f"{html_col} AS h").mapInPandas(run, SECTIONS)
