"""HTML pages to typed blocks and links: one pass of the standard parser over a batch of pages."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.urls import priority, uniform_link

# Removed elements (kept by tag, role, class and id, as the parser here knows no CSS selectors) and boilerplate.
REMOVED_TAGS = {"nav", "footer", "header", "aside", "script", "style", "noscript", "template", "svg", "form"}
REMOVED_ROLES = {"navigation", "banner", "contentinfo"}
REMOVED_CLASSES = ("footer", "header", "navbar", "nav-", "breadcrumb", "cookie", "sidebar", "copyright")
REMOVED_IDS = ("footer", "header", "nav", "cookie")
BOILERPLATE = r"(?:版权所有|copyright|all rights reserved|cookie policy|隐私政策|privacy policy|网站地图|返回顶部|技术支持)"

_BOILERPLATE = re.compile(BOILERPLATE, re.IGNORECASE)
_NOT_CONTENT = re.compile("[^0-9a-zı㐀-鿿]+")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags that end an open paragraph.
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_KINDS = {"p": "paragraph", "h1": "h1", "h2": "h2", "h3": "h3"}

BLOCK = T.StructType([T.StructField("content_type", T.StringType()), T.StructField("text", T.StringType())])
PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("meta_description", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("error", T.StringType())])


def display(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()


def normal(text: str) -> str:
    return _NOT_CONTENT.sub("", unicodedata.normalize("NFKC", text).lower())


def _is_removed(tag: str, attributes: dict[str, str]) -> bool:
    return tag in REMOVED_TAGS or attributes.get("role") in REMOVED_ROLES or any(x in attributes.get("class", "") for x in REMOVED_CLASSES) or any(x in attributes.get("id", "") for x in REMOVED_IDS)


class _Reader(HTMLParser):
    """Collects title, description, raw blocks and links; open elements are a stack of (tag, removed, block)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.description: str | None = None
        self.blocks: list[tuple[str, list[str]]] = []
        self.links: list[str] = []
        self.stack: list[tuple[str, bool, list[str] | None]] = []
        self.titled = False

    def handle_starttag(self, tag: str, found: list[tuple[str, str | None]]) -> None:
        attributes = {k: v or "" for k, v in reversed(found)}
        if tag == "a" and "href" in attributes:
            self.links.append(attributes["href"])
        if tag == "meta" and self.description is None and attributes.get("name", "").lower() == "description":
            self.description = attributes.get("content", "")
        if tag in _VOID:
            return
        if tag in _CLOSES_P and any(t == "p" for t, _, _ in self.stack):
            self._close("p")
        gone = bool(self.stack and self.stack[-1][1]) or _is_removed(tag, attributes)
        block = None
        if tag in _KINDS and not gone:
            block = []
            self.blocks.append((_KINDS[tag], block))
        if tag == "title" and self.title is None and not any(t == "svg" for t, _, _ in self.stack):
            self.title, self.titled = [], True
        self.stack.append((tag, gone, block))

    def _close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.titled = False
        self._close(tag)

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if self.titled and self.title is not None and piece:
            self.title.append(piece)
        elif piece and not (self.stack and self.stack[-1][1]):
            for _, _, block in self.stack:
                if block is not None:
                    block.append(piece)


def extract(html: str) -> dict:
    """title, meta_description and the page's distinct blocks, in order; a fault becomes `error` and fails no task."""
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except Exception as fault:  # noqa: BLE001  one bad page must not end a crawl
        return {"title": None, "meta_description": None, "blocks": [], "error": str(fault)[:180]}
    title = display(" ".join(reader.title)) if reader.title is not None else None
    description = display(reader.description) if reader.description is not None else None
    found = [("title", title)] * bool(title) + [("meta_description", description)] * bool(description)
    for kind, parts in reader.blocks:
        text = display(" ".join(parts))
        if len(normal(text)) >= (10 if kind == "paragraph" else 2) and not _BOILERPLATE.search(text):
            found.append((kind, text))
    first: dict[str, tuple[str, str]] = {}
    for kind, text in found:
        first.setdefault(normal(text), (kind, text))
    return {"title": title, "meta_description": description, "blocks": [{"content_type": k, "text": t} for k, t in first.values()], "error": None}


def targets(html: str, base: str) -> list[str]:
    """Absolute targets of all links of the whole page, navigation included; links to a place on the page are left out."""
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except Exception:  # noqa: BLE001  what was read before the fault counts
        pass
    out = []
    for href in reader.links:
        if (href := href.strip())[:1] not in ("", "#"):
            try:
                out.append(urljoin(base, href))
            except ValueError:  # not a URL
                continue
    return list(dict.fromkeys(out))


@F.pandas_udf(PAGE)
def extract_page(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(x or "") for x in html], columns=["title", "meta_description", "blocks", "error"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_targets(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([targets(h or "", b or "") for h, b in zip(html, base, strict=True)])


def internal_links(found: Column, base: Column, domain: Column, allowed: Column | None = None) -> Column:
    """The distinct internal ones of extract_targets()' links, in uniform form and crawl order; `allowed` names query parameters to keep.

    Take `found` from a column, not from the function itself, or each use parses the page again.
    """
    uniform = F.array_distinct(F.filter(F.transform(found, lambda x: uniform_link(x, base, domain, allowed)), lambda x: x.isNotNull()))
    return F.transform(F.array_sort(F.transform(uniform, priority)), lambda p: p["url"])


def title_markup(html: Column) -> Column:
    """The first title element that stands on one line, as written: &lt; &gt; and &amp; become characters, all else stays; no such element: empty.

    extract_page() reads the title as a browser does, other and unfinished entities too. White space is SQL's: a line tabulation is none.
    """
    found = F.regexp_extract(html, r"<title>([^\n]*?)</title>", 1)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        found = F.replace(found, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(found, r"[\t\n\f\r ]+", " "), r"\A\p{Zs}+|\p{Zs}+\z", "")


def is_html(body: Column, content_type: Column | None = None) -> Column:
    """By content type, or by a doctype at the start of the body."""
    by_body = body.rlike(r"(?i)^[\s\x1c-\x1f\x85\xa0]*<!doctype html")
    return by_body if content_type is None else F.contains(F.lower(content_type), F.lit("html")) | by_body


def is_boilerplate(text: Column) -> Column:
    return text.rlike("(?iu)" + BOILERPLATE)
