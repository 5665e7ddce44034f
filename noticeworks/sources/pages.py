"""HTML pages: their links and readable text, by the standard parser, a row at a time."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not text of the page (fixed values), and those that end a line.
HIDDEN = {"script", "style", "noscript", "nav", "header", "footer", "template"}
BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "ul", "ol", "td", "title"}
FILES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip")
LEAST_TITLE = 18


class Page(HTMLParser):
    def __init__(self, hidden: set[str] = HIDDEN) -> None:
        super().__init__(convert_charrefs=True)
        self.kinds = hidden
        self.hidden, self.text, self.links, self.open = 0, [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in self.kinds:
            self.hidden += 1
        if tag in BREAKS:
            self.text.append("\n")
        if tag == "a" and not self.hidden:
            a = dict(attrs)
            self.open = [a.get("href") or "", a.get("title") or "", []]

    def handle_endtag(self, tag):
        if tag in self.kinds and self.hidden:
            self.hidden -= 1
        if tag in BREAKS:
            self.text.append("\n")
        if tag == "a" and self.open:
            href, title, words = self.open
            self.links.append((href, " ".join("".join(words).split()) or title))
            self.open = None

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.open:
                self.open[2].append(data)


def parsed(html: str | None, hidden: set[str] = HIDDEN) -> Page:
    page = Page(hidden)
    page.feed(html or "")
    page.close()
    return page


def page_text(html: str | None) -> str | None:
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(parsed(html).text).splitlines())
    return "\n".join(line for line in lines if line) or None


def page_links(url: str | None, html: str | None, least: int = LEAST_TITLE, chrome: bool = False) -> list[tuple[str, str]]:
    """(address, title) of candidate links: no anchors, titles long enough, each address once, files of this site only.

    chrome: links of menus, headers and footers too.
    """
    seen, out = set(), []
    for href, title in parsed(html, {"script", "style", "noscript", "template"} if chrome else HIDDEN).links:
        if not href or href.startswith(("#", "mailto:", "tel:", "javascript:")) or len(title) < least:
            continue
        try:
            full = urldefrag(urljoin(url or "", href)).url
            parts = urlsplit(full)
            elsewhere = parts.hostname != urlsplit(url or "").hostname
        except ValueError:
            continue
        if full in seen or full == urldefrag(url or "").url or (elsewhere and parts.path.lower().endswith(FILES)):
            continue
        seen.add(full)
        out.append((full, title))
    return out


# Plain functions of a row take a hundred pages at a time; an Arrow batch holds ten thousand.


def links(pages: DataFrame, least: int = LEAST_TITLE, chrome: bool = False) -> DataFrame:
    """page_id, url, title of the links of each page (page_id, url, html)."""
    found = F.udf(lambda url, html: page_links(url, html, least, chrome), "array<struct<url: string, title: string>>", useArrow=False)
    return pages.select("page_id", F.explode(found("url", "html")).alias("link")).select(F.col("page_id").cast("long"), "link.url", "link.title")


def readable_text(pages: DataFrame, *keep: str) -> DataFrame:
    """page_id and its text without menus, scripts and footers, a line a block, and the columns that are named."""
    return pages.select(F.col("page_id").cast("long"), F.udf(page_text, "string", useArrow=False)("html").alias("text"), *keep)
