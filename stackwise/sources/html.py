"""HTML to Markdown, keeping headings, lists, emphasis, links and code."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stackwise.session import ship

# Elements left out, elements that are blocks.
SKIPPED = frozenset("head script style noscript nav footer aside form iframe svg canvas template".split())
BLOCKS = frozenset("p div section article main header blockquote ul ol table tr figure figcaption dl dt dd address".split())
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S)


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.lists: list[list] = []
        self.links: list[str] = []
        self.pre = 0
        self.prefix = ""

    def block(self) -> None:
        self.out.append("\n\n")

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
            return
        if tag in SKIPPED:
            self.skip.append(tag)
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag in BLOCKS:
            self.block()
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "br":
            self.out.append("\n" if self.pre else "  \n")
        elif tag == "hr":
            self.out.append("\n\n* * *\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in ("td", "th"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.block()
        elif tag in BLOCKS or len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.block()
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_markdown(source: str) -> str:
    p = _Markdown()
    p.feed(source)
    p.close()
    lines, fence = [], False
    for line in "".join(p.out).split("\n"):
        if line.strip() == "```":
            fence = not fence
        if not fence:
            indent = re.match(r" *(?=(?:-|\d+\.) )", line)
            line = (indent[0] if indent else "") + line.strip()
        lines.append(line)
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_document(source: str) -> tuple[str, str]:
    """(title, Markdown)."""
    m = _TITLE.search(source)
    return (html.unescape(m[1]).strip() if m else ""), html_markdown(source)


def with_markdown(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with markdown_title and markdown."""
    ship(pages.sparkSession)

    @F.pandas_udf("markdown_title string, markdown string")
    def run(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_document(x or "") for x in sources], columns=["markdown_title", "markdown"])

    return pages.withColumn("_m", run(html_col)).select(*pages.columns, "_m.*")
