"""Post-like elements of web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CLASSES = {"post", "item", "entry", "result"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Items(HTMLParser):
    """Text and first heading of each element that is an article or has an item class."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict | None]] = []
        self.items: list[dict] = []
        self.raw = 0

    def handle_starttag(self, tag, attrs):
        classes = set((dict(attrs).get("class") or "").split())
        self.raw += tag in ("script", "style")
        if tag in _VOID:
            return
        item = {"text": [], "title": None} if tag == "article" or classes & _CLASSES else None
        if item is not None:
            self.items.append(item)
        heads = tag in ("h2", "h3") or "title" in classes
        self.open.append((tag, item))
        if heads:
            for _, i in self.open:
                if i is not None and i["title"] is None:
                    i["title"] = []
                    i["heading"] = len(self.open)

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style") and self.raw > 0
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for i in self.items:
                    if i.get("heading", 0) > k:
                        i["heading"] = 0
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.raw:
            return
        for _, i in self.open:
            if i is not None:
                i["text"].append(data)
                if i.get("heading"):
                    i["title"].append(data)


def html_items(pages: DataFrame) -> DataFrame:
    """(page_id, nth, id, title, content, score) of the post-like elements of each page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page, html in zip(f["page_id"], f["html"], strict=True):
                p = _Items()
                p.feed(html or "")
                for n, i in enumerate(p.items):
                    rows.append((page, n, f"post_{n}", " ".join("".join(i["title"] or []).split()) or None, " ".join("".join(i["text"]).split())[:500], 0))
            yield pd.DataFrame(rows, columns=["page_id", "nth", "id", "title", "content", "score"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInPandas(run, "page_id long, nth int, id string, title string, content string, score int")
