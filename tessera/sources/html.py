"""HTML pages to element rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

BLOCKS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "li": "list", "figcaption": "paragraph", "td": "paragraph"}
SKIPPED = {"script", "style", "nav", "template", "noscript"}
ROW = "page_id long, `order` int, element_type string, heading_level int, text string"


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.skip, self.open = [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS and not self.skip:
            self._end()
            self.open = (tag, [])

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.open and tag == self.open[0]:
            self._end()

    def handle_data(self, data):
        if self.open and not self.skip:
            self.open[1].append(data)

    def _end(self):
        if self.open:
            tag, text = self.open[0], " ".join("".join(self.open[1]).split())
            if text:
                self.rows.append((BLOCKS[tag], int(tag[1]) if tag[0] == "h" else None, text))
        self.open = None


def blocks(html: str | None) -> list[tuple[str, int | None, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._end()
    return parser.rows


def elements(pages: DataFrame) -> DataFrame:
    """ROW of every heading, paragraph and list item, in order; navigation, scripts and styles are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, *b) for p, html in zip(batch["page_id"], batch["html"]) for i, b in enumerate(blocks(html))]
            yield pd.DataFrame(rows, columns=["page_id", "order", "element_type", "heading_level", "text"]).astype({"heading_level": "Int32"})

    return pages.select("page_id", "html").mapInPandas(run, ROW)
