"""HTML pages to sections. A page's tree is walked in Python, batch by batch; everything after is columns."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SKIPPED = {"script", "style", "noscript", "template"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3}
BLOCKS = {"p", "li", "td"}


class _Sections(HTMLParser):
    """Collects (trail of headings, blocks); a block inside another belongs to the outer one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip = 0
        self.trail: list[str | None] = [None, None, None]
        self.open: list[str] = []
        self.buffer: list[str] = []
        self.out: list[tuple[list[str], list[str]]] = [([], [])]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag in HEADINGS or tag in BLOCKS:
            if tag == "p" and self.open == ["p"]:
                self._close()  # an open paragraph ends where the next begins
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in self.open:
            while self.open and self.open[-1] != tag:
                self.open.pop()
            if len(self.open) == 1:
                self._close()
            else:
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and not self.skip:
            self.buffer.append(data)

    def _close(self) -> None:
        tag, text = self.open.pop(0), " ".join(" ".join(self.buffer).split())
        self.open, self.buffer = [], []
        if not text:
            return
        if tag in HEADINGS:
            level = HEADINGS[tag]
            self.trail[level - 1 :] = [text, *[None] * (3 - level)]
            self.out.append(([x for x in self.trail if x], []))
        else:
            self.out[-1][1].append(f"- {text}" if tag == "li" else text)

    def sections(self, html: str) -> list[tuple[list[str], list[str]]]:
        self.feed(html)
        self.close()
        if self.open:
            self.open = self.open[:1]
            self._close()
        return [x for x in self.out if x[1]]


def parse_sections(html: str | None) -> list[tuple[list[str], list[str]]]:
    return _Sections().sections(html or "")


def html_sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, section, heading, breadcrumb, blocks) of the sections of each page that hold a block."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, t[-1] if t else None, " > ".join(t), b) for k, text in zip(batch[key], batch[html], strict=True) for i, (t, b) in enumerate(parse_sections(text))]
            yield pd.DataFrame(rows, columns=[key, "section", "heading", "breadcrumb", "blocks"], dtype=object)

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, section int, heading string, breadcrumb string, blocks array<string>")
