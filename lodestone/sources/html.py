"""HTML pages as text and blocks."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SKIPPED = {"script", "style", "noscript", "template"}
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_BREAKS = {"p", "div", "li", "ul", "ol", "section", "article", "br", "tr", "blockquote", "nav", "header", "footer", *_HEADINGS}


def visible_text(c: Column) -> Column:
    """Text without markup, scripts, comments and entities, blanks collapsed; built-in functions only."""
    t = F.regexp_replace(c, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"&[a-z]+;", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


class _Blocks(HTMLParser):
    """Collects (kind, text): headings with #, tables as rows of cells, other text runs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self._text: list[str] = []
        self._skip = self._table = 0
        self._rows: list[list[str]] = []
        self._kind = "text"

    def _end(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.out.append((self._kind, text))
        self._text, self._kind = [], "text"

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self._skip += 1
        elif tag == "table":
            self._end()
            self._table += 1
            self._rows = []
        elif self._table and tag == "tr":
            self._rows.append([])
        elif self._table and tag in ("td", "th"):
            self._rows = self._rows or [[]]
            self._rows[-1].append("")
        elif tag in _BREAKS:
            self._end()
            if tag in _HEADINGS:
                self._kind = "heading"
                self._text = ["#" * _HEADINGS[tag] + " "]

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self._skip = max(0, self._skip - 1)
        elif tag == "table" and self._table:
            self._table -= 1
            rows = [" | ".join(" ".join(c.split()) for c in r) for r in self._rows if r]
            if rows:
                self.out.append(("table", "\n".join(rows)))
        elif tag in _BREAKS and not self._table:
            self._end()

    def handle_data(self, data):
        if self._skip:
            return
        if self._table:
            if self._rows and self._rows[-1]:
                self._rows[-1][-1] += data
        else:
            self._text.append(data)

    def close(self):
        super().close()
        self._end()


def parse_blocks(html: str | None) -> list[tuple[str, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return parser.out


def split_table(rows: list[str], tokens: int) -> list[str]:
    """Tables of at most ``tokens`` (a quarter of the characters) each, the header row repeated."""
    head, *body = rows
    out, current = [], [head]
    for row in body:
        if len(current) > 1 and sum(len(r) + 1 for r in [*current, row]) // 4 > tokens:
            out.append("\n".join(current))
            current = [head]
        current.append(row)
    return [*out, "\n".join(current)]


def blocks(pages: DataFrame, id_col: str, html_col: str, tokens: int) -> DataFrame:
    """(id, idx, kind, text) of each page; text runs merge up to the budget, tables split by it."""

    def task(batches):
        for pdf in batches:
            rows = []
            for key, page in zip(pdf[id_col], pdf[html_col], strict=True):
                merged: list[tuple[str, str]] = []
                for kind, text in parse_blocks(page):
                    if kind == "table":
                        merged += [("table", part) for part in split_table(text.split("\n"), tokens)]
                    elif kind == "text" and merged and merged[-1][0] != "table" and (len(merged[-1][1]) + len(text)) // 4 <= tokens:
                        merged[-1] = (merged[-1][0], merged[-1][1] + "\n" + text)
                    else:
                        merged.append((kind, text))
                rows += [(key, i, kind, text) for i, (kind, text) in enumerate(merged)]
            yield pd.DataFrame(rows, columns=["id", "idx", "kind", "text"])

    return pages.select(id_col, html_col).mapInPandas(task, "id long, idx int, kind string, text string")
