"""Units of text out of markup: headings carry forward to the paragraphs below them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_ws, section_type

SKIP = {"script", "style", "nav", "footer", "head"}
BLOCKS = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption", "td", "blockquote"}


class _Walker(HTMLParser):
    """(kind, level, text) in the order of the page; forgiving of unclosed tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.units, self.skipped, self.open, self.text = [], 0, None, []

    def close_unit(self):
        if self.open and "".join(self.text).strip():
            kind = "heading" if self.open[0] == "h" else "caption" if "caption" in self.open else "section"
            self.units.append((kind, int(self.open[1]) if kind == "heading" else 0, "".join(self.text)))
        self.open, self.text = None, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skipped += tag != "head"
        elif tag in BLOCKS:
            self.close_unit()
            self.open = tag
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skipped = max(0, self.skipped - (tag != "head"))
        elif tag in BLOCKS:
            self.close_unit()

    def handle_data(self, data):
        if self.open and not self.skipped:
            self.text.append(data)


def markup_units(pages: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """id, unit_pos, kind, raw_text, section_heading, parent_heading, section_type of every unit; a page that fails yields none."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, html in zip(frame["id"], frame["html"]):
                w = _Walker()
                try:
                    w.feed(html or "")
                    w.close_unit()
                except (ValueError, AssertionError):
                    continue
                out += [(i, k, *u) for k, u in enumerate(w.units)]
            yield pd.DataFrame(out, columns=["id", "unit_pos", "kind", "level", "raw"])

    raw = pages.select(F.col(id_col).alias("id"), F.col(markup_col).alias("html")).mapInPandas(walk, "id long, unit_pos int, kind string, level int, raw string")
    to_here = Window.partitionBy("id").orderBy("unit_pos").rowsBetween(Window.unboundedPreceding, 0)
    raw = raw.withColumn("raw_text", clean_ws(F.col("raw")))
    head = F.when(F.col("kind") == "heading", F.col("raw_text"))
    carried = raw.select("id", "unit_pos", "kind", "raw_text", F.last(head, True).over(to_here).alias("section_heading"), F.last(F.when(F.col("level") == 1, head), True).over(to_here).alias("parent_heading"))
    return carried.where("kind <> 'heading'").withColumn("section_type", section_type(F.col("parent_heading"))).withColumnRenamed("id", id_col)
