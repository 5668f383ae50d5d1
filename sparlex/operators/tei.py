"""Papers in TEI markup to header, units and warnings.

The markup is walked once inside Arrow batches, which yields rows in document order; headings, levels,
exclusions and what carries forward are column expressions and windows over those rows.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

NS = "{http://www.tei-c.org/ns/1.0}"
# The dash between two citations, divisions that are left out, what a table's or figure's caption looks like.
DASH = re.compile(r"\s*[-–]\s*")
EXCLUDED = "(?i)references|bibliography|acknowledg"
CAPTION = "(?s)^(?:TABLE|FIGURE)\\s+\\d+\\.\\s+\\S.*$"
HEADER = "title string, authors array<string>, doi string, venue string, date string, fallback_date string"


def _local(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _is_citation(e) -> bool:
    return _local(e) == "ref" and e.get("type") == "bibr"


def inline_text(e) -> str:
    """Text in order; citations and formulas go but what follows them stays, except a lone dash between two citations."""
    parts, kids = [e.text or ""], list(e)
    for k, kid in enumerate(kids):
        if not _is_citation(kid) and _local(kid) != "formula":
            parts.append(inline_text(kid))
        between = _is_citation(kid) and k + 1 < len(kids) and _is_citation(kids[k + 1])
        if not (between and DASH.fullmatch(kid.tail or "")):
            parts.append(kid.tail or "")
    return "".join(parts)


def _ws(text: str) -> str:
    return " ".join(text.split())


def _date(e) -> str | None:
    return None if e is None else e.get("when") or e.text


def _header(root) -> str:
    find = lambda path: root.find(".//" + "/".join(NS + x for x in path.split("/")))
    text = lambda e: None if e is None else _ws(inline_text(e)) or None
    authors = []
    for person in root.findall(f".//{NS}sourceDesc/{NS}biblStruct//{NS}analytic/{NS}author/{NS}persName"):
        authors.append(" ".join(x for kid in person if _local(kid) in ("forename", "surname") and (x := _ws(inline_text(kid)))))
    doi = root.find(f".//{NS}sourceDesc/{NS}biblStruct//{NS}idno[@type='DOI']")
    return json.dumps({
        "title": text(find("titleStmt/title")), "authors": [a for a in authors if a], "doi": (doi.text or "").strip() or None if doi is not None else None,
        "venue": text(find("sourceDesc/biblStruct/monogr/title")), "date": _date(find("sourceDesc/biblStruct/monogr/imprint/date")), "fallback_date": _date(find("publicationStmt/date")),
    })


def walk(xml: str | bytes) -> list[tuple]:
    """(kind, division head, its n attribute, whether it is an acknowledgement, text, equation) in document order."""
    root = ET.fromstring(xml)
    has = lambda e: e.find(f".//{NS}formula") is not None
    out = [("header", None, None, False, _header(root), False)]
    abstract = root.find(f".//{NS}profileDesc/{NS}abstract")
    if abstract is not None:
        ps = abstract.findall(f".//{NS}p")
        text = "\n".join(map(inline_text, ps)) if ps else inline_text(abstract)
        if ps or text.strip():
            out.append(("abstract", None, None, False, text, any(map(has, ps)) if ps else has(abstract)))
    body = root.find(f".//{NS}text/{NS}body")
    for e in body if body is not None else ():
        if _local(e) == "div":
            head = e.find(f"{NS}head")
            own = ("" if head is None else inline_text(head), "" if head is None else head.get("n") or "", e.get("type") == "acknowledgement")
            out.append(("div", *own, "", False))
            out += [("p", *own, inline_text(p), has(p)) for p in e.findall(f"{NS}p")]
        elif _local(e) == "figure":
            out += [("figure", None, None, False, inline_text(d), has(d)) for d in e.findall(f"{NS}figDesc")]
    return out


def tei_rows(papers: DataFrame, id_col: str = "paper_id", markup_col: str = "tei") -> DataFrame:
    """paper_id, pos, kind, head, n, acknowledgement, raw, equation; a paper that can't be read has one row of kind error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, xml in zip(frame["i"], frame["x"]):
                try:
                    rows = walk(xml)
                except (ET.ParseError, TypeError, ValueError) as e:
                    rows = [("error", None, None, False, str(e), False)]
                out += [(i, k, *r) for k, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["paper_id", "pos", "kind", "head", "n", "acknowledgement", "raw", "equation"])

    kind = papers.schema[id_col].dataType.simpleString()
    return papers.select(F.col(id_col).alias("i"), F.col(markup_col).alias("x")).mapInPandas(run, f"paper_id {kind}, pos int, kind string, head string, n string, acknowledgement boolean, raw string, equation boolean")


def headers(rows: DataFrame) -> DataFrame:
    h = rows.where("kind = 'header'").select("paper_id", F.from_json("raw", HEADER).alias("h"))
    abstract = rows.where("kind = 'abstract'").select("paper_id", X.clean_ws(X.strip_citations(F.col("raw"))).alias("abstract"))
    year = F.coalesce(X.parse_year(F.col("h.date")), X.parse_year(F.col("h.fallback_date")))
    return h.select("paper_id", "h.title", "h.authors", year.alias("year"), "h.venue", "h.doi").join(abstract, "paper_id", "left")


def units(rows: DataFrame) -> DataFrame:
    """Units in order (unit_pos) with heading, level, parent, section type and composition, and the warning of their division."""
    head = X.clean_ws(X.strip_citations(F.col("head")))
    kept = rows.where("kind in ('div', 'p', 'figure', 'abstract')").withColumn("heading", F.coalesce(head, F.lit("")))
    kept = kept.where(~F.col("acknowledgement") & ~F.col("heading").rlike(EXCLUDED))
    c = F.col("heading")

    def worked_out(df, **columns):
        """df with the columns, each worked out once: no later expression is put together with theirs into one large method."""
        return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))

    kept = worked_out(kept, merged=X.merged_heading(c), token=F.when(X.py_strip(F.coalesce("n", F.lit(""))) != "", X.py_strip(F.col("n"))).otherwise(c))
    untitled, merged, token = c == "", F.col("merged"), F.col("token")
    split = merged.isNotNull()
    kept = worked_out(kept, plain=F.when(untitled, True).when(split, False).otherwise(X.heading_unnumbered(token)), level=F.when(untitled, 1).when(split, 2).otherwise(X.heading_level(token)), odd=X.junk_heading(c))
    unnumbered, level = F.col("plain"), F.col("level")
    junk = ~untitled & ~split & unnumbered & F.col("odd")
    carries = F.when(untitled, None).when(split, merged["parent"]).when((level == 1) & ~junk, c)
    to_here = Window.partitionBy("paper_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_div = F.col("kind") == "div"
    warning = F.when(split, F.concat(F.lit("split merged heading: "), c)).when(junk, F.concat(F.lit("heading classified as junk: "), c))
    own = F.struct(
        F.when(untitled, "(untitled section)").when(split, merged["child"]).otherwise(c).alias("section_heading"), level.alias("section_level"), unnumbered.alias("heading_unnumbered"), junk.alias("heading_junk"), warning.alias("warning"),
    )
    at = kept.select(
        "*", F.last(F.when(is_div, own), True).over(to_here).alias("ctx"), F.last(F.when(is_div, carries), True).over(to_here).alias("parent"), (F.count_if(is_div).over(to_here) - 1).cast("int").alias("section_index"),
    ).where(~is_div)
    raw, is_abstract = X.strip_citations(F.col("raw")), F.col("kind") == "abstract"
    stats = X.char_stats(raw)
    no_div = F.col("ctx").isNull()
    kind = F.when(is_abstract, "abstract").when((F.col("kind") == "figure") | X.clean_ws(raw).rlike(CAPTION), "caption").otherwise("section")
    return at.select(
        "paper_id", (F.row_number().over(Window.partitionBy("paper_id").orderBy("pos")) - 1).alias("unit_pos"), kind.alias("type"),
        F.when(is_abstract, "Abstract").when(no_div, None).otherwise(F.col("ctx.section_heading")).alias("section_heading"), F.when(is_abstract, -1).otherwise(F.col("section_index")).alias("section_index"),
        F.when(~is_abstract, F.col("ctx.section_level")).alias("section_level"), F.coalesce(F.when(~is_abstract, F.col("ctx.heading_unnumbered")), F.lit(False)).alias("heading_unnumbered"),
        F.coalesce(F.when(~is_abstract, F.col("ctx.heading_junk")), F.lit(False)).alias("heading_junk"), F.when(~is_abstract, F.col("parent")).alias("parent_heading"),
        F.when(is_abstract, "abstract").otherwise(X.section_type(F.col("parent"))).alias("section_type"), raw.alias("raw_text"), F.col("equation").alias("contains_equation"),
        stats["n_pua"].alias("n_pua_chars"), stats["n_replacement"].alias("n_replacement_chars"), stats["non_ascii_ratio"].alias("non_ascii_ratio"), F.when(~is_abstract, F.col("ctx.warning")).alias("warning"),
    )
