"""Bibliographic functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

NA = "n/a"


def normalize_doi(c: Column) -> Column:
    return py_strip(F.regexp_replace(F.lower(py_strip(c)), "^(https?://(dx\\.)?doi\\.org/|doi\\.org/|doi:)", ""))


def point_id(name: Column, namespace: str = "6f1b2e2a-0d1e-4c8b-9a3a-2c7d5e9f00c3") -> Column:
    """A name-based UUID (version 5)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def strip_html(c: Column) -> Column:
    return F.nullif(py_strip(F.regexp_replace(c, "<[^>]+>", "")), F.lit(""))


def cc_variant(c: Column) -> Column:
    """BY, BY-NC, ... or 0 of a Creative Commons address or short form, else null."""
    url = "(?i)creativecommons\\.org/(?:licenses/([a-z-]+)|publicdomain/(zero))/(\\d+\\.\\d+)?"
    bare = F.regexp_extract(py_strip(c), "(?i)^cc[-_]?(by[a-z-]*|0)$", 1)
    return F.when(F.regexp_extract(c, url, 2) != "", "0").when(F.regexp_extract(c, url, 1) != "", F.upper(F.regexp_extract(c, url, 1))).when(bare != "", F.upper(bare))


def cc_version(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "(?i)creativecommons\\.org/(?:licenses/[a-z-]+|publicdomain/zero)/(\\d+\\.\\d+)", 1), F.lit(""))


def licence(first: Column, second: Column) -> Column:
    """The first source's licence, else the second's; a missing version is borrowed from the second only for the same variant."""
    raw = F.coalesce(first, second)
    borrowed = F.when(first.isNotNull() & (cc_variant(second) == cc_variant(first)), cc_version(second))
    version = F.coalesce(cc_version(raw), borrowed)
    name = F.concat(F.when(cc_variant(raw) == "0", "CC0").otherwise(F.concat(F.lit("CC-"), cc_variant(raw))), F.coalesce(F.concat(F.lit("-"), version), F.lit("")))
    warning = (
        F.when(raw.isNull(), "no licence information found in Crossref or Unpaywall")
        .when(cc_variant(raw).isNull(), "licence is not a CC variant")
        .when(version.isNull(), "licence version unknown")
    )
    return F.struct(F.when(raw.isNull(), "UNKNOWN").otherwise(F.coalesce(name, raw)).alias("licence"), warning.alias("warning"))


def initials(c: Column) -> Column:
    one = lambda t: F.array_join(F.transform(F.filter(F.split(t, "-"), lambda p: p != ""), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), "-")
    return F.array_join(F.filter(F.transform(F.split(py_strip(c), "\\s+"), one), lambda x: x != ""), " ")


def format_author(given: Column, family: Column) -> Column:
    return F.when(F.coalesce(py_strip(family), F.lit("")) != "", py_strip(F.concat(initials(F.coalesce(given, F.lit(""))), F.lit(" "), py_strip(family))))


def format_authors(names: Column) -> Column:
    n = F.size(names)
    return (
        F.when(n <= 0, NA)
        .when(n == 1, F.get(names, F.lit(0)))
        .when(n == 2, F.array_join(names, " and "))
        .otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(names, -1)))
    )


def format_pages(c: Column) -> Column:
    page = py_strip(c)
    a, b = py_strip(F.regexp_extract(page, "^([^-]*)-", 1)), py_strip(F.regexp_extract(page, "^[^-]*-(.*)$", 1))
    return (
        F.when(F.coalesce(page, F.lit("")) == "", f"pp. {NA}")
        .when((a != "") & (b != ""), F.concat(F.lit("pp. "), a, F.lit("–"), b))
        .otherwise(F.concat(F.lit("p. "), page))
    )


def format_licence(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", NA).otherwise(F.regexp_replace(py_strip(c), "(?i)^CC-?BY-?(\\d+\\.\\d+)$", "CC BY $1"))
