"""Text functions of the engine as column expressions (code points, Python's notion of white space)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WS = "(?U)[\\s\\x1c-\\x1f]"  # what Python's \s and str.isspace cover
SPACES = f"{WS}+"


def clean_ws(c: Column) -> Column:
    """White-space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def py_strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}+$", "")


def py_lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+", "")


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(StringType())
def accent_fold(x: pd.Series) -> pd.Series:
    """Decomposed, without combining marks, case-folded."""
    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold())


def normalize_text(c: Column, nfkc: bool = True) -> Column:
    """The canonical text: compatibility form, single spaces, no space around closing and opening marks, citation debris collapsed."""
    if nfkc:
        c = F.when(c.rlike("[^\\x00-\\x7F]"), _nfkc(c)).otherwise(c)
    c = F.regexp_replace(c, SPACES, " ")
    c = F.regexp_replace(c, " +([.,;:!?)\\]}%])", "$1")
    c = F.regexp_replace(c, "([(\\[{]) +", "$1")
    for old, new in ((",,", ","), (", ,", ","), (". ,", "."), (" ,", ",")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def strip_citations(c: Column) -> Column:
    """Bracketed number ranges, then bracketed numbers, are removed."""
    c = F.regexp_replace(c, "(?U)\\[\\d+\\](?:\\s*[-–]\\s*\\[\\d+\\])+", "")
    return F.regexp_replace(c, "(?U)\\[\\d+\\]", "")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def paper_slug(name: Column) -> Column:
    """The paper id of a file name: its stem as a slug; a name that leaves nothing is an error."""
    slug = slugify(F.regexp_replace(name, "(?<=.)\\.[^.]*$", ""))
    return F.when(slug == "", F.raise_error(F.concat(F.lit("no paper id in the file name "), name)).cast("string")).otherwise(slug)


def char_stats(c: Column) -> Column:
    """Private-use and replacement characters, share outside ASCII."""
    return F.struct(
        F.regexp_count(c, F.lit("[\\uE000-\\uF8FF]")).alias("n_pua"),
        F.regexp_count(c, F.lit("\\uFFFD")).alias("n_replacement"),
        F.when(F.length(c) > 0, F.regexp_count(c, F.lit("[^\\x00-\\x7F]")) / F.length(c)).otherwise(F.lit(0.0)).alias("non_ascii_ratio"),
    )


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?U)[^\\s\\x1c-\\x1f]+"), F.lit(0))


def tokens(c: Column) -> Column:
    """The default analyser: lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def content_tokens(c: Column) -> Column:
    """The default token counter: a word of n characters is ceil(n / 4) tokens; additive over white space."""
    return F.aggregate(words(c), F.lit(0), lambda a, w: a + F.ceil(F.length(w) / 4).cast("int"))


# How headings are numbered.
ROMAN, LETTER, LOWER = "^([MDCLXVI]+)\\.(?=\\s|$)", "^([A-Z])\\.(?=\\s|$)", "^([a-z])[:)](?=\\s|$)"


def heading_level(c: Column) -> Column:
    """1 for roman numbers, 2 for capitals, 3 for small letters and digits in brackets, else the components of a dotted number; 1 without a number."""
    roman = F.regexp_extract(c, ROMAN, 1)
    dotted = F.regexp_extract(c, "^((?:\\d+\\.)+)(?=\\s|$)", 1)
    return (
        F.when((roman == "I") | (F.length(roman) >= 2), 1)
        .when(c.rlike(LETTER), 2)
        .when(c.rlike(LOWER), 3)
        .when(c.rlike("^(\\d+)\\)(?=\\s|$)"), 3)
        .when(dotted != "", F.regexp_count(dotted, F.lit("\\.")))
        .otherwise(1)
    )


def heading_unnumbered(c: Column) -> Column:
    roman = F.regexp_extract(c, ROMAN, 1)
    return ~((roman == "I") | (F.length(roman) >= 2) | c.rlike(LETTER) | c.rlike(LOWER) | c.rlike("^(\\d+)\\)(?=\\s|$)") | c.rlike("^(?:\\d+\\.)+(?=\\s|$)"))


def merged_heading(c: Column) -> Column:
    """(parent, child) of a heading that holds a first-level title and then a second-level one, else null."""
    found = F.regexp_extract(c, "(?s)^((?:I|[MDCLXVI]{2,})\\.(?=\\s)(?:.*?))\\s(?=[A-Z]\\.(?:\\s|$))", 1)
    parent = F.regexp_replace(found, "\\s+$", "")
    child = F.regexp_replace(F.substr(c, F.length(found) + 1), "^\\s+", "")
    return F.when((found != "") & (child != ""), F.struct(parent.alias("parent"), child.alias("child")))


def title_case(c: Column) -> Column:
    """Python's istitle()."""
    cased = "[\\p{Lu}\\p{Ll}\\p{Lt}]"
    return c.rlike("[\\p{Lu}\\p{Lt}]") & ~c.rlike(f"(?<!{cased})\\p{{Ll}}") & ~c.rlike(f"(?<={cased})[\\p{{Lu}}\\p{{Lt}}]")


def junk_heading(c: Column) -> Column:
    return (c != "") & (
        c.rlike("[.,;:]$") | (F.length(c) > 80) | (c.rlike("(?U)\\b[a-z]{4,}\\b") & ~title_case(c)) | c.rlike("(?i)^(?:Algorithm|Figure|Fig\\.|Table|Listing)\\s*\\d")
    )


# Section types and the words that mark them, the first that is found in this order.
SECTION_TYPES = (
    ("introduction", ("introduction",)),
    ("related_work", ("related work", "prior work", "background", "literature review")),
    ("system_model", ("system model", "network model", "channel model", "system architecture", "problem formulation")),
    ("methods", ("method", "methodology", "proposed", "approach", "algorithm", "implementation")),
    ("results", ("result", "evaluation", "performance", "experiment", "simulation")),
    ("discussion", ("discussion",)),
    ("conclusion", ("conclusion", "summary", "future work")),
)


def section_type(c: Column) -> Column:
    out = F.lit("other")
    for name, keys in reversed(SECTION_TYPES):
        out = F.when(F.lower(c).rlike("|".join(keys)), name).otherwise(out)
    return F.when(c.isNull() | (c == ""), "other").otherwise(out)


def parse_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "\\b(1[5-9]\\d{2}|20\\d{2})\\b", 1), F.lit("")).cast("int")


def kwic(text: Column, start: Column, end: Column, width: int = 100) -> Column:
    """The span in double brackets with up to width characters around it."""
    a, b = F.greatest(start - width, F.lit(0)), F.least(end + width, F.length(text))
    return F.concat(
        F.when(a > 0, "...").otherwise(""), F.substr(text, a + 1, start - a), F.lit("[["), F.substr(text, start + 1, end - start), F.lit("]]"),
        F.substr(text, end + 1, b - end), F.when(b < F.length(text), "...").otherwise(""),
    )


# What a reply begins with that declines, and what follows it is stripped of.
ABSTAIN, ABSTAIN_STRIP = "NO_ANSWER_IN_CONTEXT", " :.-\n"


def strip_reasoning(c: Column) -> Column:
    return F.regexp_replace(c, "(?is)^\\s*<think>.*?</think>\\s*", "")


def abstained(c: Column) -> Column:
    return F.startswith(py_lstrip(c), F.lit(ABSTAIN))


def abstention_text(c: Column) -> Column:
    return F.when(abstained(c), F.ltrim(F.substr(py_lstrip(c), F.lit(len(ABSTAIN) + 1)), F.lit(ABSTAIN_STRIP))).otherwise(c)


def cited(c: Column) -> Column:
    """Distinct cited numbers in the order they appear."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("\\[(\\d+)\\]"), F.lit(1)), lambda x: x.cast("int")))


# Fixed value: how a refusal in prose reads.
PROSE_REFUSAL = (
    "(?i)(?:(?:do(?:es)?\\s+not|don'?t|cannot|can'?t|couldn'?t)[^.]{0,50}"
    "(?:cover|contain|address|discuss|mention|provide|include|answer|have[^.]{0,20}information))"
    "|(?:(?:not\\s+enough|insufficient|no\\s+(?:relevant\\s+)?)\\s*information)"
    "|(?:not\\s+(?:covered|contained|addressed|mentioned|discussed)\\s+in\\s+the[^.]{0,20}(?:sources|passages|context))"
)


def prose_refusal(text: Column, has_citations: Column) -> Column:
    return ~abstained(text) & ~has_citations & (text != "") & text.rlike(PROSE_REFUSAL)
