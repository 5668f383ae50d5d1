"""Functions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from sparlex.functions import metadata as M
from sparlex.functions import text as X
from sparlex.functions.answers import context_block, read_reply


def each(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r[1] for r in sorted(df.select("i", f(F.col("v")).alias("o")).collect())]


def test_normalize(spark):
    messy = "\n        The ﬁnal results confirm the trend reported in\n        2024 , which matches the theoretical prediction ( see Fig. 3 ) .\n    "
    debris = "citation debris: value , , next . , then ,,  more   spaces (  nested ( parens ) )"
    out = each(spark, [messy, "already clean text with no artifacts.", "", "   \n\t  ", debris, ",,,", None], X.normalize_text)
    assert out[0] == "The final results confirm the trend reported in 2024, which matches the theoretical prediction (see Fig. 3)."
    assert out[1:4] == ["already clean text with no artifacts.", "", ""] and out[5:] == [",,", None]
    assert each(spark, [out[4]], X.normalize_text) == [out[4]]


def test_headings(spark):
    heads = ["I. INTRODUCTION", "VIII. END", "C. Title", "a) thing", "b: thing", "12) thing", "2.1. Sub", "3. Top", "CONCLUSION", "Iota. x"]
    assert each(spark, heads, X.heading_level) == [1, 1, 2, 3, 3, 3, 2, 1, 1, 1]
    assert each(spark, heads, X.heading_unnumbered) == [False] * 8 + [True, True]
    merged = ["II. RELATED WORK A. LIGHT APPLICATIONS", "II. RELATED WORK A.", "C. X A. Y", "I. A. Both"]
    assert [tuple(x) if x else None for x in each(spark, merged, X.merged_heading)] == [("II. RELATED WORK", "A. LIGHT APPLICATIONS"), ("II. RELATED WORK", "A."), None, ("I.", "A. Both")]
    junk = ["Funding:", "x" * 81, "the generation of things", "Proper Title Here", "Table 3", "CONCLUSION", ""]
    assert each(spark, junk, X.junk_heading) == [True, True, True, False, True, False, False]
    assert each(spark, ["it's A Title", "A Title", "ALL CAPS", "Été Noir", "", "1"], X.title_case) == ["it's A Title".istitle(), True, False, True, False, False]
    types = ["Introduction", "Prior Work", "Results and Discussion", None, "", "Funding", "An APPROACH"]
    assert each(spark, types, X.section_type) == ["introduction", "related_work", "results", "other", "other", "other", "methods"]


def test_residue_and_stats(spark):
    assert each(spark, ["a [59]-[65], b [3] [i] [Fig. 3]", "[1] – [2]x"], X.strip_citations) == ["a , b  [i] [Fig. 3]", "x"]
    assert [tuple(x) for x in each(spark, ["a\ue000\ufffdé", ""], X.char_stats)] == [(1, 1, 0.75), (0, 0, 0.0)]
    assert each(spark, ["2020-07", "Jul. 1999", "12345", "1499", None], X.parse_year) == [2020, 1999, None, None, None]


def test_abstention_and_citations(spark):
    replies = ["  NO_ANSWER_IN_CONTEXT: the sources do not cover this.", "The answer is NO_ANSWER_IN_CONTEXT somehow", "<think>weighing it up</think>\nThe answer is X [1].", "[3] then [1] then [3] again [7]"]
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(replies)], "qid string, reply string")
    got = {r.qid: (r.answer, r.abstained, r.citations) for r in read_reply(df, 3).collect()}
    assert got == {"0": ("the sources do not cover this.", True, []), "1": (replies[1], False, []), "2": ("The answer is X [1].", False, [1]), "3": (replies[3], False, [3, 1])}
    refusals = ["The passages do not contain it.", "There is not enough information here.", "It works [1]."]
    assert each(spark, refusals, lambda c: X.prose_refusal(c, F.size(X.cited(c)) > 0)) == [True, True, False]


def test_context(spark):
    df = spark.createDataFrame([("q", 2, "T", 2020, "H", "P", "two"), ("q", 1, None, None, None, "Parent", "one")], "qid string, rank int, title string, year int, section_heading string, parent_heading string, text string")
    assert context_block(df).first().context == "[1] Untitled (n.d.) -- Parent\none\n\n[2] T (2020) -- H\ntwo"


def test_bibliography_parts(spark):
    assert each(spark, ["Yeong Min", "Chih-Lin", "Md.", ""], M.initials) == ["Y. M.", "C.-L.", "M.", ""]
    assert each(spark, ["1234-1245", "2514", None, "", "a-"], M.format_pages) == ["pp. 1234–1245", "p. 2514", "pp. n/a", "pp. n/a", "p. a-"]
    assert each(spark, ["CC-BY-4.0", None, "CC-BY-NC-4.0"], M.format_licence) == ["CC BY 4.0", "n/a", "CC-BY-NC-4.0"]
    lists = [["A. One"], ["A. One", "B. Two"], ["A. One", "B. Two", "C. Three"], []]
    assert each(spark, lists, M.format_authors, "array<string>") == ["A. One", "A. One and B. Two", "A. One, B. Two, and C. Three", "n/a"]
    assert each(spark, ["bouclé", "BOUCLE", "Íñiguez", None], X.accent_fold) == ["boucle", "boucle", "iniguez", None]


def test_ids(spark):
    import uuid

    ns = "6f1b2e2a-0d1e-4c8b-9a3a-2c7d5e9f00c3"
    names = ["p:fixed:0000", "é", "x" * 50]
    assert each(spark, names, M.point_id) == [str(uuid.uuid5(uuid.UUID(ns), n)) for n in names]
    assert each(spark, [" HTTPS://doi.org/10.1/A ", "doi: 10.1/b", "10.1/C", "http://dx.doi.org/10.1/d"], M.normalize_doi) == ["10.1/a", "10.1/b", "10.1/c", "10.1/d"]
    assert each(spark, ["My Paper (v2).PDF", "--a--", "é"], X.slugify) == ["my-paper-v2-pdf", "a", ""]
    assert each(spark, ["My Paper (v2).PDF", "a.tar.gz", ".x"], X.paper_slug) == ["my-paper-v2", "a-tar", "x"]
    with pytest.raises(Exception, match="no paper id"):
        each(spark, ["é.pdf"], X.paper_slug)


@pytest.mark.parametrize("one, two, licence, warned", [
    ("cc-by", "https://creativecommons.org/licenses/by/4.0/", "CC-BY-4.0", False), ("cc-by", "https://creativecommons.org/licenses/by-nc/4.0/", "CC-BY", True),
    (None, "http://creativecommons.org/publicdomain/zero/1.0/", "CC0-1.0", False), ("publisher", None, "publisher", True), (None, None, "UNKNOWN", True),
])
def test_licence(spark, one, two, licence, warned):
    df = spark.createDataFrame([(one, two)], "a string, b string").select(M.licence(F.col("a"), F.col("b")).alias("l"))
    got = df.first().l
    assert (got.licence, got.warning is not None) == (licence, warned)
