"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tei
from ..operators.markup import markup_units
from .registry import query, table

FIRST_LINE = "split_part(text, chr(10), 1)"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")


NAME = "concat(' ', source, '_Paper ', doc_id % 50, ' (', lang, ')--v', doc_id % 3, '!')"
SLUG = "regexp_replace(regexp_replace(lower(concat(' ', source, '_Paper ', doc_id % 50, ' (', lang, ')--v', doc_id % 3, '!')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("slugify_ids", f"SELECT doc_id, {SLUG} AS slug FROM documents")
def slugify_ids(spark, sf):
    return docs(spark, sf).select("doc_id", X.slugify(F.expr(NAME)).alias("slug"))


@query("slug_collisions", f"SELECT slug, count(*) AS n, list_sort(list(doc_id)) AS doc_ids FROM (SELECT doc_id, {SLUG} AS slug FROM documents) GROUP BY slug HAVING count(*) > 1")
def slug_collisions(spark, sf):
    found = slugify_ids(spark, sf).groupBy("slug").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    return found.where("n > 1")


NORMAL = """trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'),
 ' +([.,;:!?)\\]}}%])', '\\1', 'g'), '([(\\[{{]) +', '\\1', 'g'), ',,', ','), ', ,', ','), '. ,', '.'), ' ,', ','), ' {{2,}}', ' ', 'g'))"""
MESSY = "concat('  ', text, ' ( see [4] ) , , next . , then ,,  more { x } ')"


@query("normalize_text", f"SELECT doc_id, {NORMAL.format(MESSY)} AS normal FROM documents")
def normalize_text(spark, sf):
    return docs(spark, sf).select("doc_id", X.normalize_text(F.expr(MESSY)).alias("normal"))


CITED = "concat('As in [', doc_id, '] and [1]-[3]–[5], ', text, ' [', doc_id % 7, '][x] [12')"


@query("strip_citations", f"SELECT doc_id, regexp_replace(regexp_replace({CITED}, '\\[\\d+\\](?:[-–]\\[\\d+\\])+', '', 'g'), '\\[\\d+\\]', '', 'g') AS stripped FROM documents")
def strip_citations(spark, sf):
    return docs(spark, sf).select("doc_id", X.strip_citations(F.expr(CITED)).alias("stripped"))


@query("clean_ws", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents")
def clean_ws(spark, sf):
    return docs(spark, sf).select("doc_id", X.clean_ws(F.col("text")).alias("clean"))


@query("char_stats", "SELECT doc_id, len(regexp_extract_all(text, '[\\x{E000}-\\x{F8FF}]'))::INT AS n_pua, len(regexp_extract_all(text, '\\x{FFFD}'))::INT AS n_replacement, CASE WHEN length(text) > 0 THEN round(len(regexp_extract_all(text, '[^\\x00-\\x7F]')) / length(text), 6) ELSE 0 END AS non_ascii_ratio FROM documents")
def char_stats(spark, sf):
    s = X.char_stats(F.col("text"))
    return docs(spark, sf).select("doc_id", s.n_pua.alias("n_pua"), s.n_replacement.alias("n_replacement"), F.round(s.non_ascii_ratio, 6).alias("non_ascii_ratio"))


@query("text_ratios", "SELECT doc_id, round(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / greatest(length(text), 1), 6) AS alpha_ratio, round(len(regexp_extract_all(text, '[^\\x00-\\x7F]')) / greatest(length(text), 1), 6) AS non_ascii_ratio FROM documents")
def text_ratios(spark, sf):
    n = F.greatest(F.length("text"), F.lit(1))
    return docs(spark, sf).select("doc_id", F.round(F.length(F.regexp_replace("text", "\\P{L}", "")) / n, 6).alias("alpha_ratio"), F.round(F.regexp_count("text", F.lit("[^\\x00-\\x7F]")) / n, 6).alias("non_ascii_ratio"))


PREFIX = ["I. ", "IV. ", "A. ", "a) ", "2) ", "2.1. ", "", "II. RELATED WORK B. ", "C. ", "Table 3 ", "III. A. "]
HEADING = "concat(CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PREFIX)) + f" END, CASE WHEN doc_id % 2 = 0 THEN upper(replace({FIRST_LINE}, 'ß', 's')) ELSE {FIRST_LINE} END)"
CASED = "\\p{Lu}\\p{Ll}\\p{Lt}"


@query("heading_levels", f"""
WITH h AS (SELECT doc_id, {HEADING} AS heading FROM documents),
x AS (SELECT *, regexp_extract(heading, '^([MDCLXVI]+)\\.(\\s|$)', 1) AS roman, regexp_extract(heading, '^((?:\\d+\\.)+)(\\s|$)', 1) AS dotted,
  regexp_matches(heading, '^[A-Z]\\.(\\s|$)') AS letter, regexp_matches(heading, '^[a-z][:)](\\s|$)') AS lower, regexp_matches(heading, '^\\d+\\)(\\s|$)') AS digit,
  regexp_extract(heading, '^((?:I|[MDCLXVI]{{2,}})\\.(?:\\s.*?)??)\\s[A-Z]\\.(?:\\s|$)', 1, 's') AS parent FROM h)
SELECT doc_id, heading, (CASE WHEN roman = 'I' OR length(roman) >= 2 THEN 1 WHEN letter THEN 2 WHEN lower OR digit THEN 3 WHEN dotted <> '' THEN len(regexp_extract_all(dotted, '\\.')) ELSE 1 END)::INT AS level,
  NOT (roman = 'I' OR length(roman) >= 2 OR letter OR lower OR digit OR dotted <> '') AS unnumbered,
  heading <> '' AND (regexp_matches(heading, '[.,;:]$') OR length(heading) > 80 OR (regexp_matches(heading, '(^|[^\\p{{L}}\\p{{N}}_])[a-z]{{4,}}($|[^\\p{{L}}\\p{{N}}_])')
    AND NOT (regexp_matches(heading, '[\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches(heading, '(^|[^{CASED}])\\p{{Ll}}') AND NOT regexp_matches(heading, '[{CASED}][\\p{{Lu}}\\p{{Lt}}]')))
    OR regexp_matches(heading, '(?i)^(?:Algorithm|Figure|Fig\\.|Table|Listing)\\s*\\d')) AS junk,
  CASE WHEN parent <> '' THEN regexp_replace(parent, '\\s+$', '') END AS merged_parent,
  CASE WHEN parent <> '' THEN regexp_replace(substr(heading, length(parent) + 1), '^\\s+', '') END AS merged_child
FROM x""")
def heading_levels(spark, sf):
    h = docs(spark, sf).select("doc_id", F.expr(HEADING).alias("heading"))
    c, m = F.col("heading"), X.merged_heading(F.col("heading"))
    return h.select("doc_id", "heading", X.heading_level(c).alias("level"), X.heading_unnumbered(c).alias("unnumbered"), X.junk_heading(c).alias("junk"), m.parent.alias("merged_parent"), m.child.alias("merged_child"))


TITLES = ["I. INTRODUCTION", "Prior Work and Context", "System Model", "Proposed Method", "Evaluation results", "Discussion", "Conclusion and Future Work", "Funding", "", "Algorithm summary"]
TITLE = "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(TITLES)) + " END"
TYPE_SQL = "CASE WHEN coalesce({0}, '') = '' THEN 'other' " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{'|'.join(k)}') THEN '{n}'" for n, k in X.SECTION_TYPES) + " ELSE 'other' END"
LINE = "CASE WHEN doc_id % 3 = 0 THEN concat('TABLE ', doc_id, '. ', text) ELSE text END"


@query("section_types", f"SELECT doc_id, {TYPE_SQL.format('heading')} AS section_type, regexp_matches({LINE}, '(?s)^(?:TABLE|FIGURE)\\s+\\d+\\.\\s+\\S.*$') AS misplaced_caption FROM (SELECT *, {TITLE} AS heading FROM documents)")
def section_types(spark, sf):
    return docs(spark, sf).select("doc_id", X.section_type(F.expr(TITLE)).alias("section_type"), X.clean_ws(F.expr(LINE)).rlike("(?s)^(?:TABLE|FIGURE)\\s+\\d+\\.\\s+\\S.*$").alias("misplaced_caption"))


YEAR = "concat(lang, ' issued ', 1400 + doc_id % 800, '-', 1900 + doc_id % 150, ' x', doc_id)"


@query("parse_year", f"SELECT doc_id, try_cast(nullif(regexp_extract({YEAR}, '\\b(1[5-9]\\d{{2}}|20\\d{{2}})\\b', 1), '') AS INT) AS year FROM documents")
def parse_year(spark, sf):
    return docs(spark, sf).select("doc_id", X.parse_year(F.expr(YEAR)).alias("year"))


@query("analyze_tokens", "SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS tokens FROM documents")
def analyze_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.sort_array(F.array_distinct(X.tokens(F.col("text")))).alias("tokens"))


@query("token_counts", """SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(text, '\\S+'), lambda w: ceil(length(w) / 4)::INT)), 0)::INT AS content_tokens,
 coalesce(list_sum(list_transform(regexp_extract_all(text, '\\S+'), lambda w: ceil(length(w) / 4)::INT)), 0)::INT + 2 AS n_tokens FROM documents""")
def token_counts(spark, sf):
    n = X.content_tokens(F.col("text"))
    return docs(spark, sf).select("doc_id", n.alias("content_tokens"), (n + 2).alias("n_tokens"))


@query("kwic_context", """
SELECT doc_id, concat(CASE WHEN greatest(s - 100, 0) > 0 THEN '...' ELSE '' END, substr(text, greatest(s - 100, 0) + 1, s - greatest(s - 100, 0)), '[[', substr(text, s + 1, e - s), ']]',
  substr(text, e + 1, least(e + 100, length(text)) - e), CASE WHEN least(e + 100, length(text)) < length(text) THEN '...' ELSE '' END) AS context,
  left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 240) AS snippet
FROM (SELECT *, (length(text) * 2 // 5)::INT AS s, least((length(text) * 2 // 5)::INT + 25, length(text))::INT AS e FROM documents)""")
def kwic_context(spark, sf):
    d = docs(spark, sf).withColumn("s", F.expr("int(length(text) * 2 div 5)")).withColumn("e", F.least(F.col("s") + 25, F.length("text")))
    return d.select("doc_id", X.kwic(F.col("text"), F.col("s"), F.col("e")).alias("context"), F.substring(X.clean_ws(F.col("text")), 1, 240).alias("snippet"))


REPLY = """concat(CASE WHEN conv_id % 4 = 0 THEN '<think>weighing
it</think> ' ELSE '' END, CASE WHEN turn % 3 = 0 THEN '  NO_ANSWER_IN_CONTEXT: ' ELSE '' END, text, ' [', turn, '] [', conv_id % 5, '] [1]')"""
NO_THINK = f"regexp_replace({REPLY}, '(?is)^\\s*<think>.*?</think>\\s*', '')"


def replies(spark, sf):
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", X.strip_reasoning(F.expr(REPLY)).alias("reply"))


REPLIES_SQL = f"SELECT conv_id, turn, {NO_THINK} AS reply FROM conversations WHERE role = 'assistant'"
ABSTAINED_SQL = "starts_with(regexp_replace(reply, '^\\s+', ''), 'NO_ANSWER_IN_CONTEXT')"


@query("abstention", f"SELECT conv_id, turn, {ABSTAINED_SQL} AS abstained, CASE WHEN {ABSTAINED_SQL} THEN ltrim(substr(regexp_replace(reply, '^\\s+', ''), 21), ' :.-' || chr(10)) ELSE reply END AS answer FROM ({REPLIES_SQL})")
def abstention(spark, sf):
    c = F.col("reply")
    return replies(spark, sf).select("conv_id", "turn", X.abstained(c).alias("abstained"), X.abstention_text(c).alias("answer"))


LISTED_SQL = "list_transform(regexp_extract_all(reply, '\\[(\\d+)\\]', 1), lambda x: x::INT)"
CITED_SQL = f"list_filter({LISTED_SQL}, lambda x, i: list_position({LISTED_SQL}, x) = i)"


@query("citations", f"SELECT conv_id, turn, list_filter(c, lambda x: x BETWEEN 1 AND 3) AS valid, list_filter(c, lambda x: NOT x BETWEEN 1 AND 3) AS invalid FROM (SELECT *, {CITED_SQL} AS c FROM ({REPLIES_SQL}))")
def citations(spark, sf):
    r = replies(spark, sf).withColumn("c", X.cited(F.col("reply")))
    return r.select("conv_id", "turn", F.filter("c", lambda x: x.between(1, 3)).alias("valid"), F.filter("c", lambda x: ~x.between(1, 3)).alias("invalid"))


REFUSAL_SQL = X.PROSE_REFUSAL.replace("'", "''")


@query("abstention_rates", f"""
WITH r AS (SELECT conv_id, turn, reply, conv_id % 3 <> 0 AS has_answer, turn = 7 AS errored, turn * 100.0 + conv_id % 10 AS ms, {ABSTAINED_SQL} AS abstained, len({LISTED_SQL}) > 0 AS cites FROM ({REPLIES_SQL}))
SELECT has_answer, count(*) AS n, count(*) FILTER (errored) AS errors, count(*) FILTER (NOT errored) AS answered,
  round(count(*) FILTER (NOT errored AND abstained) / nullif(count(*) FILTER (NOT errored), 0), 6) AS abstention_rate,
  round(count(*) FILTER (NOT errored AND (abstained OR (NOT cites AND reply <> '' AND regexp_matches(reply, '{REFUSAL_SQL}')))) / nullif(count(*) FILTER (NOT errored), 0), 6) AS effective_rate,
  round(median(ms::DOUBLE) FILTER (NOT errored), 6) AS median_ms FROM r GROUP BY has_answer""")
def abstention_rates(spark, sf):
    r = replies(spark, sf).select("*", (F.col("conv_id") % 3 != 0).alias("has_answer"), (F.col("turn") == 7).alias("errored"), (F.col("turn") * 100.0 + F.col("conv_id") % 10).alias("ms"), X.abstained(F.col("reply")).alias("abstained"))
    refusal = X.prose_refusal(F.col("reply"), F.size(X.cited(F.col("reply"))) > 0)
    good = ~F.col("errored")
    rate = lambda c: F.round(F.try_divide(F.count_if(good & c), F.count_if(good)), 6)
    return r.groupBy("has_answer").agg(
        F.count("*").alias("n"), F.count_if("errored").alias("errors"), F.count_if(good).alias("answered"), rate(F.col("abstained")).alias("abstention_rate"),
        rate(F.col("abstained") | refusal).alias("effective_rate"), F.round(F.median(F.when(good, F.col("ms"))), 6).alias("median_ms"),
    )


@query("markup_units")
def markup(spark, sf):
    return markup_units(table(spark, sf, "pages"), "page_id", "html")


TEI = """concat('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>I. INTRODUCTION</head><p>', replace(replace(text, '&', ''), '<', ''),
 ' <ref type="bibr">[1]</ref>.</p></div><div><head>References</head><p>gone</p></div><div><head>A. DETAIL</head><p>', lang, '</p></div></body></text></TEI>')"""


@query("tei_units", """SELECT doc_id AS paper_id, k AS unit_pos, CASE k WHEN 0 THEN 'I. INTRODUCTION' ELSE 'A. DETAIL' END AS section_heading, k AS section_index, (k + 1)::INT AS section_level, 'I. INTRODUCTION' AS parent_heading, 'introduction' AS section_type,
 CASE k WHEN 0 THEN replace(replace(text, '&', ''), '<', '') || ' .' ELSE lang END AS raw_text FROM documents, unnest([0, 1]) AS t(k)""")
def tei_units(spark, sf):
    papers = docs(spark, sf).select(F.col("doc_id").alias("paper_id"), F.expr(TEI).alias("tei"))
    return tei.units(tei.tei_rows(papers)).select("paper_id", "unit_pos", "section_heading", "section_index", "section_level", "parent_heading", "section_type", "raw_text")
