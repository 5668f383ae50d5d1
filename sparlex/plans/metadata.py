"""Queries over bibliographic metadata, manifests and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as X
from ..sources import tables as S
from .registry import query, table

DOI = """concat(CASE doc_id % 6 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'http://dx.doi.org/' WHEN 2 THEN 'doi:' WHEN 3 THEN 'DOI.org/' WHEN 4 THEN '  ' ELSE 'doi: ' END,
 '10.1000/', upper(lang), '.', doc_id % 200, '  ')"""
DOI_SQL = f"trim(regexp_replace(lower(trim({DOI})), '^(https?://(dx\\.)?doi\\.org/|doi\\.org/|doi:)', ''))"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query("normalize_doi", f"SELECT doc_id, {DOI_SQL} AS doi FROM documents")
def normalize_doi(spark, sf):
    return docs(spark, sf).select("doc_id", M.normalize_doi(F.expr(DOI)).alias("doi"))


@query("doi_index", f"SELECT doi, max_by(doc_id, doc_id) AS paper_id, count(DISTINCT doc_id) > 1 AS conflict FROM (SELECT doc_id, {DOI_SQL} AS doi FROM documents) GROUP BY doi")
def doi_index(spark, sf):
    return S.doi_index(docs(spark, sf).select(F.col("doc_id").alias("paper_id"), F.expr(DOI).alias("doi")))


HEADER, OVERRIDE = "CASE WHEN doc_id % 3 = 0 THEN concat(' 10.1/', doc_id, ' ') WHEN doc_id % 3 = 1 THEN '  ' END", "CASE WHEN doc_id % 4 < 2 THEN concat('10.2/', doc_id) WHEN doc_id % 4 = 2 THEN ' ' END"


@query("resolve_doi", f"SELECT doc_id, coalesce(nullif(trim({HEADER}), ''), nullif(trim({OVERRIDE}), '')) AS doi FROM documents")
def resolve_doi(spark, sf):
    d = docs(spark, sf)
    overrides = d.select("doc_id", F.expr(OVERRIDE).alias("doi")).where(X.py_strip(F.col("doi")) != "").withColumnRenamed("doi", "override")
    return d.join(overrides, "doc_id", "left").select("doc_id", F.coalesce(F.nullif(X.py_strip(F.expr(HEADER)), F.lit("")), X.py_strip(F.col("override"))).alias("doi"))


@query("manifest", "SELECT doc_id AS paper_id, concat('10.1000/', doc_id) AS doi, split_part(text, chr(10), 1) AS title, (1990 + doc_id % 35)::INT AS year, source AS venue, 'CC-BY-4.0' AS licence, length(text)::INT AS n_chars FROM documents")
def manifest(spark, sf):
    return docs(spark, sf).select(
        F.col("doc_id").alias("paper_id"), F.expr("concat('10.1000/', doc_id)").alias("doi"), F.expr("split_part(text, chr(10), 1)").alias("title"),
        F.expr("int(1990 + doc_id % 35)").alias("year"), F.col("source").alias("venue"), F.lit("CC-BY-4.0").alias("licence"), F.length("text").alias("n_chars"),
    )


@query("paper_digest", "SELECT doc_id, sha256(text) AS text_sha256, coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END, ''), source) AS venue FROM documents")
def paper_digest(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.coalesce(F.nullif(F.expr("CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END"), F.lit("")), F.col("source")).alias("venue"))


H = "sha1(unhex('6f1b2e2a0d1e4c8b9a3a2c7d5e9f00c3') || encode(doc_id || ':fixed:0000'))"


@query("point_ids", f"SELECT doc_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', lower(to_hex((('0x' || substr(h, 17, 1))::INT & 3) | 8)), substr(h, 18, 3), '-', substr(h, 21, 12)) AS point_id FROM (SELECT doc_id, {H} AS h FROM documents)")
def point_ids(spark, sf):
    return docs(spark, sf).select("doc_id", M.point_id(F.concat(F.col("doc_id").cast("string"), F.lit(":fixed:0000"))).alias("point_id"))


@query("jsonl_roundtrip", "SELECT doc_id, lang, source, text FROM documents")
def jsonl_roundtrip(spark, sf):
    """The whole text makes the round trip and must come back with the digest that it left with."""
    back = S.jsonl_roundtrip(docs(spark, sf).select("doc_id", "lang", "source", "text", F.sha2("text", 256).alias("text_sha256")))
    same = F.sha2("text", 256).eqNullSafe(F.col("text_sha256"))
    text = F.when(same, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("text changed in JSON lines: "), F.col("doc_id").cast("string"))).cast("string"))
    return back.select("doc_id", "lang", "source", text.alias("text"))


@query("upsert_latest", "SELECT user_id, arg_max(event_type, struct_pack(ts := ts, id := event_id)) AS event_type, arg_max(event_id, struct_pack(ts := ts, id := event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def upsert_latest(spark, sf):
    """Events of even id are the table, those of odd id the batch that is merged into it."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", F.struct("ts", "event_id").alias("version"))
    return S.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0"), "user_id", "version").drop("version")


COMPLETION = """concat('{"model": "m', turn, '", "choices": [', CASE WHEN turn = 5 THEN '' ELSE concat('{"finish_reason": "', CASE WHEN turn = 3 THEN 'length' ELSE 'stop' END, '", "message": {"content": "', CASE WHEN turn = 3 THEN '' ELSE concat('reply ', conv_id) END, '"}}') END, ']}')"""


@query("parse_completion", f"""
SELECT conv_id, turn, j->>'$.model' AS model, j->>'$.choices[0].message.content' AS text, j->>'$.choices[0].finish_reason' AS finish_reason,
  CASE WHEN (j->'$.choices[0]') IS NULL THEN 'malformed' WHEN (j->>'$.choices[0].message.content') = '' AND (j->>'$.choices[0].finish_reason') = 'length' THEN 'empty at length' END AS error
FROM (SELECT conv_id, turn, {COMPLETION}::JSON AS j FROM conversations)""")
def parse_completion(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(COMPLETION).alias("body"))
    return S.parse_completion(c, "body")


@query("index_stats", "SELECT label, count(*) AS points, max(len(embedding))::INT AS dim, round(count(*) * max(len(embedding)) * 4 / 1024.0, 6)::DOUBLE AS kb, count(*) * max(len(embedding)) * 4 / 1024.0 < 100 AS exact FROM embeddings GROUP BY label")
def index_stats(spark, sf):
    e = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("points"), F.max(F.size("embedding")).alias("dim"))
    kb = F.col("points") * F.col("dim") * 4 / F.lit(1024.0)
    return e.select("*", F.round(kb, 6).cast("double").alias("kb"), (kb < 100).alias("exact"))


HTML = "concat(' <i>', lang, '</i> ', replace(split_part(text, chr(10), 1), '<', ''), '<sub>2</sub> ')"


@query("strip_html", f"SELECT doc_id, nullif(trim(regexp_replace({HTML}, '<[^>]+>', '', 'g')), '') AS title FROM documents")
def strip_html(spark, sf):
    return docs(spark, sf).select("doc_id", M.strip_html(F.expr(HTML)).alias("title"))


UNPAYWALL = "CASE doc_id % 5 WHEN 0 THEN 'cc-by' WHEN 1 THEN 'CC0' WHEN 2 THEN 'publisher-specific' WHEN 3 THEN 'cc-by-nc-sa' END"
VOR = "CASE doc_id % 4 WHEN 0 THEN 'https://creativecommons.org/licenses/by/4.0/' WHEN 1 THEN 'http://creativecommons.org/publicdomain/zero/1.0/' WHEN 2 THEN 'https://creativecommons.org/licenses/by-nc-nd/' END"
URL = "(?i)creativecommons\\.org/(?:licenses/([a-z-]+)|publicdomain/(zero))/(\\d+\\.\\d+)?"


def _variant(c):
    return f"CASE WHEN regexp_extract({c}, '{URL}', 2) <> '' THEN '0' WHEN regexp_extract({c}, '{URL}', 1) <> '' THEN upper(regexp_extract({c}, '{URL}', 1)) WHEN regexp_extract({c}, '(?i)^cc[-_]?(by[a-z-]*|0)$', 1) <> '' THEN upper(regexp_extract({c}, '(?i)^cc[-_]?(by[a-z-]*|0)$', 1)) END"


@query("licence", f"""
WITH x AS (SELECT doc_id, {UNPAYWALL} AS u, {VOR} AS v FROM documents), y AS (SELECT *, coalesce(u, v) AS raw FROM x),
z AS (SELECT *, {_variant('raw')} AS k, coalesce(nullif(regexp_extract(raw, '{URL}', 3), ''), CASE WHEN u IS NOT NULL AND {_variant('v')} = {_variant('u')} THEN nullif(regexp_extract(v, '{URL}', 3), '') END) AS version FROM y)
SELECT doc_id, CASE WHEN raw IS NULL THEN 'UNKNOWN' WHEN k IS NULL THEN raw ELSE concat(CASE WHEN k = '0' THEN 'CC0' ELSE concat('CC-', k) END, coalesce('-' || version, '')) END AS licence,
  CASE WHEN raw IS NULL THEN 'no licence information found in Crossref or Unpaywall' WHEN k IS NULL THEN 'licence is not a CC variant' WHEN version IS NULL THEN 'licence version unknown' END AS warning FROM z""")
def licence(spark, sf):
    # the version of record's licence comes first among the registry's
    listed = F.expr(f"filter(array(named_struct('version', 'am', 'url', 'https://x.org/am'), named_struct('version', 'vor', 'url', {VOR})), e -> e.version = 'vor')[0].url")
    out = M.licence(F.expr(UNPAYWALL), listed)
    return docs(spark, sf).select("doc_id", out.licence.alias("licence"), out.warning.alias("warning"))


WORK = """concat('{"title": ["<b>T</b> ', doc_id, '"], "container-title": [', CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('"', source, '"') END, '], "author": [{"given": "Ann-Lee B.", "family": "F', doc_id % 40, '"}, {"name": "Org ', lang, '"}, {}], ',
 CASE WHEN doc_id % 2 = 0 THEN concat('"issued": {"date-parts": [[', 1990 + doc_id % 30, ', 2]]}, ') ELSE '' END, '"published-online": {"date-parts": [[', 2000 + doc_id % 20, ']]}}')"""


@query("crossref_fields", f"""
SELECT doc_id, nullif(trim(regexp_replace(j->>'$.title[0]', '<[^>]+>', '', 'g')), '') AS title, ['Ann-Lee B. F' || (doc_id % 40), 'Org ' || lang] AS authors,
  coalesce((j->>'$.issued."date-parts"[0][0]')::INT, (j->>'$."published-online"."date-parts"[0][0]')::INT) AS year, j->>'$."container-title"[0]' AS venue,
  CASE WHEN (j->>'$."container-title"[0]') IS NULL THEN ['no venue'] ELSE []::VARCHAR[] END AS warnings
FROM (SELECT doc_id, lang, {WORK}::JSON AS j FROM documents)""")
def crossref_fields(spark, sf):
    return S.crossref_fields(docs(spark, sf).select("doc_id", F.expr(WORK).alias("body")), "body")


AUTHORS = "CASE c_custkey % 4 WHEN 0 THEN array() WHEN 1 THEN array(named_struct('given', 'Yeong Min', 'family', c_name)) WHEN 2 THEN array(named_struct('given', 'Chih-Lin', 'family', c_name), named_struct('given', 'Md.', 'family', c_mktsegment)) ELSE array(named_struct('given', 'A', 'family', 'One'), named_struct('given', '', 'family', c_name), named_struct('given', 'C', 'family', ''), named_struct('given', 'Élie', 'family', 'Íñiguez')) END"


@query("bibliography", """
WITH a AS (SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['Y. M. ' || c_name] WHEN 2 THEN ['C.-L. ' || c_name, 'M. ' || c_mktsegment] ELSE ['A. One', c_name, 'É. Íñiguez'] END AS names,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 3 THEN 'One' ELSE c_name END AS first_family,
  CASE c_custkey % 3 WHEN 0 THEN c_nationkey || '-' || c_custkey WHEN 1 THEN '' || c_custkey END AS page, CASE WHEN c_custkey % 5 > 0 THEN 'CC-BY-4.0' END AS lic, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 30 + 1990 END AS year FROM customer),
b AS (SELECT id, CASE len(names) WHEN 0 THEN 'n/a' WHEN 1 THEN names[1] WHEN 2 THEN names[1] || ' and ' || names[2] ELSE array_to_string(names[:-2], ', ') || ', and ' || names[-1] END AS authors,
  CASE WHEN page IS NULL THEN 'pp. n/a' WHEN page LIKE '%-%' THEN 'pp. ' || replace(page, '-', '–') ELSE 'p. ' || page END AS pages, CASE WHEN lic IS NULL THEN 'n/a' ELSE 'CC BY 4.0' END AS licence, coalesce(year::VARCHAR, 'n/a') AS year,
  coalesce(lower(strip_accents(first_family)), '~') AS sort_key FROM a)
SELECT (row_number() OVER (ORDER BY sort_key, id))::INT AS number, id, '[' || number || '] ' || authors || ', ' || year || ', ' || pages || '. ' || licence || '. `' || id || '`' AS line,
  list_filter([CASE WHEN authors = 'n/a' THEN 'authors' END, CASE WHEN pages = 'pp. n/a' THEN 'pages' END, CASE WHEN licence = 'n/a' THEN 'licence' END, CASE WHEN year = 'n/a' THEN 'year' END], lambda x: x IS NOT NULL) AS missing FROM b""")
def bibliography(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.expr(AUTHORS).cast("array<struct<given:string,family:string>>").alias("author"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN concat(c_nationkey, '-', c_custkey) WHEN 1 THEN concat('', c_custkey) END").alias("page"),
        F.expr("CASE WHEN c_custkey % 5 > 0 THEN 'CC-BY-4.0' END").alias("licence"), F.expr("CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 30 + 1990 END").alias("year"),
    )
    return S.bibliography(c)


# The registry's reply of a paper: none for every fifth, broken for every fifth, fields now and then absent or empty.
ENTRY = """concat('{"DOI": "', CASE WHEN doc_id % 6 > 0 THEN concat('10.5/', doc_id) ELSE '' END, '", "title": [', CASE WHEN doc_id % 3 > 0 THEN concat('"T ', doc_id, '"') ELSE '' END, '], "container-title": [', CASE WHEN doc_id % 2 = 0 THEN '""' ELSE concat('"V ', doc_id % 10, '"') END,
 '], "page": "', doc_id, ' - ', doc_id + 9, '", "author": [', CASE WHEN doc_id % 4 <> 2 THEN concat('{"given": "Ann-Lee", "family": "Fámily', doc_id % 40, '"}') ELSE '' END, '], "created": {"date-parts": [[2001, 1]]}', CASE WHEN doc_id % 8 < 5 THEN concat(', "volume": "', doc_id % 8, '"') ELSE '' END,
 CASE WHEN doc_id % 7 < 3 THEN concat(', "published-print": {"date-parts": [[', 1990 + doc_id % 20, ', 1]]}') ELSE '' END, CASE WHEN doc_id % 4 = 1 THEN ', "published": {"date-parts": [[1985]]}, "issued": {"date-parts": [[1970]]}' ELSE '' END, '}')"""
REPLY = f"CASE WHEN doc_id % 5 = 1 THEN '{{' WHEN doc_id % 5 > 1 THEN {ENTRY} END"


@query("bibliography_entries", f"""
WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, source AS venue, CASE WHEN doc_id % 3 > 0 THEN 1990 + doc_id % 35 END AS year, CASE WHEN doc_id % 4 > 0 THEN 'cc-by-4.0' END AS licence, TRY_CAST({REPLY} AS JSON) AS j FROM documents),
e AS (SELECT *, j->>'$.author[0].family' AS family FROM d)
SELECT doc_id AS paper_id, CASE WHEN family IS NULL THEN 'n/a' ELSE 'A.-L. ' || family END AS authors, coalesce(nullif(j->>'$.title[0]', ''), nullif(title, ''), 'n/a') AS title, coalesce(nullif(j->>'$."container-title"[0]', ''), nullif(venue, ''), 'n/a') AS venue,
  coalesce(j->>'$.volume', 'n/a') AS volume, 'n/a' AS issue, CASE WHEN (j->>'$.page') IS NULL THEN 'pp. n/a' ELSE 'pp. ' || replace(j->>'$.page', ' - ', '–') END AS pages,
  coalesce(j->>'$.published."date-parts"[0][0]', j->>'$."published-print"."date-parts"[0][0]', j->>'$.created."date-parts"[0][0]', year::VARCHAR, 'n/a') AS year,
  coalesce(nullif(j->>'$.DOI', ''), '10.9/' || doc_id) AS doi, CASE WHEN licence IS NULL THEN 'n/a' ELSE 'CC BY 4.0' END AS licence, coalesce(lower(strip_accents(family)), chr(65535)) AS sort_key FROM e""")
def bibliography_entries(spark, sf):
    d = docs(spark, sf)
    manifest = d.select(
        F.col("doc_id").alias("paper_id"), F.expr("concat('10.9/', doc_id)").alias("doi"), F.expr("split_part(text, chr(10), 1)").alias("title"), F.expr("CASE WHEN doc_id % 3 > 0 THEN 1990 + doc_id % 35 END").alias("year"),
        F.col("source").alias("venue"), F.expr("CASE WHEN doc_id % 4 > 0 THEN 'cc-by-4.0' END").alias("licence"),
    )
    replies = d.where("doc_id % 5 > 0").select(F.col("doc_id").alias("paper_id"), F.from_json(F.expr(REPLY), S.ENTRY).alias("work"))
    return S.entries(manifest, replies)


# A text without markup as units: a line each, every seventh from the fourth on a caption, every fifth from the second with an equation; headings as in heading_levels.
UNIT_TYPE = "CASE WHEN pos = 0 THEN 'abstract' WHEN pos % 7 = 3 THEN 'caption' ELSE 'section' END"
WARNED = "CASE WHEN pos % 11 = 5 THEN concat('split merged heading: H', pos) WHEN pos % 11 = 6 THEN concat('heading classified as junk: H', pos) END"


def units(spark, sf):
    u = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return u.select("*", F.expr(UNIT_TYPE).alias("type"), (F.col("pos") % 5 == 1).alias("equation"), F.expr(WARNED).alias("warning"))


@query("paper_summary", f"""
WITH u AS (SELECT *, {UNIT_TYPE} AS type, {WARNED} AS warning FROM (SELECT doc_id, line, k - 1 AS pos FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, k)))
SELECT doc_id, count(*) AS n_units, count(*) FILTER (type = 'caption') AS n_captions, count(*) FILTER (pos % 5 = 1) AS n_equation_units, round(avg(length(line)), 6) AS mean_chars, count(*) FILTER (warning LIKE 'split merged heading%') AS n_merged_splits FROM u GROUP BY doc_id""")
def paper_summary(spark, sf):
    return units(spark, sf).groupBy("doc_id").agg(
        F.count("*").alias("n_units"), F.count_if(F.expr("type = 'caption'")).alias("n_captions"), F.count_if("equation").alias("n_equation_units"),
        F.round(F.avg(F.length("line")), 6).alias("mean_chars"), F.count_if(F.startswith("warning", F.lit("split merged heading"))).alias("n_merged_splits"),
    )


LICENCE = "CASE doc_id % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'CC-BY-4.0' WHEN 2 THEN 'publisher-specific' END"
MARKED = "concat(text, CASE WHEN doc_id % 13 = 0 THEN chr(57345) ELSE '' END, CASE WHEN doc_id % 17 = 0 THEN chr(65533) ELSE '' END)"


@query("quality_flags", f"""
WITH u AS (SELECT doc_id, {MARKED.replace('chr(57345)', "chr(57345)")} AS text, {LICENCE} AS licence FROM documents), l AS (SELECT *, string_split(text, chr(10)) AS lines FROM u),
s AS (SELECT doc_id, licence, len(lines) AS sections, length(text) AS chars, list_sum(list_transform(lines, lambda x: length(x))) / len(lines) AS mean_chars, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / greatest(length(text), 1) AS alpha,
  len(regexp_extract_all(text, '[^\\x00-\\x7F]')) / greatest(length(text), 1) AS foreign_share, len(regexp_extract_all(text, '\\[\\d+\\]')) AS residue, contains(text, chr(57345)) AS pua, contains(text, chr(65533)) AS lost FROM l)
SELECT doc_id, list_filter([CASE WHEN sections < 3 THEN 'few sections' END, CASE WHEN chars < 500 THEN 'short' END, CASE WHEN mean_chars < 40 THEN 'short units' END, CASE WHEN alpha < 0.7 THEN 'few letters' END,
  CASE WHEN foreign_share > 0.05 THEN 'non-ASCII' END, CASE WHEN residue > 0 THEN 'citation residue' END, CASE WHEN pua THEN 'private-use characters' END, CASE WHEN lost THEN 'replacement characters' END,
  CASE WHEN doc_id % 9 = 0 THEN 'missing DOI' END, CASE WHEN licence IS NULL OR licence = 'UNKNOWN' THEN 'licence unknown' END], lambda x: x IS NOT NULL) AS flags FROM s""")
def quality_flags(spark, sf):
    marked = F.concat("text", F.when(F.expr("doc_id % 13 = 0"), "\ue001").otherwise(""), F.when(F.expr("doc_id % 17 = 0"), "\ufffd").otherwise(""))
    d = docs(spark, sf).select("doc_id", marked.alias("text"), F.expr(LICENCE).alias("licence"), F.expr("CASE WHEN doc_id % 9 > 0 THEN 'x' END").alias("doi")).withColumn("lines", F.split("text", "\n"))
    return d.select("doc_id", S.quality_flags(F.col("text"), F.col("lines"), F.col("doi"), F.col("licence")).alias("flags"))


HEADS = ["I. INTRODUCTION", "A. Setup", "a) Detail", "II. MODEL", "2) Item", "2.1. Deep", "Plain Title", "stray generation of prose", "Ends with a stop.", "B. Channel", "Figure 3 shows"]
HEAD = "CASE pos div 3 % 11 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS)) + " END"


@query("heading_counts", f"""
WITH u AS (SELECT doc_id, k - 1 AS pos, {UNIT_TYPE.replace('pos', '(k - 1)')} AS type FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, k)),
g AS (SELECT doc_id, pos // 3 AS section, arg_min({HEAD.replace('div', '//')}, pos) AS head FROM u WHERE type = 'section' GROUP BY ALL),
l AS (SELECT *, regexp_extract(head, '^([MDCLXVI]+)\\.(\\s|$)', 1) AS roman, regexp_extract(head, '^((?:\\d+\\.)+)(\\s|$)', 1) AS dotted, regexp_matches(head, '^[A-Z]\\.(\\s|$)') AS letter, regexp_matches(head, '^(?:[a-z][:)]|\\d+\\))(\\s|$)') AS item,
  regexp_matches(head, '[.,;:]$') OR length(head) > 80 OR regexp_matches(head, '^(?:Algorithm|Figure|Fig\\.|Table|Listing)\\s*\\d') OR head = 'stray generation of prose' AS looks_junk FROM g),
m AS (SELECT *, (roman = 'I' OR length(roman) >= 2) AS first_level, NOT (roman = 'I' OR length(roman) >= 2 OR letter OR item OR dotted <> '') AS unnumbered FROM l),
n AS (SELECT *, CASE WHEN first_level THEN 1 WHEN letter THEN 2 WHEN item THEN 3 WHEN dotted <> '' THEN len(regexp_extract_all(dotted, '\\.')) ELSE 1 END AS level FROM m)
SELECT doc_id, count(*) AS sections, count(*) FILTER (level = 1) AS level1, count(*) FILTER (level = 2) AS level2, count(*) FILTER (level = 3) AS level3, count(*) FILTER (unnumbered) AS unnumbered, count(*) FILTER (unnumbered AND looks_junk) AS junk FROM n GROUP BY doc_id""")
def heading_counts(spark, sf):
    """The heading of each section's first unit, by level; unnumbered and junk ones are counted besides."""
    u = units(spark, sf).where("type = 'section'").withColumn("head", F.expr(HEAD))
    g = u.groupBy("doc_id", F.expr("pos div 3").alias("section")).agg(F.min_by("head", "pos").alias("head"))
    level, plain = X.heading_level(F.col("head")), X.heading_unnumbered(F.col("head"))
    return g.groupBy("doc_id").agg(F.count("*").alias("sections"), *[F.count_if(level == i).alias(f"level{i}") for i in (1, 2, 3)], F.count_if(plain).alias("unnumbered"), F.count_if(plain & X.junk_heading(F.col("head"))).alias("junk"))
