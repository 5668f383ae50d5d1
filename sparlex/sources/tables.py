"""Sources, sinks and the shapes of records read from other services' JSON."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions.text import accent_fold, char_stats, py_strip

WORK = "title array<string>, `container-title` array<string>, author array<struct<given:string,family:string,name:string>>, issued struct<`date-parts`:array<array<int>>>, `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>"
ENTRY = "DOI string, title array<string>, `container-title` array<string>, volume string, issue string, page string, author array<struct<given:string,family:string>>"
DATES = ["published", "published-print", "published-online", "issued", "created"]  # fixed values, in order of preference
ENTRY += "".join(f", `{k}` struct<`date-parts`:array<array<string>>>" for k in DATES)
MANIFEST = ["paper_id", "doi", "title", "year", "venue", "licence", "n_chars"]
PAPER = """paper_id string, doi string, title string, year int, venue string, licence string, units array<struct<unit_id:string, type:string,
 section_heading:string, parent_heading:string, section_type:string, contains_equation:boolean, char_start:int, char_end:int>>"""
COMPLETION = "model string, choices array<struct<finish_reason:string,message:struct<content:string>>>"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; a temporary one where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="sparlex-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines; with an order, the parts are in it. A job's files appear together or not at all."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """A malformed line is an error; blank lines are none."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_roundtrip(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession, "jsonl")
    write_jsonl(df, path)
    return read_jsonl(df.sparkSession, path, df.schema)


def read_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path, text of whole text files."""
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a path in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def load_overrides(spark: SparkSession, path: str) -> DataFrame:
    """paper_id, doi of a CSV file; without the file no rows, and rows with a blank cell are none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "paper_id string, doi string")
    rows = read_csv(spark, path, "paper_id string, doi string").select(*[py_strip(F.col(c)).alias(c) for c in ("paper_id", "doi")])
    return rows.where("paper_id <> '' AND doi <> ''")


def stem() -> Column:
    """The name of the row's file without its last suffix."""
    return F.regexp_replace(F.col("_metadata.file_name"), "\\.[^.]*$", "")


def load_crossref(spark: SparkSession, folder: str) -> DataFrame:
    """paper_id, work of a folder of cached replies; without the folder no rows, and a broken file's work is all null."""
    if not exists(spark, folder):
        return spark.createDataFrame([], f"paper_id string, work struct<{ENTRY}>")
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return files.select(stem().alias("paper_id"), F.from_json("value", f"crossref struct<{ENTRY}>")["crossref"].alias("work"))


def read_papers(spark: SparkSession, folder: str) -> DataFrame:
    """The papers of a folder: a JSON record each, its text in the file beside it. A record without its text is an error."""
    records = spark.read.schema(PAPER).option("mode", "FAILFAST").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).select("*", stem().alias("stem"))
    texts = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(stem().alias("stem"), F.col("value").alias("text"))
    text = F.coalesce("text", F.raise_error(F.concat(F.lit("no text beside the record of "), F.col("stem"))).cast("string"))
    plain = "unit -> struct(unit.unit_id, unit.type, unit.section_heading, unit.parent_heading, unit.section_type, coalesce(unit.contains_equation, false) AS contains_equation, unit.char_start, unit.char_end)"
    units = F.expr(f"transform(coalesce(units, array()), {plain})")
    return records.join(texts, "stem", "left").withColumns({"text": text, "units": units}).drop("stem")


def write_manifest(papers: DataFrame, path: str) -> None:
    """The manifest of all papers as CSV in the order of their ids; papers: what read_papers returns."""
    papers.withColumn("n_chars", F.length("text")).select(*MANIFEST).orderBy("paper_id").write.mode("overwrite").option("header", True).csv(path)


def entries(manifest: DataFrame, works: DataFrame) -> DataFrame:
    """A bibliography entry of every paper of the manifest: field by field the registry's, else the manifest's, else n/a.

    manifest: paper_id, doi, title, year, venue, licence; works: paper_id, work, one row a paper at most. An empty value or
    a date without a year counts as absent.
    """
    w = lambda name: F.col("work")[name]
    given = lambda *cs: F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cs], F.lit(M.NA))
    first = lambda c: F.get(c, F.lit(0))
    names = F.filter(F.transform(w("author"), lambda a: M.format_author(a["given"], a["family"])), lambda x: x.isNotNull())
    surname = F.nullif(py_strip(first(w("author"))["family"]), F.lit(""))
    return manifest.join(works, "paper_id", "left").select(
        "paper_id", F.coalesce(M.format_authors(names), F.lit(M.NA)).alias("authors"), given(first(w("title")), F.col("title")).alias("title"),
        given(first(w("container-title")), F.col("venue")).alias("venue"), given(w("volume")).alias("volume"), given(w("issue")).alias("issue"), M.format_pages(w("page")).alias("pages"),
        given(*[first(first(w(k)["date-parts"])) for k in DATES], F.col("year")).alias("year"), given(w("DOI"), F.col("doi")).alias("doi"),
        M.format_licence(F.col("licence")).alias("licence"), F.coalesce(accent_fold(surname), F.lit("\uffff")).alias("sort_key"),
    )


def doi_index(papers: DataFrame, strict: bool = False) -> DataFrame:
    """doi, paper_id (of duplicates the last), conflict; strict: a conflict is an error."""
    out = papers.select("paper_id", M.normalize_doi(F.col("doi")).alias("doi")).groupBy("doi").agg(F.max("paper_id").alias("paper_id"), (F.min("paper_id") != F.max("paper_id")).alias("conflict"))
    if strict:
        out = out.withColumn("paper_id", F.when(F.col("conflict"), F.raise_error(F.concat(F.lit("conflicting DOI "), "doi")).cast("long")).otherwise(F.col("paper_id")))
    return out


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key the row with the greatest version."""
    return old.unionByName(new).groupBy(key).agg(F.max_by(F.struct("*"), version).alias("row")).select("row.*")


def parse_completion(replies: DataFrame, body: str) -> DataFrame:
    j = F.from_json(body, COMPLETION)
    first = F.get(j["choices"], F.lit(0))
    text, why = first["message"]["content"], first["finish_reason"]
    error = F.when(first.isNull(), "malformed").when((text == "") & (why == "length"), "empty at length")
    return replies.select(*[c for c in replies.columns if c != body], j["model"].alias("model"), text.alias("text"), why.alias("finish_reason"), error.alias("error"))


def crossref_fields(works: DataFrame, body: str) -> DataFrame:
    j = F.from_json(body, WORK)
    name = lambda a: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", a["given"], a["family"])), F.lit("")), F.trim(a["name"]))
    year = F.coalesce(*[F.get(F.get(j[k]["date-parts"], F.lit(0)), F.lit(0)) for k in ("issued", "published-print", "published-online")])
    venue = F.get(j["container-title"], F.lit(0))
    return works.select(
        *[c for c in works.columns if c != body], M.strip_html(F.get(j["title"], F.lit(0))).alias("title"),
        F.filter(F.transform(j["author"], name), lambda x: x.isNotNull() & (x != "")).alias("authors"), year.alias("year"), venue.alias("venue"),
        F.filter(F.array(F.when(venue.isNull(), "no venue")), lambda x: x.isNotNull()).alias("warnings"),
    )


def bibliography(entries: DataFrame) -> DataFrame:
    """number, id, line, missing; sorted by the first author's surname without accents, no surname last. entries: id, author, page, licence, year."""
    families = F.filter(F.transform("author", lambda a: a["family"]), lambda x: x != "")
    e = entries.select(
        "id", M.format_authors(F.filter(F.transform("author", lambda a: M.format_author(a["given"], a["family"])), lambda x: x.isNotNull())).alias("authors"),
        M.format_pages(F.col("page")).alias("pages"), M.format_licence(F.col("licence")).alias("licence"), F.coalesce(F.col("year").cast("string"), F.lit(M.NA)).alias("year"),
        F.coalesce(accent_fold(F.get(families, F.lit(0))), F.lit("\uffff")).alias("sort_key"),
    )
    e = e.withColumn("number", F.row_number().over(Window.orderBy("sort_key", "id")))  # a printed list is one sequence
    absent = [F.when(F.col(c) == v, c) for c, v in (("authors", M.NA), ("pages", f"pp. {M.NA}"), ("licence", M.NA), ("year", M.NA))]
    line = F.format_string("[%d] %s, %s, %s. %s. `%s`", "number", "authors", "year", "pages", "licence", F.col("id").cast("string"))
    return e.select("number", "id", line.alias("line"), F.filter(F.array(*absent), lambda x: x.isNotNull()).alias("missing"))


def quality_flags(text: Column, lines: Column, doi: Column, licence: Column, min_sections: int = 3, min_chars: int = 500, min_mean: float = 40, min_alpha: float = 0.7, max_foreign: float = 0.05) -> Column:
    """The ten gates of a paper that it doesn't pass."""
    n = F.greatest(F.length(text), F.lit(1))
    mean = F.aggregate(lines, F.lit(0.0), lambda a, x: a + F.length(x)) / F.size(lines)
    gates = [
        (F.size(lines) < min_sections, "few sections"), (F.length(text) < min_chars, "short"), (mean < min_mean, "short units"),
        (F.length(F.regexp_replace(text, "\\P{L}", "")) / n < min_alpha, "few letters"), (F.regexp_count(text, F.lit("[^\\x00-\\x7F]")) / n > max_foreign, "non-ASCII"),
        (F.regexp_count(text, F.lit("\\[\\d+\\]")) > 0, "citation residue"), (char_stats(text)["n_pua"] > 0, "private-use characters"), (char_stats(text)["n_replacement"] > 0, "replacement characters"),
        (doi.isNull(), "missing DOI"), (licence.isNull() | (licence == "UNKNOWN"), "licence unknown"),
    ]
    return F.filter(F.array(*[F.when(c, name) for c, name in gates]), lambda x: x.isNotNull())
