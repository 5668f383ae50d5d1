"""The index as a table: created once, filled in batches, idempotent by point id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import point_id
from .tables import upsert_latest

PAYLOAD = "paper_id, doi, title, year, venue, licence, section_heading, parent_heading, section_type, chunk_index, char_start, char_end, n_tokens, contains_equation, chunker, text, chunk_id".split(", ")


def ensure_index(spark: SparkSession, name: str, schema: str, recreate: bool = False) -> bool:
    """Whether the table had to be made; it is partitioned by chunker."""
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if spark.catalog.tableExists(name):
        return False
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet PARTITIONED BY (chunker)")
    return True


def points(chunks: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points with their id and payload, chunks whose paper is missing). chunks hold chunk_id and their own payload fields; papers: paper_id and the rest."""
    known = chunks.join(papers, "paper_id")
    return known.withColumn("point_id", point_id(F.col("chunk_id"))), chunks.join(papers.select("paper_id"), "paper_id", "left_anti")


def merge_points(old: DataFrame, new: DataFrame, batch: int) -> DataFrame:
    """Points by id, those of the new batch in place of old ones."""
    return upsert_latest(old, new.withColumn("batch", F.lit(batch)), "point_id", "batch")


def select_key(df: DataFrame, column: str, value) -> DataFrame:
    """The rows of one key; a key that doesn't occur is an error."""
    out = df.where(F.col(column) == F.lit(value))
    if out.isEmpty():
        raise KeyError(f"unknown {column}: {value!r}")
    return out
