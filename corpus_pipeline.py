"""A corpus pipeline of five operators over documents; each stage is written and read again.

Nulls: a null text counts as empty and goes with the first stage; a null id, language or source is a value of its own, and
rows with a null id are no one's near copies. Rows that repeat an id and text are one document twice and go or stay
together; another text under the same id is judged by itself. Ties keep the least id. Very long texts are judged whole.
Empty tables give empty tables. Further columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparlex.llm.common import row_key, shared_dir, without
from sparlex.llm.jaccard_join import jaccard_join
from sparlex.llm.packing import pack
from sparlex.llm.quality_classifier import classified, trusted_documents
from sparlex.llm.quality_rules import quality_rules
from sparlex.llm.substring_dedup import substring_dedup


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    keyed = docs.select("text", "source", F.struct(*row_key(F.col("text"), F.col("source"))).alias("key of the row"))
    verdicts = quality_rules(keyed, keep_doc=["key of the row"])
    return without(docs, verdicts.where("not kept").select("doc.`key of the row`.*"), "text", "source")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents above their language's perplexity limit go; trusted text: what labels calls good and not toxic."""
    trusted = trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classified(docs, trusted)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each group of near-duplicates stays."""
    return without(docs, jaccard_join(docs).where("not kept"), "doc_id", "text")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; a text that loses nothing stays as it is."""
    out = substring_dedup(docs, untouched=True)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col("doc")[c] if c != "text" else None).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return pack(docs)


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]
ORACLE_SQL = None  # a language model, a tokenizer and packing: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
