"""Grounded answers: context for a generator, a stub generator, abstention and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X


def context_block(hits: DataFrame) -> DataFrame:
    """qid, context: the hits numbered by rank, each under its title, year and heading."""
    some = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), other)
    head = some("section_heading", some("parent_heading", F.lit("n/a")))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), some("title", F.lit("Untitled")), F.lit(" ("), some("year", F.lit("n.d.")), F.lit(") -- "), head, F.lit("\n"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(rows, lambda x: x["block"]), "\n\n").alias("context"))


def read_reply(replies: DataFrame, n_hits: int = 5) -> DataFrame:
    """qid, answer, abstained, citations of what a generator replied (qid, reply)."""
    reply = X.strip_reasoning(F.col("reply"))
    r = replies.select("qid", X.abstention_text(reply).alias("answer"), X.abstained(reply).alias("abstained"))
    return r.withColumn("citations", F.filter(X.cited(F.col("answer")), lambda x: x.between(1, n_hits)))


def extractive_answer(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """A generator that needs no model: the first sentence of the first hit, cited; it declines where there is none."""
    first = hits.where("rank = 1").select("qid", F.concat(F.split_part("text", F.lit("."), F.lit(1)), F.lit(". [1]")).alias("found"))
    return read_reply(questions.join(first, "qid", "left").select("qid", F.coalesce("found", F.lit(X.ABSTAIN)).alias("reply")))
