"""Quality classifier: an interpolated modified Kneser-Ney word model trained on trusted text.

The model (``word_model``) counts words by their own code points, so what it gathers grows with the
trusted texts and no character or script is merged with another; counts and lookups are joins
sharded by n-gram. Each document gets its perplexity, a code point, over its whole text.

A short text says little: its mean log probability is shrunk toward its language's mean by
``prior`` characters. The limit of a language is a quantile of the (shrunk) perplexity of trusted
documents that the model was not trained on (every fourth by checksum of the id), times a slack;
documents above it are rejected. A null language, or one without trusted documents, takes the
limit of all.

Defined results: texts without characters (null, empty) have no perplexity and are not kept; with
no trusted text at all nothing is rejected but those; repeated rows and ties are scored alike; a very
long text is one slice of its own and scored whole; an empty table gives an empty table; further
columns, whatever their names, are carried in ``row``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_model
from .common import column, released, row_key, saved, small, utf8_bytes, without
from .language_id import held_out

def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled good and not toxic."""
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()


def quality_classifier(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, slack: float = 1.25, prior: float = 100.0) -> DataFrame:
    """row (the input row without its text), perplexity, limit, kept for every row."""
    spark, trusted = docs.sparkSession, small(saved(trusted.withColumnRenamed("trusted_id", "known_id"), "trusted-ids"))
    inner = F.struct(*[column(c) for c in docs.columns if c != text_col]).alias("doc")
    row = docs.select(F.struct(inner, F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang")).alias("row"), F.col(text_col).cast("string").alias("text"))
    own = row.where(~held_out("row.id")).select(F.col("row.id").alias("id"), "text").join(trusted, F.col("id") == F.col("known_id"), "left_semi")
    model = word_model.train(own, utf8_bytes(row))
    released(spark)
    lean = saved(word_model.scores(row, model).select("row.*", "n_symbols", "nats"), "scores")
    released(spark)
    mean = lean.where("n_symbols > 0").groupBy("lang").agg((F.sum("nats") / F.sum("n_symbols")).alias("mean"))
    mean = saved(mean.where("lang is not null"), "means")
    every = lean.agg((F.sum("nats") / F.sum("n_symbols")).alias("m")).first().m or 0.0
    value = F.when(F.col("n_symbols") > 0, F.exp((F.col("nats") + prior * F.coalesce("mean", F.lit(every))) / (F.col("n_symbols") + prior)))
    known = lean.where(held_out("id")).join(trusted, F.col("id") == F.col("known_id"), "left_semi").join(mean, "lang", "left").select("lang", value.alias("v"))
    known = saved(known.where("v is not null"), "trusted")
    limits = mean.join(known.groupBy("lang").agg((F.percentile_approx("v", quantile, 100000) * slack).alias("own")), "lang", "left")
    limits = saved(limits, "limits").withColumnRenamed("lang", "of")
    most = known.agg(F.percentile_approx("v", quantile, 100000).alias("q")).first().q
    most = most * slack if most is not None else float("inf")
    out = lean.join(limits, F.col("lang") == F.col("of"), "left")
    out = out.select(F.col("doc").alias("row"), value.alias("perplexity"), F.coalesce("own", F.lit(most)).alias("limit"))
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(False)))


def classified(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs that are kept, whole."""
    keyed = docs.select(id_col, text_col, lang_col, F.struct(*row_key(F.col(text_col), F.col(lang_col))).alias("key of the row"))
    verdicts = quality_classifier(keyed, trusted, id_col, text_col, lang_col, **options)
    return without(docs, verdicts.where("not kept").select("row.`key of the row`.*"), text_col, lang_col)
