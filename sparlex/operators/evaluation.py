"""Relevance, ranking metrics, pooling, judging and resampling over hits and gold spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import overlap_ratio

CONFIG = ["chunker", "mode"]


def matches(hits: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """Hits with each gold span (span_id) of their question and paper that they cover enough of."""
    g = gold.select(F.col("qid").alias("q_"), F.col("paper_id").alias("p_"), F.col("char_start").alias("g0"), F.col("char_end").alias("g1"), F.xxhash64("qid", "paper_id", "char_start", "char_end").alias("span_id"))
    on = (F.col("qid") == F.col("q_")) & (F.col("paper_id") == F.col("p_")) & (overlap_ratio(F.col("char_start"), F.col("char_end"), F.col("g0"), F.col("g1")) >= least)
    return hits.join(g, on).drop("q_", "p_", "g0", "g1")


CHUNKERS, MODES = ("fixed", "section_aware"), ("dense", "sparse", "hybrid_rrf", "hybrid_dbsf")
CONFIGS = tuple((c, m) for c in CHUNKERS for m in MODES)


def first_rank(hits: DataFrame, gold: DataFrame, configs=CONFIGS) -> DataFrame:
    """chunker, mode, qid, first (null if no hit is relevant): starts from the questions, each under every configuration, so that none is lost."""
    every = F.array(*[F.struct(F.lit(c).alias("chunker"), F.lit(m).alias("mode")) for c, m in configs])
    asked = gold.select("qid").distinct().select("qid", F.inline(every)).select(*CONFIG, "qid")
    found = matches(hits, gold).groupBy(*CONFIG, "qid").agg(F.min("rank").alias("first"))
    return asked.join(found, [*CONFIG, "qid"], "left")


def reciprocal(first: Column) -> Column:
    return F.coalesce(1.0 / first, F.lit(0.0))


def resample_index(seed: int, n: Column) -> Column:
    """Place of draw i of resample r among n, from a checksum: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") % n


def bootstrap(values: DataFrame, columns: list[Column], n_resamples: int, seed: int) -> DataFrame:
    """columns (aggregates) of every resample r. values: i (0 to n - 1) and what the aggregates need."""
    spark, n = values.sparkSession, values.count()
    draws = spark.range(n_resamples).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("i"))
    drawn = draws.select("r", resample_index(seed, F.lit(max(n, 1))).cast("int").alias("i"))
    return drawn.join(values, "i").groupBy("r").agg(*columns)


def interval(resampled: DataFrame, column: str) -> DataFrame:
    return resampled.agg(F.round(F.percentile(column, 0.025), 6).alias("ci_low"), F.round(F.percentile(column, 0.975), 6).alias("ci_high"))


def bootstrap_exact(values: np.ndarray, n_resamples: int = 10_000, seed: int = 42) -> tuple[float, float, float]:
    """(mean, low, high) with numpy's own generator, for a small sample on the driver; NaN if it is empty."""
    if not len(values):
        return (float("nan"),) * 3
    means = values[np.random.default_rng(seed).integers(0, len(values), size=(n_resamples, len(values)))].mean(1)
    return float(values.mean()), *(float(x) for x in np.percentile(means, [2.5, 97.5]))


def exact_dedup(items: DataFrame) -> DataFrame:
    """One row a span of a question: the union of its configurations; manual if any was."""
    return items.groupBy("qid", "paper_id", "char_start", "char_end").agg(F.sort_array(F.flatten(F.collect_set("configs"))).alias("configs"), F.max(F.col("seed") == "manual").alias("manual"))


def overlap_dedup(items: DataFrame, most: float = 0.8) -> DataFrame:
    """Greedy: manual spans first, then the shortest; a span overlapping a kept one by more than most is absorbed by the first such.

    Only spans of one question and paper can meet, so these are a group, a row of spans each; a question's groups lie in many tasks.
    """
    cols = ["char_start", "char_end", "configs", "manual"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for qid, paper, spans in zip(*(c.to_pylist() for c in b.columns)):
                kept: list[dict] = []
                spans.sort(key=lambda r: (not r["manual"], r["char_end"] - r["char_start"], r["char_start"]))
                for row in spans:
                    size = row["char_end"] - row["char_start"]
                    for k in kept:
                        shared = min(k["char_end"], row["char_end"]) - max(k["char_start"], row["char_start"])
                        shorter = min(k["size"], size)
                        if shorter > 0 and max(0, shared) / shorter > most:
                            k["configs"] |= set(row["configs"])
                            k["absorbed"] += 1
                            break
                    else:
                        kept.append(row | {"configs": set(row["configs"]), "absorbed": 0, "size": size})
                out += [(qid, paper, k["char_start"], k["char_end"], sorted(k["configs"]), k["manual"], k["absorbed"]) for k in kept]
            kinds = dict(qid=pa.string(), paper_id=pa.int64(), char_start=pa.int32(), char_end=pa.int32(), configs=pa.list_(pa.string()), manual=pa.bool_(), absorbed=pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    groups = items.groupBy("qid", "paper_id").agg(F.collect_list(F.struct(*cols)).alias("spans"))
    return groups.mapInArrow(run, "qid string, paper_id long, char_start int, char_end int, configs array<string>, manual boolean, absorbed int")


def reconcile(questions: DataFrame, pool: DataFrame, negatives: DataFrame) -> DataFrame:
    """qid, has_answer, outcome, unjudged. questions: qid, has_answer, n_gold; a gold span means true; a q question whose pool is all judged and has none means false."""
    key = ["qid", "paper_id", "char_start", "char_end"]
    left = pool.join(negatives.select(*key).distinct(), key, "left_anti").groupBy("qid").agg(F.count("*").alias("unjudged"))
    q = questions.join(left, "qid", "left").withColumn("unjudged", F.coalesce("unjudged", F.lit(0)))
    outcome = (
        F.when((F.col("n_gold") > 0) & ~F.col("has_answer").eqNullSafe(True), "corrected_to_true")
        .when(F.col("n_gold") > 0, "confirmed_true")
        .when(~F.startswith("qid", F.lit("q")), "confirmed_false")
        .when(F.col("unjudged") > 0, "incomplete")
        .when(~F.col("has_answer").eqNullSafe(False), "flipped_to_false")
        .otherwise("confirmed_false")
    )
    now = F.when(outcome == "corrected_to_true", True).when(outcome == "flipped_to_false", False).otherwise(F.col("has_answer"))
    return q.select("qid", now.alias("has_answer"), outcome.alias("outcome"), "unjudged")




def eval_set_problems(questions: DataFrame, gold: DataFrame, papers: DataFrame) -> DataFrame:
    """qid, problem of every breach of an evaluation set.

    questions: qid (each further row of an id is one); gold: qid, paper_id, named (the paper that the question's own record
    resolves to), char_start, size, needle (the span's text); papers: paper_id, text.
    """
    more = questions.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1")
    repeated = more.select("qid", F.explode(F.array_repeat(F.lit("duplicate qid"), (F.col("n") - 1).cast("int"))).alias("problem"))
    x = gold.join(papers.select(F.col("paper_id").alias("known"), "text"), F.col("paper_id") == F.col("known"), "left")
    there = F.array(
        F.when(~F.substr("text", F.col("char_start") + 1, F.col("size")).eqNullSafe(F.col("needle")), "slice differs"),
        F.when(F.col("named") != F.col("paper_id"), "paper differs"),
    )
    found = F.when(F.col("known").isNull(), F.array(F.lit("unknown paper"))).otherwise(F.filter(there, lambda p: p.isNotNull()))
    return repeated.unionByName(x.select("qid", F.explode(found).alias("problem")))
