"""Registered queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .embedding_dedup import embedding_dedup
from .jaccard_join import jaccard_join
from .language_id import language_id
from .packing import pack
from .quality_classifier import quality_classifier, trusted_documents
from .quality_rules import STATS, quality_rules
from .sentence_pieces import sp_decode, sp_encode
from .substring_dedup import substring_dedup
from .token_files import read_token_files, write_token_files
from .warc import page_id, read_warc, write_warc


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = sp_decode(sp_encode(docs, keep=["doc_id"]))
    return back.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select(F.col("doc.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), []) AS words FROM documents),
win AS (
  SELECT doc_id, i AS start, list_slice(words, i, i + 19) AS win
  FROM w, unnest(range(1, len(words) - 18)) AS t(i)),
dup AS (
  SELECT doc_id, start FROM win
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, start) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(start, start + 20)) AS p FROM dup) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP3_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON a = vec_id
"""


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("key_a", "key_b")


OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(words, i, i + 4) AS g FROM w, unnest(range(1, 1 + CASE WHEN len(words) >= 5 THEN len(words) - 4 ELSE least(len(words), 1) END)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a)
SELECT a AS doc_id, class_id, (SELECT count(*) FROM links l WHERE l.a = c.a) AS n_links, class_id = c.a AS kept FROM c
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    scored = quality_classifier(docs, trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(F.col("row.doc_id").alias("doc_id"), "perplexity", "limit", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_files(spark, write_token_files(docs))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules(docs, keep_doc=["doc_id"]).select(F.col("doc.doc_id").alias("doc_id"), *STATS, "base_failed", "kept")


OP9_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS win FROM w, unnest(range(1, len(words) - 3)) AS t(i)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR 3 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_words) AS bad
  FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(bad) / sum(n) AS mean, count(*) AS hosts, sum(n) AS docs, sum(n * (bad / n) * (bad / n)) AS square FROM h),
p AS (SELECT mean, greatest(1.0, least(1e6, mean * (1 - mean) / greatest(greatest(square / docs - mean * mean, 0) - mean * (1 - mean) * hosts / docs, 1e-9) - 1)) AS strength FROM m),
v AS (SELECT source, (bad + mean * strength) / (n + strength) > 0.5 AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM f LEFT JOIN v USING (source)
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    back = read_warc(spark, write_warc(pages, shared_dir(spark, "warc")), payloads=False)
    return back.select(page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to").alias("refers_to"))


def queries() -> dict:
    return {
        "op1_sentence_pieces": op1_sentence_pieces,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_language_id": op6_language_id,
        "op7_token_files": op7_token_files,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_quality_rules": op9_quality_rules,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict:
    return {"op2_substring_dedup": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op9_quality_rules": OP9_SQL}
