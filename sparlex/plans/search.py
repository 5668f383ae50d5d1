"""Queries over ranked retrieval."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import retrieval as R
from .registry import query, small, spread, table
from .spans import CHASE_SQL, SECTION_SQL, WORDS_SQL

CHUNKS_SQL = f"""p AS (SELECT doc_id AS paper_id, text FROM documents), {WORDS_SQL.format('p')}, {CHASE_SQL},
lines AS MATERIALIZED (SELECT paper_id, pos AS unit_no, CASE WHEN pos = 0 THEN 'abstract' WHEN pos % 7 = 3 THEN 'caption' ELSE 'section' END AS type, 'H' || (pos // 5) AS heading, b - length(line) AS a, b FROM (
  SELECT d.doc_id AS paper_id, k - 1 AS pos, line, sum(length(line) + 1) OVER (PARTITION BY d.doc_id ORDER BY k) - 1 AS b FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS t(line, k)) WHERE regexp_matches(line, '\\S')), {SECTION_SQL},
spans AS (SELECT 'fixed' AS chunker, paper_id, chunk_no, char_start, char_end FROM fixed UNION ALL SELECT 'section_aware', paper_id, chunk_no, char_start, char_end FROM section WHERE kept),
chunks AS MATERIALIZED (SELECT chunker, s.paper_id, format('{{}}:{{}}:{{:04d}}', s.paper_id, chunker, chunk_no) AS chunk_id, s.char_start::INT AS char_start, s.char_end::INT AS char_end, substr(d.text, s.char_start::INT + 1, (s.char_end - s.char_start)::INT) AS text FROM spans s JOIN documents d ON d.doc_id = s.paper_id),
posted AS MATERIALIZED (SELECT *, sum(tf) OVER (PARTITION BY chunk_id) AS size FROM (SELECT chunker, chunk_id, token, count(*) AS tf FROM (SELECT chunker, chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM chunks) GROUP BY chunker, chunk_id, token)),
ns AS (SELECT chunker, count(*) AS n FROM chunks GROUP BY chunker),
idfs AS MATERIALIZED (SELECT chunker, token, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posted JOIN ns USING (chunker) GROUP BY ALL)"""
ASKED = "list_distinct(regexp_extract_all(lower(array_to_string(list_filter(regexp_extract_all(text, '\\S+'), lambda w, i: i % 3 = 1), ' ')), '[\\p{L}\\p{N}]+'))"
BRANCHES_SQL = f"""{CHUNKS_SQL},
questions AS (SELECT 'q' || item_id AS qid, {ASKED} AS ts FROM benchmark),
asked AS (SELECT qid, unnest(ts) AS token FROM questions),
means AS (SELECT chunker, sum(tf) / any_value(n) AS mean FROM posted JOIN ns USING (chunker) GROUP BY chunker),
sparse AS (SELECT p.chunker, qid, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM posted p JOIN asked USING (token) JOIN idfs i ON i.chunker = p.chunker AND i.token = p.token JOIN means m ON m.chunker = p.chunker GROUP BY ALL),
cvec AS (SELECT chunker, chunk_id, ('0x' || substr(md5(token), 1, 2))::INT % 16 AS d, sum(tf)::DOUBLE AS v FROM posted GROUP BY ALL),
cnorm AS (SELECT chunk_id, sqrt(sum(v * v)) AS norm FROM cvec GROUP BY chunk_id),
qvec AS (SELECT qid, ('0x' || substr(md5(token), 1, 2))::INT % 16 AS d, count(*)::DOUBLE AS v FROM asked GROUP BY ALL),
qnorm AS (SELECT qid, sqrt(sum(v * v)) AS norm FROM qvec GROUP BY qid),
dots AS (SELECT chunker, qid, chunk_id, sum(c.v * q.v) AS dot FROM cvec c JOIN qvec q USING (d) GROUP BY ALL),
-- a chunk that shares no place with a question has cosine 0 and can only fill up a list
dense AS (SELECT c.chunker, n.qid, c.chunk_id, round(coalesce(dot, 0) / (c2.norm * n.norm), 6) AS score FROM (SELECT DISTINCT chunker, chunk_id FROM posted) c JOIN cnorm c2 USING (chunk_id) CROSS JOIN qnorm n LEFT JOIN dots d ON d.chunk_id = c.chunk_id AND d.qid = n.qid),
ranked AS MATERIALIZED (SELECT * FROM (SELECT 'sparse' AS branch, *, row_number() OVER (PARTITION BY chunker, qid ORDER BY score DESC, chunk_id) AS rank FROM sparse
  UNION ALL SELECT 'dense', *, row_number() OVER (PARTITION BY chunker, qid ORDER BY score DESC, chunk_id) FROM dense) WHERE rank <= 100)"""
RRF_SQL = "SELECT chunker, qid, chunk_id, round(sum(1 / (2 + rank - 1)), 6) AS score FROM ranked GROUP BY ALL"
DBSF_SQL = """SELECT chunker, qid, chunk_id, round(sum(part), 6) AS score FROM (SELECT *, CASE WHEN coalesce(s, 0) > 0 THEN (score - (m - 3 * s)) / (6 * s) ELSE 0.5 END AS part
 FROM (SELECT *, avg(score) OVER w AS m, stddev_samp(score) OVER w AS s FROM ranked WINDOW w AS (PARTITION BY branch, chunker, qid))) GROUP BY ALL"""
TOP_SQL = "SELECT *, row_number() OVER (PARTITION BY chunker, qid ORDER BY score DESC, chunk_id) AS rank FROM ({0}) QUALIFY rank <= 10"
HITS_SQL = f"""{BRANCHES_SQL},
hits AS MATERIALIZED (SELECT h.chunker, h.mode, h.qid, h.rank::INT AS rank, h.chunk_id, h.score, c.paper_id, c.char_start, c.char_end, c.text,
  coalesce(list_sum(list_transform(regexp_extract_all(c.text, '\\S+'), lambda w: ceil(length(w) / 4)::INT)), 0)::INT + 2 AS n_tokens FROM (
  SELECT branch AS mode, chunker, qid, chunk_id, score, rank FROM ranked WHERE rank <= 10
  UNION ALL SELECT 'hybrid_rrf', chunker, qid, chunk_id, score, rank FROM ({TOP_SQL.format(RRF_SQL)})
  UNION ALL SELECT 'hybrid_dbsf', chunker, qid, chunk_id, score, rank FROM ({TOP_SQL.format(DBSF_SQL)})) h JOIN chunks c ON c.chunk_id = h.chunk_id)"""
_KEPT: dict = {}
_STATS: dict = {}
MOST_KEPT = 12


def kept(name, spark, sf, make):
    """Intermediate results that many queries share are worked out once a session; the oldest go when there are MOST_KEPT, and what a cleared cache has lost is made anew."""
    key = (name, spark.sparkContext.applicationId, sf)
    if key in _KEPT and not _KEPT[key].storageLevel.useDisk:  # else each use would work out all below it again
        _KEPT.pop(key)
    if key not in _KEPT:
        made = make().persist()  # may keep others first
        while len(_KEPT) >= MOST_KEPT:
            _KEPT.pop(next(iter(_KEPT))).unpersist()
        _KEPT[key] = made
    return _KEPT[key]


def forget() -> None:
    """Gives up all that is kept, for data that changed and for timing queries one by one."""
    _STATS.clear()
    while _KEPT:
        _KEPT.popitem()[1].unpersist()


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("paper_id"), "text")


CUT = C.COLUMNS | {"chunk_id": "string"}


def cut(batches, columns):
    """columns of the chunks that both chunkers keep, of batches (paper_id, text); a batch holds one chunker's."""
    plain = tuple(c for c in C.COLUMNS if c != "text" or c in columns)
    for batch in batches:
        for at in range(0, batch.num_rows, C.DOCS):
            for chunker, least in (("fixed", 0), ("section_aware", 15)):
                for b in C.chunk_batches([batch.slice(at, C.DOCS)], chunker, C.CHUNKERS[chunker], least, columns=plain):
                    b = b.filter(b["kept"])
                    ids = [f"{'null' if p is None else p}:{chunker}:{n:04d}" for p, n in zip(b["paper_id"].to_numpy(zero_copy_only=False).tolist() if not b["paper_id"].null_count else b["paper_id"].to_pylist(), b["chunk_no"].to_numpy().tolist())]
                    if ids:
                        yield b.append_column("chunk_id", pa.array(ids)).select(list(columns))


def cut_documents(docs, columns):
    return docs.select("paper_id", "text").mapInArrow(lambda batches: cut(batches, columns), ", ".join(f"{c} {CUT[c]}" for c in columns))


def chunks(spark, sf, columns=tuple(CUT)):
    return cut_documents(spread(documents(spark, sf)), columns)


TO_ANALYZE = ("chunker", "chunk_id", "text")


def token_counts(spark, sf):
    """chunker, token, df; token null: all chunks."""

    def make():
        counted = spread(documents(spark, sf)).mapInArrow(lambda batches: R.count_batches(R.analyzed_batches(cut(batches, TO_ANALYZE), vectors=False)), "chunker string, token string, df long")
        return counted.groupBy("chunker", "token").agg(F.sum("df").alias("df"))

    return kept("counts", spark, sf, make)


def questions(spark, sf):
    third = F.array_join(F.filter(X.words(F.col("text")), lambda w, i: i % 3 == 0), " ")
    return table(spark, sf, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qid"), "text", F.array_distinct(X.tokens(third)).alias("ts"))


def asked(spark, sf):
    """The stated question set on the driver."""
    q = questions(spark, sf)
    vecs = {r.qid: r.vec for r in R.hashed_vectors(q.select("qid", F.explode("ts").alias("token"), F.lit(1).alias("tf")), ["qid"]).collect()}
    return [R.Asked(r.qid, r.ts or [], vecs.pop(r.qid, None)) for r in q.select("qid", "ts").collect()]


def vocab_of(rows):
    return sorted({t for r in rows for t in r.ts})


def index(spark, sf, vocab):
    """All chunks with what the questions' scores need, a document's text cut and read once."""
    return kept("index", spark, sf, lambda: spread(documents(spark, sf)).mapInArrow(lambda batches: R.index_batches(R.analyzed_batches(cut(batches, TO_ANALYZE)), vocab), R.INDEX))


def stats(spark, sf):
    """(the questions, their tokens' df by chunker and token, (chunks, mean size) by chunker), over the whole collection."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STATS:
        while len(_STATS) >= MOST_KEPT:
            _STATS.pop(next(iter(_STATS)))
        rows = asked(spark, sf)
        vocab = vocab_of(rows)
        _STATS[key] = (rows, *R.index_stats(index(spark, sf, vocab), vocab))
    return _STATS[key]


def branches(spark, sf, prefetch: int = 100):
    """The prefetch best of each branch: branch, chunker, qid, chunk_id, score, rank."""

    def make():
        rows, df, size = stats(spark, sf)
        vocab = vocab_of(rows)
        return R.top(R.index_best(index(spark, sf, vocab), vocab, rows, df, size, prefetch), ["branch", "chunker", "qid"], prefetch)

    return kept(f"branches{prefetch}", spark, sf, make)


def search(spark, sf, mode: str, limit: int = 10):
    R.check_mode(mode)
    b = branches(spark, sf)
    if mode in ("dense", "sparse"):
        return b.where(F.col("branch") == mode).where(F.col("rank") <= limit).select("chunker", "qid", "chunk_id", "score", "rank")
    return R.top(R.fuse_rrf(b) if mode == "hybrid_rrf" else R.fuse_dbsf(b), ["chunker", "qid"], limit).select("chunker", "qid", "chunk_id", "score", "rank")


def branches_within(spark, sf, allowed, prefetch: int = 100):
    """As branches, for the questions of allowed (qid, paper_id) and within their papers, each with its place: the filter stands before every top-k. Only those papers are cut, and only allowed pairs leave a task."""
    blocks = R.score_blocks(*stats(spark, sf))
    by_paper = allowed.groupBy("paper_id").agg(F.collect_set("qid").alias("qids"))
    docs = spread(documents(spark, sf).join(small(by_paper), "paper_id").select("paper_id", "text", "qids"))
    columns = ("chunker", "chunk_id", "text", "paper_id", "char_start", "char_end")

    def run(batches):
        for b in (x.slice(at, C.DOCS) for x in batches for at in range(0, x.num_rows, C.DOCS)):
            yield from R.scores_within(cut([b.select(["paper_id", "text"])], columns), dict(zip(b["paper_id"].to_pylist(), b["qids"].to_pylist())), blocks)

    scored = docs.mapInArrow(run, "branch string, chunker string, qid string, chunk_id string, paper_id long, char_start int, char_end int, score double")
    return R.top(scored, ["branch", "chunker", "qid"], prefetch)


def modes_of(branched, limit: int = 10):
    """The best of every mode: chunker, mode, qid, chunk_id, score, rank."""
    cols = ["chunker", "qid", "chunk_id", "score", "rank"]
    out = branched.where(F.col("rank") <= limit).select(*cols, F.col("branch").alias("mode"))
    for mode, fuse in (("hybrid_rrf", R.fuse_rrf), ("hybrid_dbsf", R.fuse_dbsf)):
        out = out.unionByName(R.top(fuse(branched), ["chunker", "qid"], limit).select(*cols, F.lit(mode).alias("mode")))
    return out


def placed(spark, sf, name, find, columns):
    """What find gives (chunk_id), kept under a name, with columns of its chunks: only the papers that were found are cut again."""
    found = kept(name, spark, sf, find)
    papers = found.select(F.split("chunk_id", ":")[0].alias("paper")).distinct()
    docs = documents(spark, sf).join(small(papers), F.format_string("%d", "paper_id") == F.col("paper"), "left_semi")
    return small(found).join(cut_documents(spread(docs), ("chunk_id", *columns)), "chunk_id")


def hits(spark, sf):
    """chunker, mode, qid, rank, score and the chunk of every configuration's ten best."""
    return kept("hits", spark, sf, lambda: placed(spark, sf, "tops", lambda: modes_of(branches(spark, sf)), ("paper_id", "char_start", "char_end", "n_tokens", "text")))


def ranked_sql(inner):
    return f"WITH {BRANCHES_SQL} SELECT chunker, qid, chunk_id, score, rank::INT AS rank FROM ({inner})"


@query("search_sparse", ranked_sql("SELECT * FROM ranked WHERE branch = 'sparse' AND rank <= 10"))
def search_sparse(spark, sf):
    return search(spark, sf, "sparse")


@query("hybrid_rrf", ranked_sql(TOP_SQL.format(RRF_SQL)))
def hybrid_rrf(spark, sf):
    return search(spark, sf, "hybrid_rrf")


@query("hybrid_dbsf", ranked_sql(TOP_SQL.format(DBSF_SQL)))
def hybrid_dbsf(spark, sf):
    return search(spark, sf, "hybrid_dbsf")


@query("search_dense", """SELECT q.vec_id AS qid, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
 (row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id))::INT AS rank
 FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10""")
def search_dense(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    queries = e.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), F.col("vec").cast("array<double>").alias("vec"))  # the stated query set
    return R.top(R.dense_scores(queries, e, ["chunk_id"], 10), ["qid"], 10).select("qid", "chunk_id", "score", "rank")


@query("prefetch_ceiling", f"WITH {BRANCHES_SQL} SELECT chunker, qid, count(DISTINCT chunk_id) AS candidates, count(DISTINCT chunk_id) <= 200 AS within FROM ranked GROUP BY ALL")
def prefetch_ceiling(spark, sf):
    return branches(spark, sf).groupBy("chunker", "qid").agg(F.count_distinct("chunk_id").alias("candidates")).withColumn("within", F.col("candidates") <= 200)


@query("idf_table", f"WITH {CHUNKS_SQL} SELECT chunker, token, df, round(idf, 6) AS idf FROM idfs")
def idf_table(spark, sf):
    counts = token_counts(spark, sf)
    n = {r.chunker: r.df for r in counts.where("token IS NULL").collect()}  # a row a chunker
    return R.idf_table(counts.where("token IS NOT NULL"), n).select("chunker", "token", "df", F.round("idf", 6).alias("idf"))


@query("config_grid", "SELECT 'q' || item_id AS qid, c AS chunker, m AS mode FROM benchmark, unnest(['fixed', 'section_aware']) AS t(c), unnest(['dense', 'sparse', 'hybrid_rrf', 'hybrid_dbsf']) AS u(m)")
def config_grid(spark, sf):
    q = questions(spark, sf).select("qid", F.explode(F.array(F.lit("fixed"), F.lit("section_aware"))).alias("chunker"))
    return q.select("*", F.explode(F.array(*map(F.lit, R.MODES))).alias("mode"))
