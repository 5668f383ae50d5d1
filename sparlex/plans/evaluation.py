"""Queries over relevance, metrics, pooling, judging, statistics and grounded answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.metadata import normalize_doi
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators.spans import overlap_ratio
from .metadata import DOI, DOI_SQL
from .registry import query, small, table
from .search import CHUNKS_SQL, DBSF_SQL, HITS_SQL, RRF_SQL, TOP_SQL, branches, branches_within, chunks, hits, kept, modes_of, placed, stats
from .spans import GOLD_SQL, gold

RATIO_SQL = "greatest(0, least(h.char_end, g.char_end) - greatest(h.char_start, g.char_start)) / least(h.char_end - h.char_start, g.char_end - g.char_start)"
METRICS_SQL = f"""{HITS_SQL}, {GOLD_SQL},
asks AS (SELECT DISTINCT qid FROM gold), grid AS (SELECT * FROM (SELECT * FROM unnest(['fixed', 'section_aware']) AS a(chunker), unnest(['dense', 'sparse', 'hybrid_rrf', 'hybrid_dbsf']) AS b(mode)) CROSS JOIN asks),
rel AS MATERIALIZED (SELECT h.chunker, h.mode, h.qid, h.rank, h.chunk_id, h.paper_id, g.char_start AS g0 FROM hits h JOIN gold g ON g.qid = h.qid AND g.paper_id = h.paper_id AND {RATIO_SQL} >= 0.5),
firsts AS MATERIALIZED (SELECT chunker, mode, qid, min(rank) AS first FROM grid LEFT JOIN rel USING (chunker, mode, qid) GROUP BY ALL),
rr AS MATERIALIZED (SELECT *, coalesce(1.0::DOUBLE / first, 0) AS rr FROM firsts)"""


def spans_of(spark, sf):
    return kept("gold", spark, sf, lambda: gold(spark, sf))


def firsts(spark, sf):
    return kept("firsts", spark, sf, lambda: E.first_rank(hits(spark, sf), spans_of(spark, sf)).withColumn("rr", E.reciprocal(F.col("first"))))


def with_metrics(tail):
    return f"WITH {METRICS_SQL} {tail}"


@query("relevant_hits", with_metrics("SELECT DISTINCT chunker, mode, qid, rank, chunk_id FROM rel"))
def relevant_hits(spark, sf):
    return E.matches(hits(spark, sf), spans_of(spark, sf)).select("chunker", "mode", "qid", "rank", "chunk_id").distinct()


@query("chunk_matches_any", f"WITH {CHUNKS_SQL}, {GOLD_SQL} SELECT chunk_id, EXISTS (SELECT 1 FROM gold g WHERE g.paper_id = h.paper_id AND {RATIO_SQL} >= 0.5) AS relevant FROM chunks h")
def chunk_matches_any(spark, sf):
    g = spans_of(spark, sf).groupBy("paper_id").agg(F.collect_set(F.struct("char_start", "char_end")).alias("spans"))  # a row a paper: a chunk stays one row
    c = chunks(spark, sf, ("chunk_id", "paper_id", "char_start", "char_end")).join(small(g), "paper_id", "left")
    hit = F.exists("spans", lambda s: overlap_ratio(F.col("char_start"), F.col("char_end"), s["char_start"], s["char_end"]) >= 0.5)
    return c.select("chunk_id", F.coalesce(hit, F.lit(False)).alias("relevant"))


@query("reciprocal_rank", with_metrics("SELECT chunker, mode, qid, round(rr, 6) AS rr FROM rr"))
def reciprocal_rank(spark, sf):
    return firsts(spark, sf).select("chunker", "mode", "qid", F.round("rr", 6).alias("rr"))


@query("success_at_k", with_metrics("SELECT chunker, mode, qid, k::INT AS k, coalesce(first <= k, false) AS success FROM firsts, unnest([1, 3, 5, 10]) AS t(k)"))
def success_at_k(spark, sf):
    f = firsts(spark, sf).select("*", F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))).alias("k"))
    return f.select("chunker", "mode", "qid", "k", F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).alias("success"))


@query("recall_at_k", with_metrics("""SELECT chunker, mode, qid, k::INT AS k, round(count(DISTINCT (paper_id, g0)) FILTER (rank <= k) / any_value(n), 6) AS recall
 FROM grid LEFT JOIN rel USING (chunker, mode, qid) JOIN (SELECT qid, count(*) AS n FROM gold GROUP BY qid) USING (qid), unnest([1, 3, 5, 10]) AS t(k) GROUP BY chunker, mode, qid, k"""))
def recall_at_k(spark, sf):
    found = E.matches(hits(spark, sf), spans_of(spark, sf)).groupBy("chunker", "mode", "qid").agg(*[F.count_distinct(F.when(F.col("rank") <= k, F.col("span_id"))).alias(f"k{k}") for k in (1, 3, 5, 10)])
    n = spans_of(spark, sf).groupBy("qid").agg(F.count("*").alias("n"))
    f = firsts(spark, sf).select("chunker", "mode", "qid").join(found, ["chunker", "mode", "qid"], "left").join(n, "qid")
    by_k = f.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"k{k}", F.lit(0)).alias("c")) for k in (1, 3, 5, 10)])).alias("x"))
    return by_k.select("chunker", "mode", "qid", "x.k", F.round(F.col("x.c") / F.col("n"), 6).alias("recall"))


@query("mrr_by_config", with_metrics("SELECT chunker, mode, count(*) AS n, round(coalesce(avg(rr), 0), 6) AS mrr, round(avg((coalesce(first, 99) <= 1)::INT), 6) AS success1, round(avg((coalesce(first, 99) <= 10)::INT), 6) AS success10 FROM rr GROUP BY ALL"))
def mrr_by_config(spark, sf):
    ok = lambda k: F.round(F.avg((F.coalesce("first", F.lit(99)) <= k).cast("int")), 6)
    return firsts(spark, sf).groupBy("chunker", "mode").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("rr"), F.lit(0.0)), 6).alias("mrr"), ok(1).alias("success1"), ok(10).alias("success10"))


TO_FIRST_SQL = "SELECT f.chunker, f.mode, f.qid, coalesce(sum(n_tokens), 'Infinity'::DOUBLE)::DOUBLE AS tokens FROM firsts f LEFT JOIN hits h ON h.chunker = f.chunker AND h.mode = f.mode AND h.qid = f.qid AND h.rank <= f.first GROUP BY ALL"


@query("tokens_to_first", with_metrics(TO_FIRST_SQL))
def tokens_to_first(spark, sf):
    h = hits(spark, sf).select("chunker", "mode", "qid", "rank", "n_tokens")
    both = firsts(spark, sf).join(h, ["chunker", "mode", "qid"], "left")
    spent = F.sum(F.when(F.col("rank") <= F.col("first"), F.coalesce("n_tokens", F.lit(0)))).cast("double")
    return both.groupBy("chunker", "mode", "qid").agg(F.coalesce(spent, F.lit(float("inf"))).alias("tokens"))


BUDGETS = (50, 100, 200, 500, 1000, 2000)


@query("success_at_budget", with_metrics(f"SELECT chunker, mode, budget::INT AS budget, round(avg((tokens <= budget)::INT), 6) AS success FROM ({TO_FIRST_SQL}), unnest({list(BUDGETS)}) AS t(budget) GROUP BY ALL"))
def success_at_budget(spark, sf):
    t = tokens_to_first(spark, sf).select("*", F.explode(F.array(*map(F.lit, BUDGETS))).alias("budget"))
    return t.groupBy("chunker", "mode", "budget").agg(F.round(F.avg((F.col("tokens") <= F.col("budget")).cast("int")), 6).alias("success"))


@query("tokens_per_result_list", f"WITH {HITS_SQL} SELECT chunker, round(avg(n), 6) AS mean_tokens FROM (SELECT chunker, mode, qid, sum(n_tokens) AS n FROM hits GROUP BY ALL) GROUP BY chunker")
def tokens_per_result_list(spark, sf):
    n = hits(spark, sf).groupBy("chunker", "mode", "qid").agg(F.sum("n_tokens").alias("n"))
    return n.groupBy("chunker").agg(F.round(F.avg("n"), 6).alias("mean_tokens"))


PAIRS_SQL = "SELECT a.mode, a.qid, a.rr AS a, b.rr AS b FROM rr a JOIN rr b ON a.mode = b.mode AND a.qid = b.qid AND a.chunker = 'section_aware' AND b.chunker = 'fixed'"


def pairs(spark, sf):
    r = firsts(spark, sf)
    a, b = (r.where(F.col("chunker") == c).select("mode", "qid", F.col("rr").alias(n)) for c, n in (("section_aware", "a"), ("fixed", "b")))
    return a.join(b, ["mode", "qid"])


@query("win_loss_tie", with_metrics(f"SELECT mode, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, count(*) FILTER (a = b) AS ties FROM ({PAIRS_SQL}) GROUP BY mode"))
def win_loss_tie(spark, sf):
    return pairs(spark, sf).groupBy("mode").agg(F.count_if(F.expr("a > b")).alias("wins"), F.count_if(F.expr("a < b")).alias("losses"), F.count_if(F.expr("a = b")).alias("ties"))


@query("rrf_k_sweep", f"""WITH {METRICS_SQL}, swept AS (SELECT k, chunker, qid, chunk_id, round(sum(1 / (k + rank - 1)), 6) AS score FROM ranked, unnest([1, 2, 4, 10, 20, 60]) AS t(k) GROUP BY ALL),
tops AS (SELECT *, row_number() OVER (PARTITION BY k, chunker, qid ORDER BY score DESC, chunk_id) AS rank FROM swept QUALIFY rank <= 10),
found AS (SELECT k, h.chunker, h.qid, min(rank) AS first FROM tops h JOIN chunks c ON c.chunk_id = h.chunk_id JOIN gold g ON g.qid = h.qid AND g.paper_id = c.paper_id AND {RATIO_SQL.replace('h.char', 'c.char')} >= 0.5 GROUP BY ALL)
SELECT k::INT AS k, chunker, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM (SELECT * FROM (SELECT DISTINCT chunker FROM chunks) CROSS JOIN asks CROSS JOIN unnest([1, 2, 4, 10, 20, 60]) AS t(k)) LEFT JOIN found f USING (k, chunker, qid) GROUP BY ALL""")
def rrf_k_sweep(spark, sf):
    out, b = None, branches(spark, sf)
    for k in (1, 2, 4, 10, 20, 60):
        h = R.top(R.fuse_rrf(b, k), ["chunker", "qid"], 10).withColumn("mode", F.lit(str(k)))
        out = h if out is None else out.unionByName(h)
    f = E.first_rank(placed(spark, sf, "sweep", lambda: out, ("paper_id", "char_start", "char_end")), spans_of(spark, sf), [(c, str(k)) for c in E.CHUNKERS for k in (1, 2, 4, 10, 20, 60)]).withColumn("rr", E.reciprocal(F.col("first")))
    return f.groupBy(F.col("mode").cast("int").alias("k"), "chunker").agg(F.round(F.avg("rr"), 6).alias("mrr"))


# ---- resampling ----
N_RESAMPLES, SEED = 10_000, 42
DRAW = f"(('0x' || substr(md5('{SEED}|' || r || '|' || i), 1, 8))::UBIGINT % n)::INT"
VALUES_SQL = "v AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY qid) - 1)::INT AS i, qid, a, b, a - b AS d FROM (SELECT qid, a.rr AS a, b.rr AS b FROM rr a JOIN rr b USING (qid) WHERE a.chunker = 'section_aware' AND a.mode = 'dense' AND b.chunker = 'fixed' AND b.mode = 'sparse'))"
DRAWN_SQL = f"drawn AS (SELECT r, {DRAW} AS i FROM range({N_RESAMPLES}) AS x(r), (SELECT count(*) AS n FROM v), range((SELECT count(*) FROM v)) AS y(i))"
CI_SQL = "round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high"


def values(spark, sf):
    f = firsts(spark, sf)
    a = f.where("chunker = 'section_aware' AND mode = 'dense'").select("qid", F.col("rr").alias("a"))
    b = f.where("chunker = 'fixed' AND mode = 'sparse'").select("qid", F.col("rr").alias("b"))
    return kept("values", spark, sf, lambda: a.join(b, "qid").select((F.row_number().over(Window.orderBy("qid")) - 1).alias("i"), "qid", "a", "b", (F.col("a") - F.col("b")).alias("d")))  # a row a question


def _mean_ci(spark, sf, column, rounded="mean"):
    v = values(spark, sf)
    ci = E.interval(E.bootstrap(v, [F.avg(column).alias("m")], N_RESAMPLES, SEED), "m")
    return v.agg(F.round(F.avg(column), 6).alias(rounded), F.count("*").alias("n")).join(ci)  # one row each


@query("bootstrap_mean", with_metrics("").rstrip() + f", {VALUES_SQL}, {DRAWN_SQL} SELECT (SELECT round(avg(a), 6) FROM v) AS mean, (SELECT count(*) FROM v) AS n, {CI_SQL} FROM (SELECT r, avg(a) AS m FROM drawn JOIN v USING (i) GROUP BY r)")
def bootstrap_mean(spark, sf):
    return _mean_ci(spark, sf, "a")


@query("paired_bootstrap", with_metrics("").rstrip() + f", {VALUES_SQL}, {DRAWN_SQL} SELECT (SELECT round(avg(d), 6) FROM v) AS difference, (SELECT count(*) FROM v) AS n, {CI_SQL} FROM (SELECT r, avg(d) AS m FROM drawn JOIN v USING (i) GROUP BY r)")
def paired_bootstrap(spark, sf):
    return _mean_ci(spark, sf, "d", "difference")


CLUSTER = "CASE WHEN CAST(substr(qid, 2) AS INT) % 5 = 0 THEN NULL ELSE CAST(substr(qid, 2) AS INT) % 4 END"


@query("cluster_bootstrap", with_metrics("").rstrip() + f""", {VALUES_SQL.replace('v AS MATERIALIZED', 'v0 AS MATERIALIZED')}, c AS (SELECT {CLUSTER} AS cluster, sum(d) AS total, count(*) AS size FROM v0 GROUP BY 1),
v AS (SELECT (row_number() OVER (ORDER BY cluster NULLS FIRST) - 1)::INT AS i, total, size FROM c), {DRAWN_SQL}
SELECT (SELECT round(avg(d), 6) FROM v0) AS difference, (SELECT count(*) FROM v) AS clusters, {CI_SQL} FROM (SELECT r, sum(total) / sum(size) AS m FROM drawn JOIN v USING (i) GROUP BY r)""")
def cluster_bootstrap(spark, sf):
    v = values(spark, sf)
    c = v.groupBy(F.expr(CLUSTER).alias("cluster")).agg(F.sum("d").alias("total"), F.count("*").alias("size"))
    c = c.select((F.row_number().over(Window.orderBy(F.asc_nulls_first("cluster"))) - 1).alias("i"), "total", "size")
    ci = E.interval(E.bootstrap(c, [(F.sum("total") / F.sum("size")).alias("m")], N_RESAMPLES, SEED), "m")
    return v.agg(F.round(F.avg("d"), 6).alias("difference")).join(c.agg(F.count("*").alias("clusters"))).join(ci)


OVERLAP_SQL = f"""{CHUNKS_SQL}, words_of AS (SELECT 'q' || item_id AS qid, item_id, regexp_extract_all(text, '\\S+') AS ws FROM benchmark),
sides AS (SELECT qid, item_id, list_distinct(regexp_extract_all(lower(array_to_string(list_filter(ws, lambda w, i: i % 3 = 1), ' ')), '[\\p{{L}}\\p{{N}}]+')) AS q,
  regexp_extract_all(lower(array_to_string(ws[1:len(ws) // 2], ' ')), '[\\p{{L}}\\p{{N}}]+') AS a FROM words_of),
weighed AS (SELECT qid, item_id, t, coalesce((SELECT idf FROM idfs WHERE idfs.chunker = 'fixed' AND token = t), ln(1 + ((SELECT n FROM ns WHERE chunker = 'fixed') + 0.5) / 0.5)) AS w, list_contains(a, t) AS shared FROM (SELECT qid, item_id, a, unnest(q) AS t FROM sides)),
overlap_of AS (SELECT qid, item_id, coalesce(sum(w) FILTER (shared) / nullif(sum(w), 0), 0) AS overlap FROM weighed GROUP BY ALL)"""


def overlaps(spark, sf):
    def make():
        b = table(spark, sf, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qid"), "item_id", X.words(F.col("text")).alias("ws"))
        third = F.array_join(F.filter("ws", lambda w, i: i % 3 == 0), " ")
        b = b.select("qid", "item_id", F.array_distinct(X.tokens(third)).alias("q"), X.tokens(F.array_join(F.slice("ws", F.lit(1), F.expr("int(size(ws) div 2)")), " ")).alias("a"))
        t = b.select("qid", "item_id", F.explode("q").alias("token"), "a").withColumn("shared", F.array_contains("a", F.col("token")))
        _, df, size = stats(spark, sf)  # the tokens of q are the questions'
        n, _ = size.get("fixed", (0, 0))
        dfs = spark.createDataFrame([(k, x) for (c, k), x in df.items() if c == "fixed"], "token string, df long")
        idf = dfs.select("token", R.idf(F.col("df"), F.lit(n)).alias("idf"))
        w = F.coalesce("idf", F.ln(1 + (F.lit(n) + 0.5) / 0.5))
        return t.join(idf, "token", "left").groupBy("qid", "item_id").agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("shared"), w)), F.sum(w)), F.lit(0.0)).alias("overlap"))

    return kept("overlaps", spark, sf, make)


CATEGORY = "CASE item_id % 4 WHEN 0 THEN 'terminology' WHEN 1 THEN 'paraphrasing' WHEN 2 THEN 'mixed' ELSE 'hard' END"


@query("idf_overlap", f"WITH {OVERLAP_SQL} SELECT qid, round(overlap, 6) AS overlap FROM overlap_of")
def idf_overlap(spark, sf):
    return overlaps(spark, sf).select("qid", F.round("overlap", 6).alias("overlap"))


@query("overlap_by_category", f"WITH {OVERLAP_SQL} SELECT {CATEGORY} AS category, round(avg(overlap), 6) AS mean, round(median(overlap), 6) AS median, count(*) AS n FROM overlap_of GROUP BY 1")
def overlap_by_category(spark, sf):
    return overlaps(spark, sf).groupBy(F.expr(CATEGORY).alias("category")).agg(F.round(F.avg("overlap"), 6).alias("mean"), F.round(F.median("overlap"), 6).alias("median"), F.count("*").alias("n"))


POINTS_SQL = OVERLAP_SQL.removeprefix(CHUNKS_SQL + ", ") + ", v AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY qid) - 1)::INT AS i, overlap AS x, y FROM (SELECT qid, avg(rr) FILTER (mode = 'sparse') - avg(rr) FILTER (mode = 'dense') AS y FROM rr GROUP BY qid) JOIN overlap_of USING (qid))"


def points(spark, sf):
    y = firsts(spark, sf).groupBy("qid").agg((F.avg(F.when(F.col("mode") == "sparse", F.col("rr"))) - F.avg(F.when(F.col("mode") == "dense", F.col("rr")))).alias("y"))
    return y.join(overlaps(spark, sf), "qid").select((F.row_number().over(Window.orderBy("qid")) - 1).alias("i"), F.col("overlap").alias("x"), "y")


@query("ols_regression", with_metrics("").rstrip() + f", {POINTS_SQL} SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM v")
def ols_regression(spark, sf):
    return points(spark, sf).agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


@query("bootstrap_slope", with_metrics("").rstrip() + f", {POINTS_SQL}, {DRAWN_SQL} SELECT {CI_SQL} FROM (SELECT r, regr_slope(y, x) AS m FROM drawn JOIN v USING (i) GROUP BY r)")
def bootstrap_slope(spark, sf):
    return E.interval(E.bootstrap(points(spark, sf), [F.regr_slope("y", "x").alias("m")], N_RESAMPLES, SEED), "m")


@query("idf_regression", with_metrics("").rstrip() + f", {POINTS_SQL} SELECT i, round(x, 6) AS overlap, round(y, 6) AS difference FROM v")
def idf_regression(spark, sf):
    return points(spark, sf).select("i", F.round("x", 6).alias("overlap"), F.round("y", 6).alias("difference"))


# ---- pooling and judging ----
WITHIN_SQL = f"""{HITS_SQL}, {GOLD_SQL}, allowed AS (SELECT DISTINCT qid, paper_id FROM gold),
inside AS (SELECT 'sparse' AS branch, s.* FROM sparse s JOIN chunks c USING (chunk_id) JOIN allowed a ON a.qid = s.qid AND a.paper_id = c.paper_id UNION ALL SELECT 'dense', s.* FROM dense s JOIN chunks c USING (chunk_id) JOIN allowed a ON a.qid = s.qid AND a.paper_id = c.paper_id),
ranked_in AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY branch, chunker, qid ORDER BY score DESC, chunk_id) AS rank FROM inside QUALIFY rank <= 100),
top_in AS (SELECT branch AS mode, chunker, qid, chunk_id FROM ranked_in WHERE rank <= 10 UNION ALL SELECT 'hybrid_rrf', chunker, qid, chunk_id FROM ({TOP_SQL.format(RRF_SQL.replace('ranked', 'ranked_in'))}) UNION ALL SELECT 'hybrid_dbsf', chunker, qid, chunk_id FROM ({TOP_SQL.format(DBSF_SQL.replace('ranked', 'ranked_in'))})),
searched AS (SELECT qid, paper_id, char_start, char_end, chunker, mode FROM hits WHERE qid NOT IN (SELECT qid FROM allowed) UNION ALL SELECT t.qid, c.paper_id, c.char_start, c.char_end, t.chunker, t.mode FROM top_in t JOIN chunks c USING (chunk_id))"""
RAW_SQL = f"{WITHIN_SQL}, raw AS MATERIALIZED (SELECT qid, paper_id, char_start, char_end, [chunker || '/' || mode] AS configs, 'search' AS seed FROM searched UNION ALL SELECT *, []::VARCHAR[], 'manual' FROM gold)"
POOL_SQL = f"{RAW_SQL}, pool AS MATERIALIZED (SELECT qid, paper_id, char_start, char_end, list_sort(flatten(list(DISTINCT configs))) AS configs, bool_or(seed = 'manual') AS manual FROM raw GROUP BY ALL)"
NEGATIVE = "(char_start % 3 = 0 OR CAST(substr(qid, 2) AS INT) % 4 = 1)"


def pooled_hits(spark, sf):
    """Answerable questions search their own papers only; the others search everything."""

    def make():
        allowed = spans_of(spark, sf).select("qid", "paper_id").distinct()
        within = kept("within", spark, sf, lambda: branches_within(spark, sf, allowed))
        inside = modes_of(within).join(within.select("chunk_id", "paper_id", "char_start", "char_end").distinct(), "chunk_id")
        cols = ["qid", "paper_id", "char_start", "char_end", "chunker", "mode"]
        return hits(spark, sf).join(allowed.select("qid").distinct(), "qid", "left_anti").select(*cols).unionByName(inside.select(*cols))

    return kept("pooled", spark, sf, make)


def raw(spark, sf):
    h = pooled_hits(spark, sf).select("qid", "paper_id", "char_start", "char_end", F.array(F.concat_ws("/", "chunker", "mode")).alias("configs"), F.lit("search").alias("seed"))
    return h.unionByName(spans_of(spark, sf).select("*", F.array().cast("array<string>").alias("configs"), F.lit("manual").alias("seed")))


def pool(spark, sf):
    return E.exact_dedup(raw(spark, sf))


@query("pool_raw", f"WITH {RAW_SQL} SELECT qid, paper_id, char_start, char_end, configs, seed FROM raw")
def pool_raw(spark, sf):
    return raw(spark, sf)


@query("pool_exact_dedup", f"WITH {POOL_SQL} SELECT qid, paper_id, char_start, char_end, configs, manual, concat_ws('::', qid, paper_id, char_start, char_end) AS item_id FROM pool")
def pool_exact_dedup(spark, sf):
    return pool(spark, sf).withColumn("item_id", F.concat_ws("::", "qid", "paper_id", "char_start", "char_end"))


@query("pool_overlap_dedup")
def pool_overlap_dedup(spark, sf):
    return E.overlap_dedup(pool(spark, sf))


@query("pool_stats", f"WITH {POOL_SQL}, n AS (SELECT qid, count(*) AS n FROM pool GROUP BY qid) SELECT (SELECT count(*) FROM raw) AS raw, (SELECT count(*) FROM pool) AS pooled, (SELECT count(*) FROM raw) - (SELECT count(*) FROM pool) AS exact_removed, min(n) AS least, round(median(n::DOUBLE), 6) AS median, max(n) AS most, round(100 - 100.0::DOUBLE * (SELECT count(*) FROM pool) / (SELECT count(*) FROM raw), 6) AS removed_percent FROM n")
def pool_stats(spark, sf):
    n = pool(spark, sf).groupBy("qid").agg(F.count("*").alias("n")).agg(F.sum("n").alias("pooled"), F.min("n").alias("least"), F.round(F.median("n"), 6).alias("median"), F.max("n").alias("most"))
    both = n.join(raw(spark, sf).agg(F.count("*").alias("raw")))
    return both.select("raw", "pooled", (F.col("raw") - F.col("pooled")).alias("exact_removed"), "least", "median", "most", F.round(100 - 100.0 * F.col("pooled") / F.col("raw"), 6).alias("removed_percent"))


STATUS_SQL = f"CASE WHEN (qid, paper_id, char_start, char_end) IN (SELECT (qid, paper_id, char_start, char_end) FROM gold) THEN true WHEN {NEGATIVE} THEN false END"
KEY = ["qid", "paper_id", "char_start", "char_end"]


def negatives(spark, sf):
    return pool(spark, sf).where(F.expr(NEGATIVE)).select(*KEY).distinct()


def judged(spark, sf):
    g = spans_of(spark, sf).select(*KEY).distinct().withColumn("good", F.lit(True))
    b = negatives(spark, sf).withColumn("bad", F.lit(True))
    return pool(spark, sf).join(g, KEY, "left").join(b, KEY, "left").select(*KEY, F.when(F.col("good"), True).when(F.col("bad"), False).alias("judged"))


@query("is_judged", f"WITH {POOL_SQL} SELECT qid, paper_id, char_start, char_end, {STATUS_SQL} AS judged FROM pool")
def is_judged(spark, sf):
    return judged(spark, sf)


@query("judge_worklist", f"WITH {POOL_SQL}, j AS (SELECT *, {STATUS_SQL} AS judged, concat_ws('::', qid, paper_id, char_start, char_end) AS item_id FROM pool) SELECT qid, item_id, (row_number() OVER (PARTITION BY qid ORDER BY sha256(qid || item_id)))::INT AS place FROM j WHERE judged IS NULL")
def judge_worklist(spark, sf):
    j = judged(spark, sf).where("judged IS NULL").select("qid", F.concat_ws("::", *KEY).alias("item_id"))
    return j.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.sha2(F.concat("qid", "item_id"), 256))))


@query("judgment_counts", f"WITH {POOL_SQL}, j AS (SELECT {STATUS_SQL} AS judged FROM pool) SELECT count(*) FILTER (judged) AS relevant, count(*) FILTER (NOT judged) AS negative, count(*) FILTER (judged IS NULL) AS pending FROM j")
def judgment_counts(spark, sf):
    return judged(spark, sf).agg(F.count_if("judged").alias("relevant"), F.count_if(F.expr("NOT judged")).alias("negative"), F.count_if(F.expr("judged IS NULL")).alias("pending"))


PRIOR = "CASE item_id % 3 WHEN 0 THEN true WHEN 1 THEN false END"
QUESTION = "concat(CASE WHEN item_id % 7 = 6 THEN 'n' ELSE 'q' END, item_id)"


@query("reconcile", f"""WITH {POOL_SQL}, x AS (SELECT {QUESTION} AS qid, {PRIOR} AS has_answer, (SELECT count(*) FROM gold g WHERE g.qid = {QUESTION}) AS n_gold, (SELECT count(*) FROM pool p WHERE p.qid = {QUESTION} AND NOT {NEGATIVE.replace('qid', 'p.qid')}) AS unjudged FROM benchmark),
o AS (SELECT *, CASE WHEN n_gold > 0 AND has_answer IS DISTINCT FROM true THEN 'corrected_to_true' WHEN n_gold > 0 THEN 'confirmed_true' WHEN qid NOT LIKE 'q%' THEN 'confirmed_false' WHEN unjudged > 0 THEN 'incomplete' WHEN has_answer IS DISTINCT FROM false THEN 'flipped_to_false' ELSE 'confirmed_false' END AS outcome FROM x)
SELECT qid, CASE outcome WHEN 'corrected_to_true' THEN true WHEN 'flipped_to_false' THEN false ELSE has_answer END AS has_answer, outcome, unjudged FROM o""")
def reconcile(spark, sf):
    n = spans_of(spark, sf).groupBy("qid").agg(F.count("*").alias("n_gold"))
    q = table(spark, sf, "benchmark").select(F.expr(QUESTION).alias("qid"), F.expr(PRIOR).alias("has_answer")).join(n, "qid", "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))
    return E.reconcile(q, pool(spark, sf), negatives(spark, sf))


@query("init_has_answer", f"SELECT {QUESTION} AS qid, CASE substr({QUESTION}, 1, 1) WHEN 'q' THEN true WHEN 'n' THEN false END AS has_answer FROM benchmark")
def init_has_answer(spark, sf):
    q = F.expr(QUESTION)
    return table(spark, sf, "benchmark").select(q.alias("qid"), F.when(F.startswith(q, F.lit("q")), True).when(F.startswith(q, F.lit("n")), False).alias("has_answer"))


@query("answerable_split", f"SELECT CASE WHEN a IS NULL THEN 'open' WHEN a THEN 'answerable' ELSE 'unanswerable' END AS split, count(*) AS n FROM (SELECT {PRIOR} AS a FROM benchmark) GROUP BY 1")
def answerable_split(spark, sf):
    a = F.expr(PRIOR)
    return table(spark, sf, "benchmark").groupBy(F.when(a.eqNullSafe(True), "answerable").when(a.eqNullSafe(False), "unanswerable").otherwise("open").alias("split")).agg(F.count("*").alias("n"))


@query("judgment_records", f"WITH {GOLD_SQL} SELECT qid, list_sort(list(struct_pack(paper_id := paper_id, char_start := char_start, char_end := char_end, source := 'pooled'))) AS gold_spans FROM gold GROUP BY qid")
def judgment_records(spark, sf):
    record = F.struct("paper_id", "char_start", "char_end", F.lit("pooled").alias("source"))
    return spans_of(spark, sf).groupBy("qid").agg(F.sort_array(F.collect_list(record)).alias("gold_spans"))


SPAN_LIST = "array(concat('manual:', doc_id % 5), concat('pooled:', doc_id % 5), concat('pooled:', doc_id % 3), concat('pooled:', doc_id % 5))"
GONE = "concat('pooled:', doc_id % 5)"


@query("undo_span", "SELECT doc_id, CASE list_position(s, t) WHEN 2 THEN [s[1], s[3], s[4]] WHEN 3 THEN [s[1], s[2], s[4]] ELSE s END AS spans FROM (SELECT doc_id, ['manual:' || doc_id % 5, 'pooled:' || doc_id % 5, 'pooled:' || doc_id % 3, 'pooled:' || doc_id % 5] AS s, 'pooled:' || doc_id % 5 AS t FROM documents)")
def undo_span(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(SPAN_LIST).alias("s"), F.expr(GONE).alias("t"))
    return d.select("doc_id", F.filter("s", lambda x, i: i + 1 != F.array_position("s", F.col("t"))).alias("spans"))


@query("judgment_replay", "SELECT user_id, item, arg_max(verdict, event_id) AS verdict FROM (SELECT user_id, event_id % 20 AS item, event_id, CASE event_id % 4 WHEN 0 THEN 'undo' WHEN 1 THEN 'relevant' ELSE 'negative' END AS verdict FROM events) GROUP BY ALL HAVING arg_max(verdict, event_id) <> 'undo'")
def judgment_replay(spark, sf):
    log = table(spark, sf, "events").select("user_id", (F.col("event_id") % 20).alias("item"), "event_id", F.expr("CASE event_id % 4 WHEN 0 THEN 'undo' WHEN 1 THEN 'relevant' ELSE 'negative' END").alias("verdict"))
    return log.groupBy("user_id", "item").agg(F.max_by("verdict", "event_id").alias("verdict")).where("verdict <> 'undo'")


ASK_DOI = "concat('https://DOI.org/10.1000/', CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'xx' END, '.', item_id)"


@query("backfill", f"""WITH i AS (SELECT doi, max(doc_id) AS paper_id FROM (SELECT doc_id, {DOI_SQL} AS doi FROM documents) GROUP BY doi),
q AS (SELECT item_id, regexp_replace(lower({ASK_DOI}), '^https?://doi\\.org/', '') AS doi, CASE WHEN item_id % 5 = 0 THEN 7::BIGINT END AS old FROM benchmark)
SELECT item_id, coalesce(old, paper_id) AS paper_id, CASE WHEN paper_id IS NULL THEN 'unresolved' WHEN old IS NOT NULL AND old <> paper_id THEN 'conflict' ELSE 'resolved' END AS outcome FROM q LEFT JOIN i USING (doi)""")
def backfill(spark, sf):
    from ..sources.tables import doi_index

    index = doi_index(table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.expr(DOI).alias("doi"))).select("doi", "paper_id")
    q = table(spark, sf, "benchmark").select("item_id", normalize_doi(F.expr(ASK_DOI)).alias("doi"), F.expr("CASE WHEN item_id % 5 = 0 THEN 7L END").alias("old"))
    outcome = F.when(F.col("paper_id").isNull(), "unresolved").when(F.col("old") != F.col("paper_id"), "conflict").otherwise("resolved")
    return q.join(index, "doi", "left").select("item_id", F.coalesce("old", "paper_id").alias("paper_id"), outcome.alias("outcome"))


@query("verify_eval_set", f"""WITH {GOLD_SQL}, g AS (SELECT *, char_start + CASE WHEN char_start % 4 = 0 THEN 1 ELSE 0 END AS s, CASE WHEN paper_id % 6 = 0 THEN -1 ELSE paper_id END AS p, paper_id + CASE WHEN paper_id % 7 = 0 THEN 1 ELSE 0 END AS named FROM gold),
x AS (SELECT g.*, d.doc_id, substr(d.text, (s + 1)::BIGINT, char_end - char_start) AS found, b.text FROM g LEFT JOIN documents d ON d.doc_id = g.p JOIN benchmark b ON 'q' || b.item_id = g.qid),
asked AS (SELECT CASE WHEN item_id % 9 = 0 THEN 'q1' ELSE 'q' || item_id END AS qid FROM benchmark),
found AS (SELECT qid, 'duplicate qid' AS problem FROM (SELECT qid, row_number() OVER (PARTITION BY qid) AS r FROM asked) WHERE r > 1
 UNION ALL SELECT qid, unnest(CASE WHEN doc_id IS NULL THEN ['unknown paper'] ELSE list_filter([CASE WHEN found <> text THEN 'slice differs' END, CASE WHEN named <> p THEN 'paper differs' END], lambda y: y IS NOT NULL) END) FROM x)
SELECT qid, problem, count(*) AS n FROM found GROUP BY ALL""")
def verify_eval_set(spark, sf):
    """Breaches made on purpose: shifted spans, papers that are unknown or another than the one named, questions under one id."""
    g = spans_of(spark, sf).select("qid", F.expr("char_start + CASE WHEN char_start % 4 = 0 THEN 1 ELSE 0 END").alias("char_start"), (F.col("char_end") - F.col("char_start")).alias("size"), F.expr("CASE WHEN paper_id % 6 = 0 THEN -1 ELSE paper_id END").alias("paper_id"), F.expr("paper_id + CASE WHEN paper_id % 7 = 0 THEN 1 ELSE 0 END").alias("named"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    b = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qid"), F.col("text").alias("needle"))
    asked = b.select(F.when(F.col("item_id") % 9 == 0, "q1").otherwise(F.col("qid")).alias("qid"))
    return E.eval_set_problems(asked, g.join(b.drop("item_id"), "qid"), d).groupBy("qid", "problem").agg(F.count("*").alias("n"))


# ---- grounded answers ----
BLOCK_SQL = "'[' || rank || '] ' || CASE WHEN paper_id % 4 = 0 THEN 'Untitled' ELSE 'T' || paper_id END || ' (' || CASE WHEN paper_id % 3 = 0 THEN 'n.d.' ELSE (1990 + paper_id % 30)::VARCHAR END || ') -- n/a' || chr(10) || text"
TITLE, PAPER_YEAR = "CASE WHEN paper_id % 4 > 0 THEN concat('T', paper_id) WHEN paper_id % 8 = 0 THEN '' END", "CASE WHEN paper_id % 3 > 0 THEN 1990 + paper_id % 30 END"


def top_hits(spark, sf):
    return hits(spark, sf).where("chunker = 'section_aware' AND mode = 'hybrid_dbsf' AND rank <= 5")


@query("context_block", f"WITH {HITS_SQL} SELECT qid, string_agg({BLOCK_SQL}, chr(10) || chr(10) ORDER BY rank) AS context FROM hits WHERE chunker = 'section_aware' AND mode = 'hybrid_dbsf' AND rank <= 5 GROUP BY qid")
def context_block(spark, sf):
    from ..functions.answers import context_block as block

    h = top_hits(spark, sf).select("qid", "rank", F.expr(TITLE).alias("title"), F.expr(PAPER_YEAR).alias("year"), F.lit(None).cast("string").alias("section_heading"), F.lit("").alias("parent_heading"), "text")
    return block(h)


@query("resolved_citations", f"WITH {HITS_SQL}, c AS (SELECT 'q' || item_id AS qid, unnest([3, 1, 9, 3]) AS cite FROM benchmark) SELECT DISTINCT c.qid, cite::INT AS cite, chunk_id, chunk_id IS NOT NULL AS valid FROM c LEFT JOIN hits h ON h.qid = c.qid AND h.rank = cite AND chunker = 'section_aware' AND mode = 'hybrid_dbsf' AND rank <= 5")
def resolved_citations(spark, sf):
    q = table(spark, sf, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qid"), F.explode(X.cited(F.lit("[3] then [1] [9] [3]"))).alias("cite"))
    h = top_hits(spark, sf).select("qid", F.col("rank").alias("cite"), "chunk_id")
    return q.join(h, ["qid", "cite"], "left").withColumn("valid", F.col("chunk_id").isNotNull())


@query("grounded_answer", f"""WITH {HITS_SQL} SELECT q.qid, CASE WHEN h.chunk_id IS NULL THEN '' ELSE split_part(h.text, '.', 1) || '. [1]' END AS answer, h.chunk_id IS NULL AS abstained, CASE WHEN h.chunk_id IS NULL THEN [] ELSE [1] END AS citations
FROM (SELECT 'q' || item_id AS qid FROM benchmark) q LEFT JOIN hits h ON h.qid = q.qid AND chunker = 'section_aware' AND mode = 'hybrid_dbsf' AND rank = 1""")
def grounded_answer(spark, sf):
    from ..functions.answers import extractive_answer

    q = table(spark, sf, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qid"))
    return extractive_answer(q, top_hits(spark, sf))
