"""Quality rules, natively: document statistics, failures shrunk by host, verdicts joined back.

Everything is a DataFrame expression. A window of five words is found again by sorting
64-bit values that hold the window's hash above its place; neighbours with equal hashes
are compared word by word, so equal windows meet in n log n steps and nothing is exploded.

Hosts: of the documents of each host, failures / documents is the raw rate. A beta prior
fitted to the hosts' rates by moments (weighted by documents) shrinks it; a host whose shrunk
rate is above ``host_limit`` loses all its documents.

Defined results: null text counts as empty (no words: it fails); a null host has no verdict of
its own; repeated rows are judged alike; a host whose shrunk rate equals the limit keeps its
documents; very long texts are judged whole; an empty table gives an empty table; other columns,
whatever their names, are carried untouched in ``doc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

WORD_BREAK, WINDOW = "[ \\t\\n\\x0B\\f\\r]+", 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _window_hash(hashes: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])


def document_rules(docs: DataFrame, text_col: str = "text", min_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """doc (the input row), the five statistics (long) and base_failed."""
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    at = docs.select(F.struct("*").alias("doc")).select(
        "doc",
        F.array_remove(F.split(text, WORD_BREAK), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    at = at.select("*", n.alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.ceil(F.log2(n + 1.0)).cast("int").alias("bits"))
    one = F.lit(1).cast("long")
    at = at.select(
        "*",
        F.when(
            F.col("n") > WINDOW,
            F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.coalesce(F.call_function("shiftleft", _window_hash(F.col("hashes"), i), F.col("bits")) + i, F.lit(0).cast("long")))),
        ).alias("sorted"),
        (F.call_function("shiftleft", one, F.col("bits")) - 1).alias("mask"),
    )

    def same(j):
        a, b = F.get("sorted", j - 1), F.get("sorted", j)
        place = lambda x: (x.bitwiseAND(F.col("mask")) + 1).cast("int")
        return (F.call_function("shiftright", a, F.col("bits")) == F.call_function("shiftright", b, F.col("bits"))) & (F.slice("words", place(a), WINDOW) == F.slice("words", place(b), WINDOW))

    at = at.select("*", F.when(F.size("sorted") > 1, F.filter(F.sequence(F.lit(1), F.size("sorted") - 1), same)).alias("met"))
    at = at.select(
        "*",
        F.when(
            F.size("met") > 0,
            F.array_sort(F.array_distinct(F.flatten(F.transform("met", lambda j: F.array(F.get("sorted", j - 1).bitwiseAND(F.col("mask")), F.get("sorted", j).bitwiseAND(F.col("mask"))))))),
        ).alias("places"),
    )
    steps = F.zip_with(F.slice("places", F.lit(2), F.size("places") - 1), F.slice("places", F.lit(1), F.size("places") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW).cast("long")))
    # One struct in one array, unpacked: the optimizer moves no filter on a statistic below a generator, so that
    # a filter never repeats the expressions above inside one another.
    at = at.select("doc", F.inline(F.array(F.struct(
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("places") > 0, F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    ))))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return at.withColumn("base_failed", failed)


def rule_failed() -> Column:
    """Any rule: the base rules, symbols over a third of the words, or over 30 % repeated lines' share of words."""
    return F.col("base_failed") | (3 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_words"))


def host_verdicts(stats: DataFrame, host: str = "host", host_limit: float = 0.5) -> DataFrame:
    """host, host_docs, host_failures, host_rate (shrunk), host_rejected. stats: host and failed (boolean)."""
    hosts = saved(stats.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("host_docs"), F.count_if("failed").alias("host_failures")), "hosts")
    rate = F.col("host_failures") / F.col("host_docs")
    m = hosts.agg((F.sum("host_failures") / F.sum("host_docs")).alias("mean"), F.count("*").alias("hosts"), F.sum("host_docs").alias("docs"), F.sum(F.col("host_docs") * rate * rate).alias("square")).first()
    mean = m.mean or 0.0
    spread = max((m.square or 0.0) / m.docs - mean * mean, 0.0) if m.docs else 0.0
    noise = mean * (1 - mean) * (m.hosts or 0) / m.docs if m.docs else 0.0  # binomial variance that equal hosts would show
    strength = max(1.0, min(1e6, mean * (1 - mean) / max(spread - noise, 1e-9) - 1))
    shrunk = (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > host_limit)


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_limit: float = 0.5, keep_doc: list[str] | None = None) -> DataFrame:
    """doc, the statistics, base_failed, host_rate and kept for every row.

    keep_doc names the columns kept in doc. Statistics are worked out once and kept in the shared folder if the
    text isn't among them; else they are worked out again in a second scan rather than storing the texts.
    """
    names = keep_doc or docs.columns
    ruled = document_rules(docs, text_col).select(F.struct(*[F.col("doc")[c].alias(c) for c in names]).alias("doc"), F.col("doc")[host_col].alias("host"), *STATS, "base_failed")
    if text_col not in names:
        ruled = saved(ruled, "rules")
    verdicts = host_verdicts(ruled.select("host", rule_failed().alias("failed")), "host", host_limit).select("host", "host_rate", "host_rejected")
    return ruled.join(verdicts, "host", "left").select("doc", *STATS, "base_failed", "host_rate", (~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))).alias("kept"))
