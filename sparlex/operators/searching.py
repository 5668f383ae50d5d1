"""A searcher over chunks with what it needs passed in: analyser, embedder, progress listener; it reports its timings.

Analyser: a function from a text to its tokens. Embedder: an object with ``dims``, ``embed_documents(texts)`` and
``embed_query(text)`` (numpy; a prefix belongs to queries only). Listener: called with (done, total, name).
"""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval as R

Analyser = Callable[[str], list[str]]
Listener = Callable[[int, int, str], None]
RUNS = re.compile(r"[^\W_]+")
# English words that carry no topic.
STOP_WORDS = frozenset({
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
})


def plain(text: str) -> list[str]:
    """The default analyser: lower-case runs of letters and digits."""
    return RUNS.findall(text.lower())


def singular(word: str) -> str:
    """A light stemmer: plural endings only."""
    if word.endswith("ies") and not word.endswith(("eies", "aies")):
        return word[:-3] + "y"
    if word.endswith("es") and not word.endswith(("aes", "ees", "oes")):
        return word[:-1]
    return word[:-1] if word.endswith("s") and not word.endswith(("us", "ss")) else word


def stemmed(text: str) -> list[str]:
    """Without stop words, in the singular."""
    return [singular(w) for w in plain(text) if w not in STOP_WORDS]


class Embedder(Protocol):
    dims: int

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashedEmbedder:
    """A deterministic stand-in for a model: counts of tokens in ``dims`` places; of a query's tokens, each once."""

    def __init__(self, dims: int = R.DIMS, analyser: Analyser = plain, prefix: str = ""):
        self.dims, self.analyser, self.prefix = dims, analyser, prefix

    def _vector(self, counts) -> np.ndarray:
        out = np.zeros(self.dims)
        for token, n in counts.items():
            out[int(hashlib.md5(token.encode()).hexdigest()[:2], 16) % self.dims] += n
        return out

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        return np.stack([self._vector(Counter(self.analyser(t or ""))) for t in texts]) if texts else np.zeros((0, self.dims))

    def embed_query(self, text: str) -> np.ndarray:
        return self._vector(dict.fromkeys(self.analyser(self.prefix + text), 1))


@dataclass
class Timings:
    """Seconds of each step; a step that a mode leaves out has 0."""

    embed: float = 0.0
    dense: float = 0.0
    sparse: float = 0.0
    fuse: float = 0.0
    total: float = field(default=0.0)


class Searcher:
    def __init__(self, chunks: DataFrame, analyser: Analyser = plain, embedder: Embedder | None = None, prefetch: int = 100, rrf_k: float = 2):
        """chunks: chunker, chunk_id, text, and what filters need."""
        self.analyser, self.embedder = analyser, embedder or HashedEmbedder(analyser=analyser)
        self.chunks, self.prefetch, self.rrf_k = chunks, prefetch, rrf_k
        self.index = R.analyze(chunks, self.analyser, self.embedder)

    def search(self, questions: dict[str, str], mode: str = "hybrid_dbsf", limit: int = 10, where: Column | None = None) -> tuple[DataFrame, Timings]:
        """(chunker, qid, chunk_id, score, rank; timings). An unknown mode is an error before any work; a filter stands before every top-k and changes no idf."""
        R.check_mode(mode)
        spark, t, began = self.chunks.sparkSession, Timings(), time.perf_counter()
        allowed = self.chunks.where(where).select("chunk_id") if where is not None else None
        branches = []

        def timed(name, make):
            start = time.perf_counter()
            out = make()
            setattr(t, name, time.perf_counter() - start)
            return out

        def best(scored, name):
            rows = R.top(scored, ["chunker", "qid"], self.prefetch).select("chunker", "qid", "chunk_id", "score", "rank", F.lit(name).alias("branch")).collect()  # prefetch rows a question
            branches.append(spark.createDataFrame(rows, "chunker string, qid string, chunk_id string, score double, rank int, branch string"))

        if mode != "sparse":
            vectors = timed("embed", lambda: [(q, [float(x) for x in self.embedder.embed_query(text)]) for q, text in questions.items()])
            asked = spark.createDataFrame(vectors, "qid string, vec array<double>")
            found = self.index.select("chunker", "chunk_id", "vec")
            found = found if allowed is None else found.join(allowed, "chunk_id", "left_semi").select("chunker", "chunk_id", "vec")
            timed("dense", lambda: best(R.dense_scores(asked, found, ["chunker", "chunk_id"], self.prefetch), "dense"))
        if mode != "dense":
            tokens = spark.createDataFrame([(q, list(dict.fromkeys(self.analyser(text)))) for q, text in questions.items()], "qid string, ts array<string>")
            timed("sparse", lambda: best(R.sparse_scores(tokens, self.index, self.prefetch if allowed is None else None, only=allowed), "sparse"))
        both = branches[0] if len(branches) == 1 else branches[0].unionByName(branches[1])
        if mode in ("dense", "sparse"):
            out = both.where(F.col("rank") <= limit).drop("branch")
        else:
            fused = R.fuse_rrf(both, self.rrf_k) if mode == "hybrid_rrf" else R.fuse_dbsf(both)
            out = timed("fuse", lambda: spark.createDataFrame(R.top(fused, ["chunker", "qid"], limit).select("chunker", "qid", "chunk_id", "score", "rank").collect(), "chunker string, qid string, chunk_id string, score double, rank int"))
        t.total = time.perf_counter() - began
        return out.select("chunker", "qid", "chunk_id", "score", "rank"), t

    def every(self, questions: dict[str, str], modes=R.MODES, limit: int = 10, where: Column | None = None, on_progress: Listener | None = None) -> tuple[DataFrame, dict[str, Timings]]:
        """(the results of all modes with their mode, timings by mode); the listener hears of each mode that is done."""
        out, times = None, {}
        for k, mode in enumerate(modes, 1):
            hits, times[mode] = self.search(questions, mode, limit, where)
            hits = hits.withColumn("mode", F.lit(mode))
            out = hits if out is None else out.unionByName(hits)
            if on_progress:
                on_progress(k, len(modes), mode)
        return out, times


def snippet(text: Column, size: int = 240) -> Column:
    from ..functions.text import clean_ws

    return F.substring(clean_ws(text), 1, size)


def one_shot(searcher: Searcher, text: str, mode: str = "hybrid_dbsf", limit: int = 5, where: Column | None = None) -> tuple[DataFrame, Timings]:
    """(rank, score, chunk_id, snippet of the chunks that answer one question; timings)."""
    hits, t = searcher.search({"q": text}, mode, limit, where)
    return hits.join(searcher.chunks.select("chunk_id", "text"), "chunk_id").select("chunker", "rank", "score", "chunk_id", snippet(F.col("text")).alias("snippet")).orderBy("chunker", "rank"), t
