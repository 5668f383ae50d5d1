"""Ranked retrieval: BM25, exact cosine, reciprocal-rank and distribution-based fusion, deterministic to the last place.

Scores are rounded to PLACES places before they are ranked and ties are broken by chunk id inside every
top-k, so that neither partitioning nor the order of sums can change a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

try:  # several times faster for short words
    from _md5 import md5
except ImportError:
    from hashlib import md5

PLACES, DIMS, MODES = 6, 16, ("dense", "sparse", "hybrid_rrf", "hybrid_dbsf")
QUERY_BLOCK, SPARSE_BLOCK, MOST_TOKENS, CHUNKS, ADDED = 4096, 256, 1 << 18, 2048, 1 << 21  # MOST_TOKENS: of questions, that are broadcast; ADDED: products summed at once


def build_filter(ranges: dict, keywords: dict) -> Column:
    """The conjunction of inclusive ranges (low, high) and equalities; None leaves a side or a key open; nulls never match."""
    out = F.lit(True)
    for name, (low, high) in ranges.items():
        if low is not None:
            out = out & (F.col(name) >= low)
        if high is not None:
            out = out & (F.col(name) <= high)
    for name, value in keywords.items():
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")


def analyze(chunks: DataFrame, analyser=None, embedder=None) -> DataFrame:
    """chunker, chunk_id, size (tokens), terms (token and tf), vec: a chunk's row holds all that its postings and its
    vector need, so neither takes a shuffle. chunks: chunker, chunk_id, text.

    Tokens are lower-case runs of letters and digits and vectors hashed counts, worked out a batch at a time, unless an
    analyser (text to tokens) or an embedder (embed_documents) is given.
    """

    return chunks.select("chunker", "chunk_id", "text").mapInArrow(lambda batches: analyzed_batches(batches, analyser, embedder), "chunker string, chunk_id string, size int, terms array<struct<token:string,tf:long>>, vec array<double>")


WORD_CODES = np.full(0x110000, -1, np.int8)  # by code point: letter or digit (1), neither (0), not yet asked for


def token_runs(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(the runs of letters and digits of all texts, offsets of each text's): bytes are classed by table, other code points once by Arrow's own classes."""
    offs = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    black = ASCII_WORD[data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        lead = data[at].astype(np.int32)
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | (data[at[more] + k] & 0x3F)
        if len(new := np.unique(code[WORD_CODES[code] < 0])):
            WORD_CODES[new] = np.asarray(pc.match_substring_regex(pa.array([chr(c) for c in new.tolist()]), r"[\p{L}\p{N}]"))
        word = WORD_CODES[code] > 0
        at, size = at[word], size[word]
        for k in range(4):
            black[at[size > k] + k] = True
    first = np.zeros(len(data) + 1, bool)  # where a text begins, and after the last
    first[offs - offs[0]] = True
    before, after = np.r_[False, black[:-1]], np.r_[black[1:], False]
    starts, ends = np.flatnonzero(black & (~before | first[:-1])), np.flatnonzero(black & (~after | first[1:])) + 1
    places = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=places[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[black])), np.searchsorted(starts, offs - offs[0])


ASCII_WORD = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def analyzed_batches(batches: Iterator[pa.RecordBatch], analyser=None, embedder=None, vectors: bool = True) -> Iterator[pa.RecordBatch]:
    """As analyze, of batches of chunker, chunk_id and text, CHUNKS rows at a time; vec is empty without vectors."""
    for b in (x.slice(s, CHUNKS) for x in batches for s in range(0, x.num_rows, CHUNKS)):
        texts = b.column(2).fill_null("")
        if analyser is None:
            flat, offs = token_runs(pc.utf8_lower(texts))
        else:
            lists = [analyser(t) for t in texts.to_pylist()]
            flat, offs = pa.array([t for x in lists for t in x], pa.string()), np.r_[0, np.cumsum([len(x) for x in lists])]
        row = np.repeat(np.arange(b.num_rows), np.diff(offs))
        coded = flat.dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        pairs, tf = np.unique(row * max(1, len(words)) + code, return_counts=True)
        own, code = pairs // max(1, len(words)), pairs % max(1, len(words))
        ends = np.searchsorted(own, np.arange(b.num_rows + 1))
        size = np.bincount(own, tf, b.num_rows).astype(np.int32)
        if not vectors:
            vecs, wide = np.zeros(0), 0
        elif embedder is None:
            at = np.int64([md5(w).digest()[0] % DIMS for w in words.cast(pa.binary()).to_numpy(zero_copy_only=False)])
            vecs = np.bincount(own * DIMS + at[code], tf, b.num_rows * DIMS)
            wide = DIMS
        else:
            vecs, wide = np.asarray(embedder.embed_documents(texts.to_pylist()), float).ravel(), embedder.dims
        terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words.take(pa.array(code)), pa.array(tf, pa.int64())], names=["token", "tf"]))
        vec = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * wide, pa.int32()), pa.array(vecs, pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int32()), terms, vec], names=["chunker", "chunk_id", "size", "terms", "vec"])


def postings(analyzed: DataFrame) -> DataFrame:
    """chunker, chunk_id, size, token, tf."""
    return analyzed.select("chunker", "chunk_id", "size", F.inline("terms"))


def idf(df: Column, n: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def idf_table(df: DataFrame, n: dict[str, int]) -> DataFrame:
    """chunker, token, df, idf over the whole collection: filters never change it. df: token_counts; n: chunks by chunker."""
    every = F.create_map(*[x for c, k in n.items() for x in (F.lit(c), F.lit(k))]) if n else F.create_map(F.lit(""), F.lit(0))
    return df.select("chunker", "token", "df", idf(F.col("df"), every[F.col("chunker")]).alias("idf"))


def count_batches(analyzed: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunker, token, df of the chunks of a task (token null: all of them), summed over MOST_TOKENS rows at a time: a token has some rows."""
    names = ["chunker", "token", "df"]

    def given(parts):
        every = pa.concat_tables(parts).group_by(names[:2]).aggregate([("df", "sum")])
        return every.select(["chunker", "token", "df_sum"]).rename_columns(names).to_batches()

    parts, n = [], 0
    for b in analyzed:
        terms = b.column(3)
        coded = terms.flatten().field("token").dictionary_encode()
        row = np.repeat(np.arange(b.num_rows), np.diff(terms.offsets.to_numpy()))
        for chunker, own in _groups(b.column(0)):
            counts = np.bincount(coded.indices.to_numpy()[np.isin(row, own)] if len(own) < b.num_rows else coded.indices.to_numpy(), minlength=len(coded.dictionary))
            at = np.flatnonzero(counts)
            words = pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary.take(pa.array(at))])
            parts.append(pa.table([pa.array([chunker] * len(words), pa.string()), words, pa.array(np.r_[len(own), counts[at]], pa.int64())], names=names))
            n += len(words)
        if n > MOST_TOKENS:
            yield from given(parts)
            parts, n = [], 0
    if parts:
        yield from given(parts)


class Asked(NamedTuple):
    """A question with its distinct tokens and, of rows under one id at most once, its vector."""

    qid: str
    ts: list[str]
    vec: list[float] | None


class Bm25:
    """BM25 of chunks for a block of questions (qid, ts), from the df of (chunker, token) and (chunks, mean size) by chunker over the whole collection."""

    def __init__(self, block: list, df: dict, size: dict, k1: float = 1.2, b: float = 0.75):
        self.vocab = sorted({t for r in block for t in r.ts or ()})
        column = {t: i for i, t in enumerate(self.vocab)}
        asked = np.array(sorted((column[t], j) for j, r in enumerate(block) for t in set(r.ts or ())), np.int64).reshape(-1, 2)
        self.first, self.asks = np.searchsorted(asked[:, 0], np.arange(len(self.vocab) + 1)), asked[:, 1]  # the questions of each token
        self.weight = {c: np.log(1 + (n - (d := np.array([df.get((c, t), 0) for t in self.vocab], float)) + 0.5) / (d + 0.5)) for c, (n, _) in size.items()}
        self.mean, self.k1, self.b, self.n = {c: m for c, (_, m) in size.items()}, k1, b, len(block)

    def scores(self, chunker: str, size: np.ndarray, row: np.ndarray, col: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """A row a chunk, a column a question, -inf where no token is shared. row, col, tf: the chunks' tokens (ascending rows), as places in vocab."""
        out = np.full((len(size), self.n), -np.inf)
        if not len(row):
            return out
        mean = self.mean[chunker]
        long = self.k1 * (1 - self.b + self.b * size / (mean if mean and mean > 0 else 1))
        w = self.weight[chunker][col] * tf * (self.k1 + 1) / (tf + long[row])
        times = self.first[col + 1] - self.first[col]
        ends = np.searchsorted(row, np.arange(len(size) + 1))
        before = np.r_[0, np.cumsum(times)][ends]  # products before each chunk
        at = 0
        while at < len(size):  # ADDED products or one chunk
            to = max(at + 1, int(np.searchsorted(before, before[at] + ADDED, "right")) - 1)
            s = slice(ends[at], ends[to])
            n = times[s]
            which = np.arange(n.sum()) + np.repeat(self.first[col[s]] - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n)
            total = np.bincount(np.repeat(row[s] - at, n) * self.n + self.asks[which], np.repeat(w[s], n), (to - at) * self.n).reshape(-1, self.n)
            out[at:to] = np.where(total > 0, np.round(total, PLACES), -np.inf)
            at = to
        return out


class Cosine:
    """Cosines of vectors with a block of questions (qid, vec)."""

    def __init__(self, vecs, places: int = PLACES):
        q = np.float64(vecs).reshape(len(vecs), -1) if len(vecs) else np.zeros((0, 0))
        self.q, self.places = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)).T, places

    def scores(self, x: np.ndarray) -> np.ndarray:
        """A row a vector, a column a question, -inf for zero vectors."""
        if not self.q.size:
            return np.zeros((len(x), 0))
        norm = np.linalg.norm(x, axis=1)
        with np.errstate(invalid="ignore"):
            return np.where((norm > 0)[:, None], np.round((x / np.maximum(norm, 1e-300)[:, None]) @ self.q, self.places), -np.inf)


class Best:
    """The k best of each question by score, then by id, while parts of a task's rows pass: a task sends k rows a question at most, however many rows and ties it has."""

    def __init__(self, questions: int, k: int):
        self.k, self.least, self.table = k, np.full(questions, -np.inf), None
        self.parts: list[pa.Table] = []
        self.most, self.n = 4 * questions * k + (1 << 14), 0

    def add(self, score: np.ndarray, keys: list[pa.Array]) -> None:
        """score: a row a key, a column a question, -inf for none."""
        keep = (score >= self.least) & (score > -np.inf)
        if keep.sum() > self.k * score.shape[1] and len(score) > self.k:
            keep &= score >= np.partition(score, len(score) - self.k, axis=0)[len(score) - self.k]
        i, q = np.nonzero(keep)
        if len(i):
            self.parts.append(pa.table([pa.array(q), pa.array(score[i, q]), *(c.take(pa.array(i)) for c in keys)], names=["q", "score", *(f"k{n}" for n in range(len(keys)))]))
            self.n += len(i)
            if self.n > self.most:
                self.prune()

    def prune(self) -> pa.Table | None:
        if not self.parts:
            return None
        every = pa.concat_tables(self.parts).combine_chunks()
        every = every.take(pc.sort_indices(every, sort_keys=[("q", "ascending"), ("score", "descending"), (every.column_names[-1], "ascending")]))
        q = every["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        full = rank == self.k - 1
        self.least[q[full]] = every["score"].to_numpy()[full]
        every = every.filter(pa.array(rank < self.k)).combine_chunks()
        self.parts, self.n = [every], len(every)
        return every

    def rows(self, qids: list, kind: pa.DataType) -> tuple[list[pa.Array], pa.Array, pa.Array] | None:
        """(keys, qid, score), whole arrays."""
        every = self.prune()
        if every is None:
            return None
        one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        cols = [one(c) for c in every.columns]
        return cols[2:], pa.array(qids, kind).take(cols[0]), cols[1]


def _groups(column: pa.Array) -> list[tuple[object, np.ndarray]]:
    """The rows of each value."""
    coded = column.dictionary_encode(null_encoding="encode")
    which = coded.indices.to_numpy()
    return [(v, np.flatnonzero(which == k)) for k, v in enumerate(coded.dictionary.to_pylist())]


def term_places(terms: pa.Array, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in vocab and tf of the terms that vocab has."""
    flat = terms.flatten()
    col = pc.index_in(flat.field("token"), vocab).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
    return row[hit := col >= 0], col[hit], flat.field("tf").to_numpy()[hit]


# ---- an index of chunks for a stated set of questions: whole batches as compressed blobs ----
INDEX = "chunker string, n long, size long, blob binary"
CODEC = pa.ipc.IpcWriteOptions(compression="zstd")


def index_batches(analyzed: Iterator[pa.RecordBatch], vocab: list[str]) -> Iterator[pa.RecordBatch]:
    """INDEX: of each batch and chunker the chunks' ids, sizes and vectors and their terms as places in vocab; other terms only count in the sizes."""
    known = pa.array(vocab, pa.string())
    for b in analyzed:
        row, col, tf = term_places(b.column(3), known)
        for chunker, own in _groups(b.column(0)):
            part = b.take(pa.array(own))
            mine = np.isin(row, own)
            ends = np.searchsorted(np.searchsorted(own, row[mine]), np.arange(len(own) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[mine], pa.int32())) for x in (col, tf)]
            blob = pa.RecordBatch.from_arrays([part.column(1), part.column(2), *lists, part.column(4)], names=["chunk_id", "size", "col", "tf", "vec"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, blob.schema, options=CODEC) as out:
                out.write_batch(blob)
            yield pa.RecordBatch.from_arrays([pa.array([chunker], pa.string()), pa.array([len(own)]), pa.array([int(np.sum(part.column(2).to_numpy(), dtype=np.int64))]), pa.array([sink.getvalue().to_pybytes()])], names=["chunker", "n", "size", "blob"])


def index_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """(chunker, its chunks) of every row of an index (chunker, blob)."""
    for b in batches:
        for chunker, blob in zip(b.column(0).to_pylist(), b.column(1)):
            yield from ((chunker, x) for x in pa.ipc.open_stream(blob.as_buffer()))


def index_stats(index: DataFrame, vocab: list[str]) -> tuple[dict, dict]:
    """(df by chunker and token of vocab, (chunks, mean size) by chunker)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[str, np.ndarray] = {}
        for chunker, b in index_blobs(batches):
            df[chunker] = df.get(chunker, 0) + np.bincount(b["col"].flatten().to_numpy(), minlength=len(vocab))
        for c, x in df.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at], pa.int64())], names=["chunker", "at", "df"])

    counts = index.select("chunker", "blob").mapInArrow(run, "chunker string, at int, df long").groupBy("chunker", "at").agg(F.sum("df").alias("df")).collect()  # a row a token and chunker
    size = {r.chunker: (r.n, r.size / r.n) for r in index.groupBy("chunker").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect() if r.n}
    return {(r.chunker, vocab[r.at]): r.df for r in counts}, size


def index_best(index: DataFrame, vocab: list[str], questions: list, df: dict, size: dict, k: int) -> DataFrame:
    """branch, chunker, qid, chunk_id, score: of every task the k best of both branches for each question (qid, ts, vec), in one reading of the index."""
    place, out = {t: i for i, t in enumerate(vocab)}, None
    for at in range(0, max(1, len(questions)), SPARSE_BLOCK):
        part = _index_block(index, place, questions[at : at + SPARSE_BLOCK], df, size, k)
        out = part if out is None else out.unionByName(part)
    return out


def _index_block(index, place, block, df, size, k):
    bm25, near = Bm25(block, df, size), [j for j, r in enumerate(block) if any(r.vec or ())]
    own = np.full(len(place) + 1, -1)
    own[[place[t] for t in bm25.vocab]] = np.arange(len(bm25.vocab))  # a place in the index's vocab to one in the block's
    cosine, qids = Cosine([block[j].vec for j in near]), [r.qid for r in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, str], Best] = {}
        for chunker, b in index_blobs(batches):
            col, tf = own[b["col"].flatten().to_numpy()], b["tf"].flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(b["col"].offsets.to_numpy()))
            hit = col >= 0
            scored = [("sparse", qids, bm25.scores(chunker, b["size"].to_numpy(), row[hit], col[hit], tf[hit].astype(np.int64)))]
            if near:
                scored.append(("dense", [qids[j] for j in near], cosine.scores(b["vec"].flatten().to_numpy().reshape(b.num_rows, -1))))
            for branch, asked, score in scored:
                best.setdefault((branch, chunker), Best(len(asked), k)).add(score, [b["chunk_id"]])
        for (branch, chunker), x in best.items():
            if found := x.rows(qids if branch == "sparse" else [qids[j] for j in near], pa.string()):
                (ids,), asked, score = found
                yield pa.RecordBatch.from_arrays([pa.array([branch] * len(ids)), pa.array([chunker] * len(ids), pa.string()), asked, ids, score], names=["branch", "chunker", "qid", "chunk_id", "score"])

    return index.select("chunker", "blob").mapInArrow(run, "branch string, chunker string, qid string, chunk_id string, score double")


def scores_within(batches: Iterator[pa.RecordBatch], allowed: dict, blocks: list[tuple[list, Bm25, Cosine]]) -> Iterator[pa.RecordBatch]:
    """branch, chunker, qid, chunk_id, paper_id, char_start, char_end, score of the pairs of a chunk (chunker, chunk_id, text, paper_id, char_start, char_end; one chunker a batch) and a question that its paper allows.

    allowed: qids by paper_id; blocks: questions with both scores.
    """
    for part in (x.slice(s, CHUNKS) for x in batches for s in range(0, x.num_rows, CHUNKS)):
        (a,) = analyzed_batches([part.select(["chunker", "chunk_id", "text"])])
        chunker, vecs, size = part["chunker"][0].as_py(), a["vec"].flatten().to_numpy().reshape(part.num_rows, -1), a["size"].to_numpy()
        for block, bm25, cosine in blocks:
            at: dict[str, list[int]] = {}
            for j, r in enumerate(block):
                at.setdefault(r.qid, []).append(j)
            own = {p: [j for q in qids for j in at.get(q, ())] for p, qids in allowed.items()}
            pairs = np.array([(i, j) for i, p in enumerate(part["paper_id"].to_pylist()) for j in own[p]], np.int64).reshape(-1, 2)
            if not len(pairs):
                continue
            near = np.array([any(r.vec or ()) for r in block])
            dense = np.full((part.num_rows, len(block)), -np.inf)
            dense[:, near] = cosine.scores(vecs)
            for branch, score in (("sparse", bm25.scores(chunker, size, *term_places(a["terms"], pa.array(bm25.vocab, pa.string())))), ("dense", dense)):
                i, j = pairs[score[pairs[:, 0], pairs[:, 1]] > -np.inf].T
                rows = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array([branch] * len(i), pa.string()), rows["chunker"], pa.array([block[k].qid for k in j.tolist()], pa.string()), rows["chunk_id"], rows["paper_id"], rows["char_start"], rows["char_end"], pa.array(score[i, j])], names=["branch", "chunker", "qid", "chunk_id", "paper_id", "char_start", "char_end", "score"])


def score_blocks(questions: list, df: dict, size: dict) -> list[tuple[list, Bm25, Cosine]]:
    """Questions (Asked) in blocks of SPARSE_BLOCK with their scores."""
    blocks = [questions[at : at + SPARSE_BLOCK] for at in range(0, len(questions), SPARSE_BLOCK)]
    return [(b, Bm25(b, df, size), Cosine([r.vec for r in b if any(r.vec or ())])) for b in blocks]


def sparse_scores(questions: DataFrame, analyzed: DataFrame, k: int | None = None, k1: float = 1.2, b: float = 0.75, only: DataFrame | None = None) -> DataFrame:
    """chunker, qid, chunk_id, score: BM25 of chunks that share a token with a question; with k, of every task and chunker the k best for each question.

    questions: qid, ts (distinct tokens), a stated set that the tasks hold in blocks; only: the chunk_id that may be found.
    Document frequencies and mean size always cover the whole collection.
    """
    rows = questions.select("qid", "ts").collect()
    vocab = {t for r in rows for t in r.ts or ()}
    asked = analyzed.sparkSession.createDataFrame([(t,) for t in vocab], "token string")
    asked = F.broadcast(asked) if len(vocab) <= MOST_TOKENS else asked
    df = {(r.chunker, r.token): r.df for r in postings(analyzed).join(asked, "token", "left_semi").groupBy("chunker", "token").agg(F.count("*").alias("df")).collect()}
    size = {r.chunker: (r.n, r.mean) for r in analyzed.groupBy("chunker").agg(F.count("*").alias("n"), F.avg("size").alias("mean")).collect()}
    found = analyzed.select("chunker", "chunk_id", "size", "terms")
    found = found if only is None else found.join(only, "chunk_id", "left_semi").select("chunker", "chunk_id", "size", "terms")
    kind, out = questions.schema["qid"].dataType, None
    for at in range(0, max(1, len(rows)), SPARSE_BLOCK):
        block = rows[at : at + SPARSE_BLOCK]
        part = _sparse_block([r.qid for r in block], Bm25(block, df, size, k1, b), found, k, kind)
        out = part if out is None else out.unionByName(part)
    return out


def _sparse_block(qids, bm25, found, k, kind):
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best = pa.array(bm25.vocab, pa.string()), {}
        given = lambda chunker, asked, ids, score: pa.RecordBatch.from_arrays([pa.array([chunker] * len(ids), pa.string()), asked, ids, score], names=["chunker", "qid", "chunk_id", "score"])
        for part in (x.slice(s, CHUNKS) for x in batches for s in range(0, x.num_rows, CHUNKS)):
            for chunker, own in _groups(part.column(0)):
                mine = part.take(pa.array(own))
                ids, score = mine.column(1), bm25.scores(chunker, mine.column(2).to_numpy(), *term_places(mine.column(3), known))
                if k is None:
                    i, j = np.nonzero(score > -np.inf)
                    yield given(chunker, pa.array(qids, arrow).take(pa.array(j)), ids.take(pa.array(i)), pa.array(score[i, j]))
                else:
                    best.setdefault(chunker, Best(len(qids), k)).add(score, [ids])
        for chunker, x in best.items():
            if found := x.rows(qids, arrow):
                (ids,), asked, score = found
                yield given(chunker, asked, ids, score)

    return found.mapInArrow(run, f"chunker string, qid {kind.simpleString()}, chunk_id string, score double")


def hashed_vectors(posted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vec: a deterministic stand-in for an embedder; counts of tokens hashed to DIMS places."""
    place = (F.conv(F.substring(F.md5("token"), 1, 2), 16, 10).cast("int") % DIMS).alias("d")
    by = posted.select(*keys, place, "tf").groupBy(*keys).agg(*[F.sum(F.when(F.col("d") == i, F.col("tf")).otherwise(0)).cast("double").alias(f"v{i}") for i in range(DIMS)])
    return by.select(*keys, F.array(*[f"v{i}" for i in range(DIMS)]).alias("vec"))


def dense_scores(queries: DataFrame, vectors: DataFrame, keys: list[str], k: int, places: int = PLACES) -> DataFrame:
    """keys, qid, score: of every task the k best vectors for each query by cosine, of each value of the keys before the last, ties by the last; zero vectors are left out.

    The queries are a stated set, held by the tasks in blocks of QUERY_BLOCK; the vectors stay where they are.
    """
    rows = queries.select("qid", "vec").collect()
    out = None
    for at in range(0, max(1, len(rows)), QUERY_BLOCK):
        block = [r for r in rows[at : at + QUERY_BLOCK] if any(r.vec or ())]
        part = _dense_block([r.qid for r in block], Cosine([r.vec for r in block], places), vectors, keys, k, queries.schema["qid"].dataType)
        out = part if out is None else out.unionByName(part)
    return out


def _dense_block(qids, cosine, vectors, keys, k, kind):
    kinds, arrow = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in keys), to_arrow_type(kind)
    step = max(64, min(2048, (1 << 21) // max(1, len(qids))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, Best] = {}
        for part in (x.slice(s, step) for x in batches for s in range(0, x.num_rows, step)):
            x = part.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            if not len(qids) or x.shape[1] != len(cosine.q):
                continue
            score = cosine.scores(x)
            for group, own in _groups(part.column(0)) if len(keys) > 1 else [(None, None)]:
                best.setdefault(group, Best(len(qids), k)).add(score if own is None else score[own], [part.column(c) if own is None else part.column(c).take(pa.array(own)) for c in range(len(keys))])
        for b in best.values():
            if found := b.rows(qids, arrow):
                ids, asked, score = found
                yield pa.RecordBatch.from_arrays([*ids, asked, score], names=[*keys, "qid", "score"])

    return vectors.select(*keys, F.col("vec").cast("array<double>")).where("vec is not null").mapInArrow(run, f"{kinds}, qid {kind.simpleString()}, score double")


def top(scored: DataFrame, by: list[str], k: int, tie: str = "chunk_id") -> DataFrame:
    """The k best of each group with their rank, from 1."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse_rrf(branches: DataFrame, k: float = 2) -> DataFrame:
    """Sum over branches of 1 / (k + rank from 0)."""
    return branches.groupBy("chunker", "qid", "chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank") - 1)), PLACES).alias("score"))


def fuse_dbsf(branches: DataFrame) -> DataFrame:
    """Sum over branches of the score's place between mean - 3 and mean + 3 deviations; half where there is no spread."""
    w = Window.partitionBy("branch", "chunker", "qid")
    m, s = F.avg("score").over(w), F.stddev_samp("score").over(w)
    part = F.when(F.coalesce(s, F.lit(0.0)) > 0, (F.col("score") - (m - 3 * s)) / (6 * s)).otherwise(F.lit(0.5))
    return branches.withColumn("part", part).groupBy("chunker", "qid", "chunk_id").agg(F.round(F.sum("part"), PLACES).alias("score"))
