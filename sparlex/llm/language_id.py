"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: all character 1-, 2- and 3-grams of the lower-cased text (a space stands before it),
hashed to ``BUCKETS``; tf is a gram's share of the text's grams, idf from the document frequencies
over *all* training documents. The model is fitted by follow-the-regularised-leader (FTRL-proximal)
with elastic-net penalties on at most ``sample`` training documents in all, dealt evenly to the
languages and chosen by a hash of their ids; a fifth of them is held back to choose the
temperature that calibrates the scores. Prediction is a mean over the grams of idf * weight.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every
text if there is nothing to learn from. Repeated rows are scored alike; of equal scores the
first language in order wins; a very long text is a slice of its own and scored whole; an
empty table gives an empty table; further columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Texts, codepoints, letter_table, lower_table, slices, sums
from .common import map_arrow

BUCKETS, ORDERS, SAMPLE, SCALE = 1 << 16, 3, 8000, 30.0


def grams(t: Texts) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(bucket of the gram of each order that ends at each character, character offsets, code points)."""
    cp, offs = codepoints(t)
    low = lower_table()[cp]
    lead = offs[:-1][np.diff(offs) > 0]
    h, out, back = low.astype(np.uint32), [], low
    for k in range(ORDERS):
        x = h * np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        out.append((x >> np.uint32(16)).astype(np.uint16))
        shifted = np.empty_like(back)
        shifted[1:], shifted[:1] = back[:-1], 32
        shifted[lead] = 32
        back = shifted
        h = h + (back + np.uint32(k + 1)) * np.uint32((0x27D4EB2F, 0x165667B1, 0xC2B2AE3D)[k % 3])
    return out, offs, cp


def bags(t: Texts):
    """(distinct buckets, counts) of every text."""
    by_order, offs, _ = grams(t)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        x = np.concatenate([g[a:b] for g in by_order])
        x.sort(kind="stable")  # a radix sort at 16 bits
        new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
        yield x[new], np.diff(np.r_[new, len(x)])


class Ftrl:
    """Per-coordinate FTRL-proximal for softmax regression: z and n by bucket and class."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.full((len(z), 1), self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        new = self.n[i] + g * g
        self.z[i] += g - (np.sqrt(new) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] = new


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(docs: DataFrame, lang_col: str = "lang", sample: int = SAMPLE, epochs: int = 3):
    """(languages, table [bucket, language] of idf * weight, bias by language), temperature included. docs: doc_id, text and the language."""
    docs = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(lang_col).cast("string").alias("lang"))

    def count(batches):
        df, langs = np.zeros(BUCKETS, np.int64), {}
        for b in batches:
            for x in b.column(1).to_pylist():
                langs[x] = langs.get(x, 0) + 1
            for _, t in slices(b.column(0)):
                for i, _ in bags(t):
                    df[i] += 1
        some = np.flatnonzero(df)
        if langs:
            yield some.tolist() + [-1] * len(langs), df[some].tolist() + list(langs.values()), [None] * len(some) + list(langs)

    counts = map_arrow(docs.select("text", "lang"), count, "bucket int, n long, lang string").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows, and the languages
    per_lang = {r.lang: r.n for r in counts if r.bucket < 0}
    langs, total = sorted(per_lang), sum(per_lang.values())
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    df = np.zeros(BUCKETS)
    for r in counts:
        if r.bucket >= 0:
            df[r.bucket] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1
    each = max(1, sample // len(langs))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(float(min(1.0, 1.1 * each / per_lang[k] + 1e-9))))])
    picked = docs.where(rank < F.element_at(rate, F.col("lang")) * float(1 << 30)).select("text", "lang", rank.alias("rank"))

    def bag(batches):
        for b in batches:
            for at, t in slices(b.column(0)):
                i, c = zip(*bags(t))
                yield b.column(1).slice(at, t.n), b.column(2).slice(at, t.n), [x.tobytes() for x in i], [x.astype(np.int32).tobytes() for x in c]

    rows = sorted(map_arrow(picked, bag, "lang string, rank long, buckets binary, counts binary").collect(), key=lambda r: (r.rank, r.lang, bytes(r.buckets)))
    used: dict[str, int] = {}
    cases = []
    for r in rows:
        used[r.lang] = used.get(r.lang, 0) + 1
        i, c = np.frombuffer(r.buckets, np.uint16).astype(np.int64), np.frombuffer(r.counts, np.int32)
        if used[r.lang] <= each and len(i):
            cases.append((np.r_[i, BUCKETS], np.r_[SCALE * c / c.sum() * idf[i], 1.0], langs.index(r.lang)))
    held, fit = cases[::5], [c for k, c in enumerate(cases) if k % 5] or cases
    model, order = Ftrl(len(langs)), np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(fit)).tolist():
            model.learn(*fit[k])
    w = model.weights()
    logits = np.array([x @ w[i] for i, x, _ in held]).reshape(-1, len(langs))
    y = np.int64([c[2] for c in held])
    heat = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / h)[np.arange(len(y)), y], 1e-12)).mean() if len(y) else 0.0 for h in heat]
    w /= heat[int(np.argmin(loss))] if len(y) else 1.0
    return langs, (SCALE * idf[:, None] * w[:BUCKETS]).astype(np.float32), w[BUCKETS]


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score. docs: doc_id, text."""
    langs, table, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))  # BUCKETS numbers a language

    def run(batches):
        for b in batches:
            for at, t in slices(b.column(1)):
                by_order, offs, cp = grams(t)
                n = np.diff(offs)
                ok = sums(letter_table()[cp], offs) > 0
                if langs:
                    logits = np.stack([sum(sums(row[g], offs) for g in by_order) / np.maximum(1, ORDERS * n) for row in sent.value], 1) + bias
                    p = softmax(logits)
                    best = p.argmax(1)
                    yield b.column(0).slice(at, t.n), [langs[k] if o else "und" for k, o in zip(best.tolist(), ok)], np.where(ok, p[np.arange(len(p)), best], 0.0)
                else:
                    yield b.column(0).slice(at, t.n), ["und"] * t.n, np.zeros(t.n)

    return map_arrow(docs, run, "doc_id long, lang_pred string, score double")


def held_out(column: str = "doc_id"):
    """Every fourth document by checksum of its id: never learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows.where(~held_out()), "lang", sample)
    return predict(rows.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
