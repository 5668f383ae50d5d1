"""Interpolated modified Kneser-Ney model of words (order 2), with counts and lookups sharded by the context's hash.

A word is a run of letters and digits; other characters, and letters of scripts written without
spaces, stand alone. Words are known by a 64-bit hash of their lower-case code points, so nothing is
merged, and every text ends with a word of its own. A word that was never seen gets the freed mass of
order 1, spelled with equal chances of ``alphabet`` code points; seen words get no share of the spelling.

Counting: tasks send each distinct bigram of the trusted texts once, with its count, to the shard of its
context; that shard merges them and sends each following word once, with the number of contexts before it,
to that word's own shard, which adds up the continuation counts and answers. A shard then knows, for its
contexts, c(v, w), their totals and the order-1 probabilities of w, and writes a file: F(w) for words and
G(v, w) for bigrams. With p2 = a(v, w) + gamma(v) p1(w),

    -log p2 = -log p1(w) - log gamma(v) + G(v, w),  G = 0 for a bigram that was not seen,

so a text's score is a plain sum: F(w) = -log p1(w) - log gamma(w) over its words (each is once the word and
once the context) and G over its seen bigrams. Scoring therefore needs one exchange: a block of texts sends
each shard its keys and the texts that hold them, shards return sums by text. Keys that are frequent in the
trusted texts (a share of 2 ** -18 or more, so at most 2 ** 18 words and as many bigrams) are broadcast with
their values, so that hot keys are never sent; a bit sketch of the keys (at most 32 MB) keeps most keys that
the model lacks at home. Whatever the sketch lets pass meets the exact table.

Keys are sent with 14 bits more than the texts' bytes need, so about one unseen bigram in a million takes
another's value. A text's sum is added in the order of its keys: copies score alike wherever they stand.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, Texts, codepoints, letter_table, lower_table, mix, slices, span_keys
from .common import ZSTD, ceil_pow2, map_arrow, pack, shared_dir, unpack
from .files import opened, removed, written

EDGE, END = mix(np.array([0x5EED, 0xE0F], U64))
FLUSH, SHARE, SKETCH = 2_000_000, 2.0**-18, 1 << 28
WORD, GRAM = U64(0x8F1BBCDCBFA53E0B), U64(0xC2B2AE3D27D4EB4F)
ALONE = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x40000))
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of every code point: 0 space, 1 part of a word, 2 a word alone."""
    if not _KINDS:
        k = np.full(0x110000, 2, np.uint8)
        k[letter_table()] = 1
        k[48:58] = 1
        for a, b in ALONE:
            k[a:b] = 2
        k[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = 0
        _KINDS.append(k)
    return _KINDS[0]


def pair(a, b):
    return mix(a * U64(0x9E3779B97F4A7C15) + mix(b + U64(0xA5A5)))


def word_keys(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word with END behind each text that isn't empty, code points of each, offsets by text, lower-case code points)."""
    cp, offs = codepoints(t)
    low = lower_table()[cp]
    kind = kinds()[low]
    begins = kind == 2
    begins[1:] |= (kind[1:] == 1) & (kind[:-1] != 1)
    begins[:1] |= kind[:1] == 1
    lead = offs[:-1][np.diff(offs) > 0]
    begins[lead] |= kind[lead] == 1
    start = np.flatnonzero(begins)
    stop = (kind == 0) | begins
    stop[lead] = True
    stops = np.r_[np.flatnonzero(stop), len(cp)]
    end = stops[np.searchsorted(stops, start, "right")]
    h = span_keys(low.astype("<u2").view(np.uint8), 2 * start, 2 * end)
    if (high := low > 0xFFFF).any():  # words with code points above the first plane: by all their bits
        n = np.r_[0, np.cumsum(high)]
        some = np.flatnonzero(n[end] > n[start])
        h[some] = mix(h[some] ^ span_keys(low.view(np.uint8), 4 * start[some], 4 * end[some], 1))
    first = np.searchsorted(start, offs)
    some = np.diff(offs) > 0
    to = first + np.r_[0, np.cumsum(some)]
    keys, size = np.full(to[-1], END, U64), np.zeros(to[-1], np.int64)
    at = np.arange(len(h)) + np.repeat((to - first)[:-1], np.diff(first))
    keys[at], size[at] = h, end - start
    return keys, size, to, low


def contexts(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The word before each word, EDGE at the beginning of a text."""
    one = np.empty_like(h)
    one[1:], one[offs[:-1][np.diff(offs) > 0]] = h[:-1], EDGE
    return one


class Keys:
    """What is sent for words and bigrams: ``bits`` wide, the shard (of the word, or of the bigram's context) on top."""

    def __init__(self, total_bytes: int):
        self.shards = min(1 << 16, max(16, ceil_pow2(total_bytes / (32 << 20))))
        self.top = self.shards.bit_length() - 1
        self.bits = min(64, 14 + int(ceil_pow2(total_bytes)).bit_length())

    def words(self, h):
        return h >> U64(64 - self.bits)

    def grams(self, one, h):
        return ((one >> U64(64 - self.top) << U64(64 - self.top)) | (pair(one, h) >> U64(self.top))) >> U64(64 - self.bits)

    def cuts(self, keys) -> np.ndarray:
        """Where each shard's keys begin and end among sorted ones."""
        return np.searchsorted(keys >> U64(self.bits - self.top), np.arange(self.shards + 1).astype(U64))

    def cells(self, keys, kind, depth: int):
        """Their bits in a sketch of 2 ** depth cells a shard."""
        return ((keys >> U64(self.bits - self.top) << U64(depth)) | (mix(keys ^ kind) >> U64(64 - depth))).astype(np.int64)


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers or float32: their lowest bytes together, then the next ones, as many as are used, compressed."""
    out = []
    for a in arrays:
        a = a.view(np.uint32) if a.dtype == np.float32 else a
        wide = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        raw = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()
        body = ZSTD.compress(raw, asbytes=True)
        out.append(np.int64([len(a), wide, len(body)]).tobytes() + body)
    return b"".join(out)


def load(blob: bytes) -> list[np.ndarray]:
    """The arrays of dump, as unsigned 64-bit integers."""
    out, at = [], 0
    while at < len(blob):
        n, wide, size = (int(x) for x in np.frombuffer(blob, np.int64, 3, at))
        a = np.zeros((n, 8), np.uint8)
        a[:, :wide] = np.frombuffer(ZSTD.decompress(blob[at + 24 : at + 24 + size], n * wide, asbytes=True), np.uint8).reshape(wide, n).T
        out.append(a.reshape(-1).view(U64))
        at += 24 + size
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


def floats(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32).view(np.float32)


def added(one: np.ndarray, h: np.ndarray, n: np.ndarray):
    """Equal bigrams added up, in the order of (context, word)."""
    o = np.lexsort((h, one))
    one, h, n = one[o], h[o], n[o]
    lead = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (h[1:] != h[:-1])]) if len(o) else o
    return one[lead], h[lead], np.add.reduceat(n, lead) if len(lead) else n


def by_shard(batches, column: int = 0):
    """(shard, its rows) of Arrow batches sorted by shard; rows: tuples of the columns, read as they are asked for."""
    return groupby((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), itemgetter(column))


def taken(held: list[list], column: int) -> np.ndarray:
    """A column of what is held, in one piece; the pieces go."""
    out = np.concatenate([x[column] for x in held])
    for x in held:
        x[column] = None
    return out


def counts_of(n: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4; their sum; how many there are."""
    return [int((n == i).sum()) for i in (1, 2, 3, 4)] + [int(n.sum()), len(n)]


def discounts(of) -> np.ndarray:
    """The discount of a count of 0, 1, 2, 3 and more, from the counts of counts."""
    n1, n2, n3, n4 = (float(x) for x in of[:4])
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return np.float64([0.0] + [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)])


class Model:
    """Where the shards' files are, and what is broadcast: frequent keys with their values, the sketch, the constants."""

    def __init__(self, keys: Keys, folder: str):
        self.keys, self.folder, self.depth = keys, folder, 3
        self.words, self.word_values = np.zeros(0, U64), np.zeros(0)
        self.grams, self.gram_values = np.zeros(0, U64), np.zeros(0)
        self.sketch, self.edge, self.unseen, self.spell = np.zeros(keys.shards, np.uint8), 0.0, 0.0, 0.0

    def within(self, keys, kind) -> np.ndarray:
        """Whether the sketch holds them: never False for a key of the model."""
        at = self.keys.cells(keys, kind, self.depth)
        return (self.sketch[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def value_of(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of those asked among sorted keys; NaN if there is none."""
    if not len(keys):
        return np.full(len(asked), np.nan)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], np.nan)


def train(docs: DataFrame, total_bytes: int) -> Model:
    """docs: text of the trusted documents; total_bytes: of the texts that will be scored."""
    spark, keys = docs.sparkSession, Keys(total_bytes)
    top, folder = U64(64 - keys.top), shared_dir(docs.sparkSession, "word-model")

    def count(batches):
        held, have, seen = [], 0, np.zeros(0x110000, bool)

        def emit():
            one, h, n = added(*(taken(held, k) for k in range(3)))
            cut = np.searchsorted(one >> top, np.arange(keys.shards + 1).astype(U64))
            for k in np.flatnonzero(np.diff(cut)):
                yield [int(k)], [blob_of(*(x[cut[k] : cut[k + 1]] for x in (one, h, n)))]

        for b in batches:
            for _, t in slices(b.column(0)):
                h, _, offs, low = word_keys(t)
                if len(h):
                    seen[low] = True
                    one = contexts(h, offs)
                    _, at, n = np.unique(pair(one, h), return_index=True, return_counts=True)
                    held.append([one[at], h[at], n])
                    have += len(at)
                if have >= FLUSH:
                    yield from emit()
                    held, have = [], 0
        if held:
            yield from emit()
        if seen.any():
            yield [-1], [dump(steps(np.flatnonzero(seen).astype(U64)))]

    def blob_of(one, h, n):
        u, back = np.unique(np.concatenate([one, h]), return_inverse=True)
        return dump(steps(u), steps(back[: len(one)].astype(U64)), back[len(one) :].astype(U64), n.astype(U64) - U64(1))

    def bigrams(blob):
        u, one, h, n = load(blob)
        u = np.cumsum(u)
        return u[np.cumsum(one).astype(np.int64)], u[h.astype(np.int64)], (n + U64(1)).astype(np.int64)

    def merge(batches):
        for shard, rows in by_shard(batches):
            if shard < 0:
                letters = np.unique(np.concatenate([np.cumsum(load(r[1])[0]) for r in rows]))
                yield [-1], [-1], [None], [[len(letters), 0, 0, 0, 0, 0]]
                continue
            held, have = [], 0
            for r in rows:
                held.append([*bigrams(r[1])])
                have += len(held[-1][0])
                if have > 2 * FLUSH:
                    held, have = [[*added(*(taken(held, k) for k in range(3)))]], 0
            one, h, n = added(*(taken(held, k) for k in range(3)))
            with written(f"{folder}/counts/{shard:05d}") as out:
                out.write(blob_of(one, h, n))
            yield [-2], [-1], [None], [counts_of(n)]
            u, n = np.unique(h, return_counts=True)
            cut = np.searchsorted(u >> top, np.arange(keys.shards + 1).astype(U64))
            for k in np.flatnonzero(np.diff(cut)):
                a, b = cut[k], cut[k + 1]
                yield [int(k)], [shard], [dump(steps(u[a:b]), n[a:b])], [None]

    def follow(batches):
        for shard, rows in by_shard(batches):
            if shard < 0:
                for r in rows:
                    yield [shard], [None], [r[3]]
                continue
            rows = list(rows)
            parts = [load(r[2]) for r in rows]
            asked = [np.cumsum(p[0]) for p in parts]
            u, back = np.unique(np.concatenate(asked), return_inverse=True)
            n = np.bincount(back, np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.int64)
            yield [-3], [None], [counts_of(n)]
            yield [shard], [b"\1" + dump(steps(u), n)], [None]
            for r, a in zip(rows, asked):
                yield [r[1]], [b"\0" + dump(steps(a), n[np.searchsorted(u, a)])], [None]

    one_row = "shard int, blob binary, stats array<long>"
    sent = map_arrow(docs.select("text"), count, "shard int, blob binary").repartition(keys.shards, "shard").sortWithinPartitions("shard")
    ahead = map_arrow(sent, merge, "to int, shard int, blob binary, stats array<long>").repartition(keys.shards, "to").sortWithinPartitions("to")
    map_arrow(ahead, follow, one_row).write.parquet(f"{folder}/answers")
    answers = spark.read.schema(one_row).parquet(f"{folder}/answers")
    stats = answers.where("shard < 0").groupBy("shard").agg(F.array(*[F.sum(F.get("stats", i)) for i in range(6)]).alias("s")).collect()
    of = {r.shard: r.s for r in stats}  # three rows
    model = Model(keys, folder)
    if -3 not in of:
        return model
    model.spell = float(np.log(of[-1][0] + 1))
    d1, d2, total, said = discounts(of[-3]), discounts(of[-2]), float(of[-3][4]), float(of[-2][4])
    freed = sum(d * c for d, c in zip(d1[1:], [*of[-3][:2], of[-3][5] - sum(of[-3][:2])])) / total
    model.unseen = -float(np.log(max(freed, 1e-12)))
    model.depth = depth = max(3, ceil_pow2(min(SKETCH, 10 * of[-2][5]) / keys.shards).bit_length() - 1)
    least = max(2.0, said * SHARE)

    def finish(batches):
        for shard, rows in by_shard(batches):
            rows = list(rows)
            own = [load(r[1][1:]) for r in rows if r[1][0]]
            words, n_words = (np.cumsum(own[0][0]), own[0][1].astype(np.int64)) if own else (np.zeros(0, U64), np.zeros(0, np.int64))
            replies = [load(r[1][1:]) for r in rows if not r[1][0]]
            gram_keys, gram_values, gram_counts, lead, sums = np.zeros(0, U64), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0)
            back = np.zeros(0)
            if replies:
                with opened(f"{folder}/counts/{shard:05d}") as f:
                    one, h, n = bigrams(f.read())
                after = np.concatenate([np.cumsum(p[0]) for p in replies])
                times = np.concatenate([p[1] for p in replies]).astype(np.int64)
                o = np.argsort(after)
                times = times[o][np.searchsorted(after[o], h)]
                new = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
                size = np.diff(np.r_[new, len(one)])
                cut = d2[np.minimum(n, 3)]
                sums, lead = np.add.reduceat(n, new).astype(np.float64), one[new]
                gamma = np.add.reduceat(cut, new) / sums
                back = -np.log(gamma)
                p1 = (times - d1[np.minimum(times, 3)]) / total
                p2 = (n - cut) / np.repeat(sums, size) + np.repeat(gamma, size) * p1
                k = keys.grams(one, h)
                gram_keys, at = np.unique(k, return_index=True)
                gram_values, gram_counts = (np.log(p1) - np.log(p2) - np.repeat(back, size)).astype(np.float32)[at], n[at]
            every = np.union1d(words, lead)
            value, times = np.zeros(len(every)), np.zeros(len(every))
            at = np.searchsorted(every, words)
            value[at] = -np.log((n_words - d1[np.minimum(n_words, 3)]) / total)
            at = np.searchsorted(every, lead)
            value[at] += back
            times[at] = sums
            often = (times >= least) | (every == END) | (every == EDGE)
            word_keys_, at = np.unique(keys.words(every), return_index=True)
            value, often = value[at].astype(np.float32), often[at]
            with written(f"{folder}/model/{shard:05d}") as out:
                out.write(dump(steps(word_keys_), value, steps(gram_keys), gram_values))
            bits = np.zeros(1 << depth, np.uint8)
            for k, kind in ((word_keys_, WORD), (gram_keys, GRAM)):
                bits[keys.cells(k, kind, depth) & ((1 << depth) - 1)] = 1
            hot = gram_counts >= least
            yield [shard], [word_keys_[often].tobytes()], [value[often].tobytes()], [gram_keys[hot].tobytes()], [gram_values[hot].tobytes()], [pack(np.packbits(bits, bitorder="little"))]

    kind = "shard int, words binary, word_values binary, grams binary, gram_values binary, bits binary"
    rows = map_arrow(answers.where("shard >= 0").select("shard", "blob").repartition(keys.shards, "shard").sortWithinPartitions("shard"), finish, kind).orderBy("shard")
    model.sketch = np.zeros(keys.shards << depth >> 3, np.uint8)
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for r in rows.collect():  # at most 2 ** 18 words and bigrams with their values, and SKETCH bits
        for x, raw, dtype in zip(parts, r[1:5], (U64, np.float32, U64, np.float32)):
            x.append(np.frombuffer(raw, dtype))
        size = 1 << depth >> 3
        model.sketch[r.shard * size : (r.shard + 1) * size] = unpack(r.bits, np.uint8)
    for name in ("counts", "answers"):
        removed(f"{folder}/{name}")
    model.words, word_values, model.grams, gram_values = (np.concatenate(x) for x in parts)
    model.word_values, model.gram_values = word_values.astype(np.float64), gram_values.astype(np.float64)
    model.edge = float(np.nan_to_num(value_of(model.words, model.word_values, keys.words(np.array([EDGE], U64)))[0]))
    return model


def asked(keys: np.ndarray, docs: np.ndarray, size: np.ndarray, of: Keys) -> dict[int, bytes]:
    """By shard: the distinct keys, how often each stands, the documents where it does, each key's size."""
    if not len(keys):
        return {}
    o = np.argsort(keys, kind="stable")
    keys, docs, size = keys[o], docs[o], size[o]
    lead = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends, n, keys, size = np.r_[lead, len(docs)], np.diff(np.r_[lead, len(docs)]), keys[lead], size[lead]
    cut = of.cuts(keys)
    parts = ((int(k), cut[k], cut[k + 1]) for k in np.flatnonzero(np.diff(cut)))
    return {k: dump(steps(keys[a:b]), n[a:b] - 1, docs[ends[a] : ends[b]], size[a:b]) for k, a, b in parts}


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """row, n_symbols, nats (sum of -log p) of every row. docs: row (struct), text."""
    keys, sent = model.keys, docs.sparkSession.sparkContext.broadcast(model)

    def ask(batches):
        m, part, held, have = sent.value, TaskContext.get().partitionId(), [], 0

        def emit():
            at = np.cumsum([0] + [len(x[0]) for x in held])
            base, n_symbols = taken(held, 0), taken(held, 2)
            for x, a in zip(held, at):
                x[4] += np.int32(a)
                x[7] += np.int32(a)
            w, g = (asked(taken(held, k), taken(held, k + 1), taken(held, k + 2), keys) for k in (3, 6))
            shards = sorted(w.keys() | g.keys())
            sink = pa.BufferOutputStream()
            table = pa.record_batch([pa.concat_arrays([x[1] for x in held]), pa.array(n_symbols), pa.array(base)], names=["row", "n_symbols", "nats"])
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(table)
            raw = sink.getvalue().to_pybytes()
            digest = hashlib.blake2b(raw, digest_size=12).digest()  # the same in every attempt at this task
            block = f"{part}-{digest.hex()}"
            yield [int.from_bytes(digest[:4], "little") % keys.shards], [block], [-1 - len(shards)], [raw], [None]
            for k in shards:
                yield [k], [block], [len(base)], [w.get(k)], [g.get(k)]

        for b in batches:
            for at, t in slices(b.column(1)):
                h, size, offs = word_keys(t)[:3]
                doc = np.repeat(np.arange(t.n), np.diff(offs))
                k = keys.words(h)
                value = value_of(m.words, m.word_values, k)
                out = np.flatnonzero(np.isnan(value))
                inside = m.within(k[out], WORD)
                value[out] = np.where(inside, 0.0, m.unseen + m.spell * (size[out] + 1))
                rare = out[inside]
                g = keys.grams(contexts(h, offs), h)
                maybe = np.flatnonzero(m.within(g, GRAM))
                known = value_of(m.grams, m.gram_values, g[maybe])
                hot = ~np.isnan(known)
                base = np.bincount(doc, value, t.n) + np.bincount(doc[maybe[hot]], known[hot], t.n) + np.where(np.diff(offs) > 0, m.edge, 0.0)
                maybe = maybe[~hot]
                held.append([base, b.column(0).slice(at, t.n), np.bincount(doc, size + 1, t.n).astype(np.int64), k[rare], doc[rare].astype(np.int32), size[rare].astype(np.int32), g[maybe], doc[maybe].astype(np.int32), np.zeros(len(maybe), np.uint8)])
                have += len(rare) + len(maybe) + t.n
                if have >= FLUSH:
                    yield from emit()
                    held, have = [], 0
        if held:
            yield from emit()

    def answer(batches):
        shard, tables = None, None
        for batch in batches:
            for k, block, n, w, g in zip(*(c.to_pylist() for c in batch.columns)):
                if n < 0:
                    yield [block], [-1], [n], [w]
                    continue
                if k != shard:
                    with opened(f"{model.folder}/model/{k:05d}") as f:
                        words, word_values, grams, gram_values = load(f.read())
                    shard, tables = k, ((np.cumsum(words), floats(word_values)), (np.cumsum(grams), floats(gram_values)))
                sums = np.zeros(n)
                for blob, (own, values), word in ((w, tables[0], True), (g, tables[1], False)):
                    if blob is not None:
                        key, times, doc, size = load(blob)
                        got = value_of(own, values, np.cumsum(key)).astype(np.float64)
                        got = np.where(np.isnan(got), sent.value.unseen + sent.value.spell * (size + 1.0) if word else 0.0, got)
                        sums += np.bincount(doc.astype(np.int64), np.repeat(got, times.astype(np.int64) + 1), n)
                yield [block], [k], [n], [dump(sums.astype(np.float32))]

    def total(batches):
        def done():
            if len(sums) != -1 - wanted:
                raise RuntimeError("answers to a block of texts are missing: its input came in another order when a task was repeated")
            for part in pa.ipc.open_stream(rows):
                nats = part.column(2).to_numpy().copy()
                for s in sums:
                    nats += s
                yield part.column(0), part.column(1), nats

        block, rows, wanted, sums = None, None, 0, []
        for batch in batches:
            for name, _, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if name != block:
                    if block is not None:
                        yield from done()
                    block, rows, wanted, sums = name, None, 0, []
                if n < 0:
                    rows, wanted = raw, n
                else:
                    sums.append(floats(load(raw)[0]).astype(np.float64))
        if block is not None:
            yield from done()

    sent_rows = map_arrow(docs.select("row", "text"), ask, "shard int, block string, n int, w binary, g binary")
    back = map_arrow(sent_rows.repartition(keys.shards, "shard").sortWithinPartitions("shard"), answer, "block string, shard int, n int, v binary")
    return map_arrow(back.repartition("block").sortWithinPartitions("block", "shard"), total, "n_symbols long, nats double", row=docs.schema["row"].dataType)
