"""Substring dedup: drop words covered by a 20-word window seen earlier in the corpus.

Method: a count-min prefilter. Every partition sketches the counts of its windows,
the partition sketches are merged, and windows whose estimate is 1 are done. A
second pass groups exactly (96 bits from two independent hashes of every word) only
the windows estimated repeated. An estimate is never below the count, so none is lost.

A window is sketched by the least hash among its 8-word grams. Equal windows have
equal least grams, so the gram's count (each place in the corpus once) bounds the
window's from above, and a seventh as many counters are touched. Counters saturate
at two; what is broadcast is one bit a cell, at most ``rows * MAX_WIDTH / 8`` bytes
(32 MB) however large the corpus: beyond that more windows reach the exact pass,
which is itself sharded, pre-aggregated and exact at any size.

Defined results: null and empty texts have no words; texts under 20 words keep all;
rows with a null id keep all and count for no other row; rows that share an id are
the same document (equal rows are treated alike, none is a copy of the other); of equal
windows the one with the least (id, place) stays; a very long text is a slice of its own
and is judged whole; an empty table gives an empty table; further columns, whatever their
names, are carried in ``doc``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, WORD_POWERS, mix, prefix_hash, slices, sliding, span_hash, windows
from .common import ceil_pow2, map_arrow, pack, strings, unpack, utf8_bytes

GRAM, ROWS, MAX_WIDTH, CHUNK = 8, 2, 1 << 27, 1 << 20
ROW_SEEDS = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)]
FLUSH_KEYS, FLUSH_WINDOWS = 4_000_000, 2_000_000


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys ^ ROW_SEEDS[row]) >> U64(64 - bits)).astype(np.int64)


class _Windows:
    """Of a slice: the word hashes' prefix, which windows exist, each one's least gram."""

    def __init__(self, t, window: int):
        t.words()
        self.words, n = t.hashes(), len(t.start)
        self.prefix, self.ok, span = prefix_hash(self.words, WORD_POWERS), windows(t.first, window, n), window - GRAM + 1
        self.grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        if n >= GRAM:
            i = np.arange(n - GRAM + 1)
            self.grams[: len(i)] = span_hash(self.prefix, i, i + GRAM, WORD_POWERS)
        self.least, self.span = sliding(self.grams, span) if n > span else self.grams, span

    def places(self) -> np.ndarray:
        """Grams that are the least of some window, once for each place."""
        if not self.ok.any():
            return self.grams[:0]
        back = sliding(np.where(self.ok, self.least, U64(0))[::-1], self.span, np.maximum)[::-1]
        return self.grams[(back == self.grams) & (back != 0)]


def repeated_cells(docs: DataFrame, window: int, width: int) -> np.ndarray:
    """The merged sketch as bits: cell i of row r is set if two places or more fell into it."""
    bits, chunk = int(width).bit_length() - 1, min(CHUNK, width)

    def sketch(batches):
        held, have = [], 0

        def emit():
            keys = np.concatenate(held)
            for r in range(ROWS):
                cells = np.sort(_cells(keys, r, bits))
                first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
                many = np.diff(np.r_[first, len(cells)]) > 1
                cells = cells[first]
                cuts = np.flatnonzero(np.r_[True, cells[1:] // chunk != cells[:-1] // chunk, True])
                code = ((cells % chunk) << 1 | many).astype(np.int64)
                parts = [r * (width // chunk) + int(cells[a] // chunk) for a in cuts[:-1]]
                yield parts, [pack(np.diff(code[a:b], prepend=0).astype(np.int32)) for a, b in zip(cuts[:-1], cuts[1:])]

        for b in batches:
            for _, t in slices(b.column(0)):
                keys = _Windows(t, window).places()
                if len(keys):
                    held.append(keys)
                    have += len(keys)
                if have >= FLUSH_KEYS:
                    yield from emit()
                    held, have = [], 0
        if held:
            yield from emit()

    def merge(batches):
        part, counts = None, None
        for b in batches:
            for p, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != part:
                    if part is not None:
                        yield [part], [np.packbits(counts > 1).tobytes()]
                    part, counts = p, np.zeros(chunk, np.uint8)
                code = np.cumsum(unpack(cells, np.int32))
                at = code >> 1
                counts[at] = np.minimum(2, counts[at] + 1 + (code & 1))
        if part is not None:
            yield [part], [np.packbits(counts > 1).tobytes()]

    parts = ROWS * (width // chunk)
    n = max(1, min(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    made = map_arrow(docs.select("text"), sketch, "part int, cells binary").repartition(n, "part").sortWithinPartitions("part")
    out = np.zeros((ROWS, width // 8), np.uint8)
    for row in map_arrow(made, merge, "part int, bits binary").collect():  # ROWS * width bits, at most 32 MB
        r, c = divmod(row.part, width // chunk)
        out[r, c * chunk // 8 : (c + 1) * chunk // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def _per_doc(ids, keys, d, s):
    """Rows (id, key, starts) of covered windows; d: index into ids, grouped here."""
    o = np.lexsort((s, d))
    d, s = d[o], s[o]
    cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1], True]) if len(d) else np.zeros(1, np.int64)
    return [(int(ids[d[a]]), int(keys[d[a]]), pack(np.diff(s[a:b], prepend=0).astype(np.int32))) for a, b in zip(cut[:-1], cut[1:])]


def covered_windows(docs: DataFrame, window: int, total_bytes: int) -> DataFrame:
    """doc_id, key, starts (list of packed arrays): windows whose words also start earlier."""
    spark = docs.sparkSession
    width = min(MAX_WIDTH, max(1 << 16, ceil_pow2(total_bytes / 9)))
    bits, repeated = width.bit_length() - 1, spark.sparkContext.broadcast(repeated_cells(docs, window, width))
    shards = min(1 << 16, max(16, ceil_pow2(total_bytes / (32 << 20))))
    shift = U64(64 - (shards.bit_length() - 1))

    def candidates(batches):
        cells = repeated.value
        held: list = []
        ids, keys, have = [], [], 0

        def emit():
            doc, key = np.concatenate(ids), np.concatenate(keys)
            d, s, h1, h2 = (np.concatenate(x) for x in zip(*held))
            o = np.lexsort((s, doc[d]))
            o = o[np.lexsort((h2[o], h1[o]))]
            d, s, h1, h2 = d[o], s[o], h1[o], h2[o]
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            first = (doc[d] == doc[d[lead]]) & (s == s[lead])
            rows = _per_doc(doc, key, d[~first], s[~first])
            for at in range(0, len(rows), 5000):
                x = list(zip(*rows[at : at + 5000]))
                yield [(i * 2654435761 >> 8) % shards for i in x[0]], x[0], x[1], x[2], [None] * len(x[0])
            d, s, h1, h2 = d[first], s[first], h1[first], h2[first]
            cut = np.searchsorted(h1 >> shift, np.arange(shards + 1).astype(np.uint64))
            for k in np.flatnonzero(np.diff(cut)):
                part = slice(cut[k], cut[k + 1])
                o = np.lexsort((s[part], d[part]))
                used, back = np.unique(d[part][o], return_inverse=True)
                n, m = len(o), len(used)
                blob = np.int64([n, m]).tobytes() + doc[used].tobytes() + key[used].tobytes() + h1[part][o].tobytes() + h2[part][o].tobytes() + back.astype(np.int32).tobytes() + s[part][o].tobytes()
                yield [int(k)], [None], [None], [None], [pack(np.frombuffer(blob, np.uint8))]

        for b in batches:
            bid, bkey = b.column(0).to_numpy(), b.column(2).to_numpy()
            for at, t in slices(b.column(1)):
                w = _Windows(t, window)
                i = np.flatnonzero(w.ok)
                for r in range(ROWS):
                    c = _cells(w.least[i], r, bits)
                    i = i[(cells[r, c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0]
                base = sum(map(len, ids))
                if len(i):
                    d = np.searchsorted(t.first, i, "right") - 1
                    h1 = span_hash(w.prefix, i, i + window, WORD_POWERS)
                    h2 = span_hash(prefix_hash(t.hashes(seed=1), WORD_POWERS), i, i + window, WORD_POWERS).astype(np.uint32)
                    held.append(((d + base).astype(np.int32), (i - t.first[d]).astype(np.int32), h1, h2))
                    have += len(i)
                ids.append(bid[at : at + t.n])
                keys.append(bkey[at : at + t.n])
                if have >= FLUSH_WINDOWS:
                    yield from emit()
                    held, ids, keys, have = [], [], [], 0
        if held:
            yield from emit()

    def read(blob):
        raw = unpack(blob, np.uint8).tobytes()
        n, m = np.frombuffer(raw, np.int64, 2)
        at, out = 16, []
        for kind, k in ((np.int64, m), (np.int64, m), (np.uint64, n), (np.uint32, n), (np.int32, n), (np.int32, n)):
            out.append(np.frombuffer(raw, kind, k, at))
            at += out[-1].nbytes
        return out

    def resolve(batches):
        shard, blobs = None, []

        def emit():
            parts = [read(x) for x in blobs]
            base = np.cumsum([0] + [len(p[0]) for p in parts])
            doc, key, h1, h2 = (np.concatenate([p[j] for p in parts]) for j in range(4))
            d = np.concatenate([p[4] + b for p, b in zip(parts, base)])
            s = np.concatenate([p[5] for p in parts])
            o = np.lexsort((s, doc[d], h2, h1))
            d, s, h1, h2 = d[o], s[o], h1[o], h2[o]
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = (doc[d] != doc[d[lead]]) | (s != s[lead])
            rows = _per_doc(doc, key, d[late], s[late])
            for at in range(0, len(rows), 5000):
                yield tuple(zip(*rows[at : at + 5000]))

        for b in batches:
            local = pa.compute.is_valid(b.column(1))
            if pa.compute.any(local).as_py():
                own = b.filter(local)
                yield own.column(1), own.column(2), own.column(3)
            rest = b.filter(pa.compute.invert(local))
            for k, blob in zip(rest.column(0).to_pylist(), rest.column(4).to_pylist()):
                if k != shard and blobs:
                    yield from emit()
                    blobs = []
                shard = k
                blobs.append(blob)
        if blobs:
            yield from emit()

    found = map_arrow(docs.where("doc_id is not null").select("doc_id", "text", "key"), candidates, "shard int, doc_id long, key long, starts binary, firsts binary")
    found = found.repartition(shards, "shard").sortWithinPartitions("shard")
    return map_arrow(found, resolve, "doc_id long, key long, starts binary").groupBy("doc_id", "key").agg(F.collect_list("starts").alias("starts"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, untouched: bool = False) -> DataFrame:
    """doc (struct of the input row but its text), n_words, n_removed, kept_text (kept words joined by one space; with untouched, a text that loses nothing stays as it is) for every row."""
    row = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    covered = covered_windows(row.select("doc_id", "text", "key"), window, utf8_bytes(row))
    rest = [c for c in docs.columns if c != text_col]
    row = row.withColumn("doc", F.struct(*[F.col("doc")[c].alias(c) for c in rest])) if rest else row.withColumn("doc", F.struct(F.lit(None).cast("int").alias("none")))
    both = row.join(covered, ["doc_id", "key"], "left").select("doc", "text", "starts")

    def keep(batches):
        for b in batches:
            starts = b.column(2)
            for at, t in slices(b.column(1)):
                t.words()
                n = len(t.start)
                edge = np.zeros(n + 1, np.int32)
                for k, blobs in enumerate(starts.slice(at, t.n).to_pylist()):
                    for x in blobs or ():
                        s = np.cumsum(unpack(x, np.int32)) + t.first[k]
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + window, -1)
                kept = np.cumsum(edge[:-1]) == 0
                removed = np.r_[0, np.cumsum(~kept)]
                removed = removed[t.first[1:]] - removed[t.first[:-1]]
                s, e, owner = t.start[kept], t.end[kept], np.repeat(np.arange(t.n), np.diff(t.first))[kept]
                if untouched:
                    whole = np.flatnonzero((removed == 0) & (np.diff(t.offs) > 0))
                    cut = ~np.isin(owner, whole)
                    o = np.argsort(np.r_[owner[cut], whole], kind="stable")
                    s, e, owner = np.r_[s[cut], t.offs[whole]][o], np.r_[e[cut], t.offs[whole + 1]][o], np.r_[owner[cut], whole][o]
                size = e - s + 1
                to = np.cumsum(size)
                take = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(s - np.r_[0, to[:-1]] if len(to) else s, size)
                out = t.buf[np.minimum(take, max(0, len(t.buf) - 1))] if len(t.buf) else t.buf
                if len(to):
                    out[to - 1] = 32
                words = np.searchsorted(owner, np.arange(t.n + 1))
                offs = np.r_[0, to][words]
                drop = np.unique(offs[1:][np.diff(offs) > 0]) - 1  # the space after each text's last word
                out = np.delete(out, drop)
                offs = offs - np.searchsorted(drop, offs, "left")
                yield b.column(0).slice(at, t.n), np.diff(t.first), removed, strings(out, offs)

    return map_arrow(both, keep, "n_words long, n_removed long, kept_text string", doc=both.schema["doc"].dataType)
