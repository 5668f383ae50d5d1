"""Best-fit packing of token pieces into sequences under several capacities.

Vector best-fit, in descending length: a piece has a demand of (tokens, documents,
attention cost = length squared); among the open sequences whose residual capacities
all hold it, the one with the least weighted residual norm (or the greatest weighted
dot product of demand and residual) takes it.

Pieces of a length are alike, so the plan is made from the counts by length, at most
``capacity`` rows whatever the corpus: open sequences in the same state are one class
with a count, a class takes as many equal pieces at once as it would one by one, and a
sequence's number is its class's base plus its rank. Documents then look up their own
place: rank within (task, length) + earlier tasks' counts of that length -> slot.

Defined results: null and empty texts are the end id alone; repeated rows and null ids
are packed as separate documents; of equal scores the class opened first takes the piece;
a very long text is cut into as many pieces as it needs; an empty table packs nothing;
further columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import slices
from .bpe import default_path, encoder, with_end
from .common import map_arrow, saved


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and rank (place among the task's pieces of that length)."""
    path = path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches):
        tok, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for at, t in slices(b.column(1)):
                ids, offs = with_end(*tok.encode(t), end_id)
                n = np.diff(offs)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(t.n), pieces)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lead = n - (pieces - 1) * capacity  # the first piece is the shorter one
                length = np.where(k == 0, lead[doc], capacity)
                start = np.where(k == 0, 0, lead[doc] + (k - 1) * capacity)
                raw = memoryview(ids.astype("<u4")).cast("B")
                a = (offs[doc] + start).tolist()
                crc = [zlib.crc32(raw[4 * s : 4 * (s + m)]) for s, m in zip(a, length.tolist())]
                o = np.argsort(length, kind="stable")
                by = length[o]
                new = np.r_[True, by[1:] != by[:-1]] if len(by) else np.zeros(0, bool)
                lead_at = np.flatnonzero(new)
                rank = np.empty(len(by), np.int64)
                rank[o] = np.arange(len(by)) - np.repeat(lead_at, np.diff(np.r_[lead_at, len(by)])) + seen[by]
                seen += np.bincount(length, minlength=capacity + 1)
                yield b.column(0).take(_index(doc + at)), k, start, length, crc, np.full(len(doc), part), rank

    return map_arrow(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def _index(a):
    import pyarrow as pa

    return pa.array(a, pa.int64())


class Plan:
    """slots[length]: (from rank, base sequence, offset) in rank order."""

    def __init__(self, counts: dict[int, int], capacity: int = 1024, most_docs: int | None = None, most_attention: int | None = None, weights=(1.0, 0.05, 0.05), score: str = "residual"):
        self.limit = np.float64([capacity, most_docs or capacity, most_attention or capacity * capacity])
        self.weights, self.score, self.sequences = np.float64(weights), score, 0
        self.slots: dict[int, list[tuple[int, int, int]]] = {}
        self.left = np.zeros((0, 3))  # residual capacities of each class
        self.classes: list[list[tuple[int, int]]] = []  # ranges of sequences: (base, count)
        self.where: dict[tuple, int] = {}
        for length in sorted(counts, reverse=True):
            self._place(length, counts[length])

    def _class(self, left: tuple) -> int:
        if left not in self.where:
            self.where[left] = len(self.classes)
            self.classes.append([])
            if len(self.classes) > len(self.left):
                self.left = np.concatenate([self.left, np.full((max(64, len(self.left)), 3), -1.0)])
            self.left[self.where[left]] = left
        return self.where[left]

    def _best(self, need: np.ndarray) -> int | None:
        rest = self.left - need
        fits = (rest >= 0).all(1)
        if not fits.any():
            return None
        rest = rest / self.limit
        if self.score == "residual":
            value = ((rest * self.weights) ** 2).sum(1)
        else:
            value = -((self.left / self.limit) * (need / self.limit) * self.weights).sum(1)
        return int(np.argmin(np.where(fits, value, np.inf)))

    def _place(self, length: int, count: int) -> None:
        need, rank, out = np.float64([length, 1, length * length]), 0, []
        if (need > self.limit).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while rank < count:
            k = self._best(need)
            if k is None:
                each = int(max(1, np.min(self.limit // need)))
                base, n = self.sequences, max(1, (count - rank) // each)
                self.sequences += n
                self.classes[k := self._class(tuple(self.limit))].append((base, n))
            base, n = self.classes[k].pop()
            left = self.left[k].copy()
            # a sequence that took a piece has the least residual of all for the next one alike, until it is full; by dot product it has a lesser one than the rest of its class
            each = int(max(1, np.min(left // need))) if self.score == "residual" else 1
            take = min(n, max(1, (count - rank) // each))
            if take < n:
                self.classes[k].append((base + take, n - take))
            if not self.classes[k]:
                del self.where[tuple(left)]
                self.left[k] = -1
            out.append((rank, base, int(self.limit[0] - left[0])))
            rank += take
            self._join(tuple(left - need), (base, take))
        self.slots[length] = out

    def _join(self, left: tuple, part: tuple[int, int]) -> None:
        if left[0] > 0 and left[1] > 0:
            self.classes[self._class(left)].append(part)

    def arrays(self) -> dict[int, np.ndarray]:
        return {k: np.int64(v) for k, v in self.slots.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, capacity: int = 1024, most_docs: int | None = None, most_attention: int | None = None, weights=(1.0, 0.05, 0.05), score: str = "residual") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = saved(token_pieces(docs, id_col, text_col, path, end_id, capacity), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("length", "part", "before")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots = Plan(total, capacity, most_docs, most_attention, weights, score).arrays()

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                i = np.flatnonzero(length == x)
                own = slots[x]
                k = np.searchsorted(own[:, 0], rank[i], "right") - 1
                seq[i], offset[i] = own[k, 1] + rank[i] - own[k, 0], own[k, 2]
            yield *(b.column(c) for c in range(5)), seq, offset

    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
