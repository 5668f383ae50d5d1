"""Byte and word arithmetic shared by the text operators: numpy over Arrow string buffers.

A *word* is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Texts are never
copied into Python strings here: words are (start, end) byte positions in one
buffer. Byte spans are hashed by eight bytes at a time, each mixed in without any
linear structure (spans up to eight bytes of a length never clash; those above
``LONG`` bytes go through blake2b); sequences of words by polynomials over these hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # texts are worked on in slices of about this size
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply, twice)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_SEEDS = mix(np.arange(1, 9, dtype=U64) * U64(0x9E3779B97F4A7C15))


def span_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans buf[start:end]; another seed gives hashes of their own."""
    n = end - start
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray(len(buf) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    h = mix(n.astype(U64) ^ _SEEDS[seed])
    live, at, left = None, start, n
    for k in range(LONG // 8):
        x = mix(h if live is None else h[live])
        x = mix((x ^ (eight[at] & _MASKS[np.minimum(left, 8)])) * U64(0xA0761D6478BD642F))
        if live is None:
            h = np.where(n > 0, x, h)
        else:
            h[live] = x
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


def same_bytes(a: np.ndarray, start: np.ndarray, b: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[start:start + size] and b[other:other + size] are equal, span by span."""
    out, step = np.ones(len(size), bool), 1 << 17
    for at in range(0, len(size), step):
        n = size[at : at + step]
        to = np.cumsum(n)
        inside = np.arange(int(to[-1])) - np.repeat(to - n, n)
        differ = a[np.repeat(start[at : at + step], n) + inside] != b[np.repeat(other[at : at + step], n) + inside]
        if differ.any():
            out[at + np.searchsorted(to, np.flatnonzero(differ), "right")] = False
    return out


TRIMMED: list = []  # what a worker need not keep from task to task


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        TRIMMED.append(self)
        self.clear()

    def clear(self):
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([[U64(1)], np.full(n, b, U64)])) for b in (self.base, self.inverse))
        return self.up, self.down


WORD_POWERS = Powers(0xA0761D6478BD642F)


def prefix_hash(values: np.ndarray, powers: Powers) -> np.ndarray:
    up, _ = powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of values[start:end]; equal sequences have equal hashes wherever they stand."""
    _, down = powers.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


class Texts:
    """A slice of texts: buf has the bytes, offs[i]:offs[i + 1] those of text i."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1

    def words(self) -> "Texts":
        """Adds start, end (byte positions) and first (text i has words first[i]:first[i + 1])."""
        space = SPACE[self.buf]
        word = ~space
        begins, ends = word.copy(), word.copy()
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        cut = self.offs[1:-1]
        cut = cut[(cut > 0) & (cut < len(self.buf))]
        begins[cut] |= word[cut]
        ends[cut - 1] |= word[cut - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offs)
        return self

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        """64-bit hashes of the words, or of other byte spans."""
        return span_keys(self.buf, self.start if start is None else start, self.end if end is None else end, seed)

    def raw(self, start: int, end: int) -> bytes:
        return self.buf[start:end].tobytes()


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(first row, Texts) over an Arrow string array; null counts as empty. A longer text is a slice of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, Texts(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


def windows(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """For each position up to total: whether size items from there stay within one text."""
    ok = np.zeros(total, bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    ok[:] = left >= size
    return ok


def sliding(values: np.ndarray, size: int, best=np.minimum) -> np.ndarray:
    """best over values[i:i + size], by doubling; the last size - 1 places see what is left."""
    out, have = values.copy(), 1
    while have < size:
        step = min(have, size - have)
        out[:-step] = best(out[:-step], out[step:])
        have += step
    return out


class Known:
    """What byte spans stand for (arrays of ids), kept from slice to slice. Spans are found by hash and compared byte by byte."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self):
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and where each one's span stands below
        self.at, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.size, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.raw, self.used, self.filled = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint8), 0, 0

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        return a if need <= len(a) else np.concatenate([a, np.zeros(max(need, len(a) + (len(a) >> 1)) - len(a), a.dtype)])

    def _add(self, buf, keys, start, end, ids, size):
        need, n = self.used + len(ids), end - start
        self.ids = self._room(self.ids, need)
        self.ids[self.used : need] = ids
        total = int(n.sum())
        self.raw = self._room(self.raw, self.filled + total)
        to = np.cumsum(n)
        self.raw[self.filled : self.filled + total] = buf[np.repeat(start - (to - n), n) + np.arange(total)]
        row = len(self.at) + np.arange(len(keys))
        self.at, self.size = np.r_[self.at, self.used + np.cumsum(size) - size], np.r_[self.size, size.astype(np.int32)]
        self.first, self.length = np.r_[self.first, self.filled + to - n], np.r_[self.length, n.astype(np.int32)]
        self.used, self.filled = need, self.filled + total
        to = np.searchsorted(self.keys, keys)
        self.keys, self.row = np.insert(self.keys, to, keys), np.insert(self.row, to, row)

    def rows(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, tag: np.ndarray, learn) -> np.ndarray:
        """The row of each span (spans of another tag, 0 or 1, stand for something else). learn(indexes) gives (ids, how many each) of new ones."""
        if len(self.keys) > self.most:
            self.clear()
        out, todo = np.full(len(start), -1), np.arange(len(start))
        for seed in range(len(_SEEDS)):  # a span that meets another one's hash goes on to the next family of hashes
            s, e = start[todo], end[todo]
            keys = span_keys(buf, s, e, seed) ^ (tag[todo].astype(np.uint64) * U64(0x2545F4914F6CDD1D))
            uniq, first, back = np.unique(keys, return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, uniq)
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
            if not known.all():
                new = first[~known]
                self._add(buf, uniq[~known], s[new], e[new], *learn(todo[new]))
                at = np.searchsorted(self.keys, uniq)
            row = self.row[at[back]]
            n = e - s
            ok = n == self.length[row]
            ok[ok] = same_bytes(buf, s[ok], self.raw, self.first[row[ok]], n[ok])
            out[todo[ok]] = row[ok]
            if ok.all():
                return out
            todo = todo[~ok]
        raise RuntimeError("spans that clash in every family of hashes")

    def spell(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows one after another, offsets by row)."""
        size = self.size[rows].astype(np.int64)
        total = np.r_[0, np.cumsum(size)]
        return self.ids[np.repeat(self.at[rows] - total[:-1], size) + np.arange(total[-1])], total


def codepoints(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets by text)."""
    raw = t.buf.tobytes()
    cp = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    offs = np.r_[0, np.cumsum((t.buf & 0xC0) != 0x80)][t.offs]
    if offs[-1] != len(cp):  # not valid UTF-8
        parts = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(t.offs[:-1], t.offs[1:])]
        cp, offs = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
    return cp, offs


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values[offs[i]:offs[i + 1]] in double precision; 0 for empty spans."""
    out, some = np.zeros(len(offs) - 1), np.flatnonzero(np.diff(offs))
    if len(some):
        out[some] = np.add.reduceat(values, offs[some], dtype=np.float64)
    return out


_LOWER: list[np.ndarray] = []


def lower_table() -> np.ndarray:
    """Lower case of every code point, where that is one code point."""
    if not _LOWER:
        table = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x20000):
            if not 0xD800 <= i < 0xE000 and len(x := chr(i).lower()) == 1:
                table[i] = ord(x)
        _LOWER.append(table)
    return _LOWER[0]


_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[: 0x40000] = [not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x40000)]
        _LETTERS.append(table)
    return _LETTERS[0]
