"""SentencePiece encoding and decoding by suffix-array matching (BPE models).

Encoding a batch of texts: its distinct segments not met before are written one after another
into a text that is indexed by a suffix array (prefix doubling up to the longest piece); every
vocabulary piece is binary-searched for its range of suffixes, all pieces at once; the ranges
are the edges (place, length, piece), which are sorted by place; then the segments are relaxed
over their edges: of the neighbouring symbols whose union is an edge, the one with the best
score (the leftmost of equals) is joined, in all segments side by side, until none is left.

A segment begins at each space that doesn't follow a space: no piece of the model goes on from
another character into the meta symbol (checked when the model is read), so none spans a
beginning. One begins, too, between two ASCII characters that stand together in no piece. Characters left without a piece become byte pieces, or the unknown piece.

Defined results: null and empty texts have no pieces; a decoded null is the empty text; repeated
rows are encoded alike; of pieces with equal scores the leftmost is joined; a very long text is a
slice of its own, and one unbroken segment of any length is joined by a queue in n log n; an empty
table gives an empty table; further columns, whatever their names, are carried in ``row``.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Known, Texts, slices
from .common import column, map_arrow, strings

BREAK = 0x110000  # stands between indexed segments
INDEX_CHARS, MOST_SEGMENTS, LONG = 1 << 20, 1_000_000, 48
DECODED_IDS = 1 << 20
_MODELS: dict[str, "Model"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text in the order of the depth characters from each."""
    order = np.argsort(text, kind="stable")
    rank = np.empty(len(text), np.int64)
    new = np.r_[0, np.cumsum(text[order][1:] != text[order][:-1])] if len(text) else order
    rank[order] = new
    have = 1
    while have < depth and len(text):
        second = np.zeros(len(text), np.int64)
        second[:-have] = rank[have:] + 1
        key = rank * (len(text) + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        have *= 2
    return order


class _Sorted:
    """Values of sorted keys, -1 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = np.r_[keys, np.iinfo(np.int64).max], np.r_[values, np.int32(-1)]

    def __getitem__(self, asked):
        at = np.searchsorted(self.keys, asked)
        return np.where(self.keys[at] == asked, self.values[at], -1)


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not read")
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        if any("▁" in self.pieces[i].lstrip("▁") for i in plain):
            raise ValueError("a piece goes on over the start of a word")
        if sp.encode("a  b", out_type=str)[0][:1] != "▁" or sp.decode(sp.encode("a  b")) != "a  b":
            raise ValueError("only models with a dummy prefix that keep white space are read")
        self.unknown = sp.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.score = np.float64([sp.get_score(i) for i in range(n)])
        self.single = {self.pieces[i]: i for i in plain if len(self.pieces[i]) == 1}
        self.longest = max(len(self.pieces[i]) for i in plain)
        plain = [i for i in plain if len(self.pieces[i]) > 1]
        self.apart = np.zeros((256, 256), bool)  # ASCII neighbours that no piece holds
        self.apart[33:127, 33:127] = True
        for i in plain:
            for x, y in zip(self.pieces[i], self.pieces[i][1:]):
                if max(x, y) < "\x7f":
                    self.apart[ord(x), ord(y)] = False
        self.ids = np.int32(plain)
        self.length = np.int64([len(self.pieces[i]) for i in plain])
        self.chars = np.zeros((len(plain), self.longest), np.int64)
        for k, i in enumerate(plain):
            self.chars[k, : self.length[k]] = [ord(c) for c in self.pieces[i]]
        raw = []
        for i in range(n):
            raw.append(bytes([int(self.pieces[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else self.pieces[i].replace("▁", " ").encode())
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.int64([len(x) for x in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.known = Known(MOST_SEGMENTS)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of all occurrences of the pieces of two characters and more, by place."""
        order = suffix_array(text, self.longest)
        padded = np.r_[text, np.full(self.longest, -1, text.dtype)].astype(np.int64)

        def bound(after: bool) -> np.ndarray:
            low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(order))
            live = np.arange(len(self.ids))
            while len(live):
                mid = (low[live] + high[live]) // 2
                at, go = order[mid], np.zeros(len(live), np.int8)
                for c in range(self.longest):
                    open_ = np.flatnonzero((go == 0) & (c < self.length[live]))
                    if not len(open_):
                        break
                    x, y = padded[at[open_] + c], self.chars[live[open_], c]
                    go[open_] = np.where(x < y, -1, np.where(x > y, 1, 0))
                right = (go < 0) | (after & (go == 0))
                low[live[right]] = mid[right] + 1
                high[live[~right]] = mid[~right]
                live = live[low[live] < high[live]]
            return low

        first, last = bound(False), bound(True)
        count = np.maximum(0, last - first)
        to = np.cumsum(count)
        piece = np.repeat(np.arange(len(count)), count)
        place = order[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(first - (to - count), count)]
        by = np.lexsort((self.length[piece], place))
        return place[by], self.length[piece[by]], self.ids[piece[by]]

    def relax(self, text: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Pieces (start, end, id or -1) as arrays, of segments text[first[i]:first[i + 1] - 1]; each is followed by BREAK."""
        place, length, piece = self.edges(text)
        wide = self.longest + 1
        if len(text) <= 2 * INDEX_CHARS:
            table = np.full((len(text) + 1) * wide, -1, np.int32)
            table[place * wide + length] = piece
        else:  # one very long segment: by binary search among the sorted edges
            table = _Sorted(place * wide + length, piece)

        def joined(start, end):
            size = end - start
            return np.where(size <= self.longest, table[start * wide + np.minimum(size, self.longest)], -1)

        lens = np.diff(first) - 1
        done: list[tuple] = []
        for i in np.flatnonzero(lens > LONG).tolist():
            s, e, _ = self._heap(table, int(first[i]), int(first[i + 1]) - 1)
            done.append((np.full(len(s), i), s, e))
        short = np.flatnonzero((lens <= LONG) & (lens > 0))
        seg = np.repeat(short, lens[short])
        start = np.arange(len(seg)) + np.repeat(first[short] - (np.cumsum(lens[short]) - lens[short]), lens[short])
        end = start + 1
        while len(seg):
            pair = np.full(len(seg), -1, np.int32)
            pair[:-1] = np.where(seg[1:] == seg[:-1], joined(start[:-1], end[1:]), -1)
            value = np.where(pair >= 0, self.score[pair], -np.inf)
            lead = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            n = np.diff(np.r_[lead, len(seg)])
            best = np.maximum.reduceat(value, lead)
            hit = np.flatnonzero((value == np.repeat(best, n)) & (value > -np.inf))
            hit = hit[np.r_[True, seg[hit][1:] != seg[hit][:-1]]] if len(hit) else hit  # the leftmost
            over = np.repeat(best == -np.inf, n)
            done.append((seg[over], start[over], end[over]))
            end[hit] = end[hit + 1]
            keep = ~over
            keep[hit + 1] = False
            seg, start, end = seg[keep], start[keep], end[keep]
        seg, start, end = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        o = np.argsort(start, kind="stable")
        seg, start, end = seg[o], start[o], end[o]
        return [seg, start, end, np.where(end - start > 1, joined(start, end), -1)]

    def _heap(self, table, a: int, b: int):
        """A long segment's symbols, joined by a queue: n log n."""
        wide, n = self.longest + 1, b - a
        end, prev, nxt, alive = np.arange(a + 1, b + 1), list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        queue: list = []

        def offer(i):
            j = nxt[i]
            if j >= 0 and (size := int(end[j]) - (a + i)) <= self.longest and (p := int(table[(a + i) * wide + size])) >= 0:
                heapq.heappush(queue, (-self.score[p], i, int(end[i]), int(end[j])))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, e, f = heapq.heappop(queue)
            j = nxt[i]
            if not alive[i] or end[i] != e or j < 0 or end[j] != f:
                continue
            end[i], nxt[i], alive[j] = f, nxt[j], False
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        left = np.flatnonzero(alive)
        return left + a, end[left], None

    def _learn(self, t: Texts, start, end, meta):
        """(ids of the segments one after another, how many each has)."""
        texts = [("▁" if m else "") + t.raw(s, e).decode("utf-8", "replace").replace(" ", "▁") for s, e, m in zip(start.tolist(), end.tolist(), meta.tolist())]
        at = 0
        ids_of, sizes = [], np.zeros(len(texts), np.int64)
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) < INDEX_CHARS):
                chars += len(texts[to]) + 1
                to += 1
            lens = np.fromiter(map(len, texts[at:to]), np.int64, to - at)
            first = np.r_[0, np.cumsum(lens + 1)]
            flat = np.full(first[-1], BREAK, np.int64)
            inside = np.ones(first[-1], bool)
            inside[first[1:] - 1] = False
            flat[inside] = np.frombuffer("".join(texts[at:to]).encode("utf-32-le"), np.uint32)
            seg, s, e, piece = self.relax(flat, first)
            one = np.flatnonzero(piece < 0)
            cp = flat[s[one]]
            u, back = np.unique(cp, return_inverse=True)
            single = np.int64([self.single.get(chr(c), -1) for c in u])
            piece = piece.astype(np.int64)
            piece[one] = single[back]
            size = np.ones(len(piece), np.int64)
            lost = np.flatnonzero(piece < 0)
            if len(lost):
                wholes = texts[at:to]
                spelled = [self._spell(wholes[seg[k]][int(s[k] - first[seg[k]])]) for k in lost.tolist()]
                size[lost] = [len(x) for x in spelled]
            out = np.repeat(piece, size)
            if len(lost):
                ends = np.cumsum(size)
                for k, x in zip(lost.tolist(), spelled):
                    out[ends[k] - size[k] : ends[k]] = x
            ids_of.append(out)
            sizes[at:to] = np.bincount(seg, size, minlength=to - at)
            at = to
        return np.concatenate(ids_of) if ids_of else np.zeros(0, np.int64), sizes

    def _spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        blank = t.buf == 32
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        if len(t.buf) > 3:  # a meta symbol in the text is like a space
            starts[3:] &= ~((t.buf[:-3] == 0xE2) & (t.buf[1:-2] == 0x96) & (t.buf[2:-1] == 0x81))
        lead = t.offs[:-1][np.diff(t.offs) > 0]
        raw_start = np.zeros(len(t.buf) + 1, bool)
        raw_start[np.flatnonzero(starts)] = True
        raw_start[lead] = True
        meta = raw_start[:-1].copy()
        raw_start[1:-1] |= self.apart[t.buf[:-1], t.buf[1:]]
        begin = np.flatnonzero(raw_start[:-1])
        meta = meta[begin]
        end = np.r_[begin[1:], len(t.buf)] if len(begin) else begin
        doc_start = np.zeros(len(t.buf) + 1, bool)
        doc_start[lead] = True
        # a text that begins with a space keeps it behind the dummy prefix; elsewhere the space is the meta symbol
        inner = begin + (meta & ~doc_start[begin])
        rows = self.known.rows(t.buf, inner, end, meta, lambda i: self._learn(t, inner[i], end[i], meta[i]))
        ids, total = self.known.spell(rows)
        return ids, total[np.searchsorted(begin, t.offs)]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts that the ids spell."""
        size = self.raw_size[ids].copy()
        at = self.raw_at[ids]
        lead = offs[:-1][np.diff(offs) > 0]
        dummy = lead[(size[lead] > 0) & (self.raw[np.minimum(at[lead], len(self.raw) - 1)] == 32)]
        at[dummy] += 1
        size[dummy] -= 1
        total = np.r_[0, np.cumsum(size)]
        return self.raw[np.repeat(at - total[:-1], size) + np.arange(total[-1])], total[offs]


def model(path: str) -> Model:
    """One for each worker, so that segments stay known from task to task."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def sp_encode(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """row (struct of the kept columns), ids (array<int>), ids_crc32 (of the ids as little-endian 32-bit integers)."""
    path = path or default_path()
    names = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*map(column, names)).alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        sp = model(path)
        for b in batches:
            for at, t in slices(b.column(1)):
                ids, offs = sp.encode(t)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
                yield b.column(0).slice(at, t.n), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32())), crc

    return map_arrow(rows, run, "ids array<int>, ids_crc32 long", row=rows.schema["row"].dataType)


def sp_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of sp_encode and text, decoded from ids."""
    path = path or default_path()

    def run(batches):
        sp = model(path)
        for b in batches:
            n, at = np.r_[0, np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy().astype(np.int64))], 0
            while at < b.num_rows:  # rows of a bounded number of ids, one at least: their bytes have 32-bit offsets
                to = max(at + 1, int(np.searchsorted(n, n[at] + DECODED_IDS, "right")) - 1)
                part = b.slice(at, to - at)
                raw, ends = sp.decode(part.column(1).flatten().to_numpy(), n[at : to + 1] - n[at])
                yield *(part.column(k) for k in range(3)), strings(raw, ends)
                at = to

    return map_arrow(encoded, run, "ids array<int>, ids_crc32 long, text string", row=encoded.schema["row"].dataType)
