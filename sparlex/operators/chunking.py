"""Chunkers: sequential packing of a document's spans, one document at a time inside Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]
WORD = re.compile(r"\S+")
SPACE = np.array([*(chr(i).isspace() for i in range(0x3001)), False])  # by code point; none lies beyond U+3000
SHORT = 256  # characters below which a regular expression is faster than arrays
DOCS, OUT_ROWS, OUT_CHARS = 256, 4096, 4 << 20  # documents taken from a batch at once; rows and characters given at once
SENTENCE_END = re.compile(r'(?<=[.!?])\s+(?=[A-Z(\["“])')
# Words whose full stop ends no sentence.
ABBREVIATIONS = frozenset({
    "fig", "figs", "eq", "eqs", "tab", "tabs", "ref", "refs", "sec", "secs", "al", "cf", "vs", "no", "nos", "etc", "approx", "e.g", "i.e", "resp",
    "dr", "mr", "mrs", "ms", "prof", "inc", "ltd", "co", "vol", "pp",
})
SPECIALS = 2  # tokens that a model adds to each text


def content_tokens(text: str) -> int:
    """The default counter: ceil(n / 4) tokens for a word of n characters."""
    if len(text) < SHORT:
        return sum(-(-len(w) // 4) for w in text.split())
    starts, ends = word_bounds(text)
    return int(((ends - starts + 3) // 4).sum())


Counter = Callable[[str], int]  # tokens of a text's content; additive over white space


class Words:
    """The words of a text with the tokens before each, so that any span's tokens are two binary searches."""

    last: tuple[str, Words] | None = None

    def __init__(self, text: str, counter: Counter = content_tokens):
        starts, ends = word_bounds(text)
        self.starts, self.ends = starts.tolist(), ends.tolist()
        if counter is content_tokens:
            self.before = [0, *np.cumsum((ends - starts + 3) // 4).tolist()]
        else:
            self.before = [0, *accumulate(counter(text[a:b]) for a, b in zip(self.starts, self.ends))]

    @classmethod
    def of(cls, text: str) -> Words:
        """Those of the last text are kept, for what reads one text more than once."""
        if cls.last is None or cls.last[0] is not text:
            cls.last = (text, cls(text))
        return cls.last[1]

    def between(self, start: int, end: int) -> tuple[int, int]:
        """First word from start on, first word from end on."""
        return bisect_left(self.starts, start), bisect_left(self.starts, end)

    def tokens(self, start: int, end: int) -> int:
        i, j = self.between(start, end)
        return self.before[j] - self.before[i]


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    codes = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(SPACE) - 1)
    black = np.zeros(len(codes) + 2, bool)
    np.logical_not(SPACE[codes], out=black[1:-1])
    edges = np.flatnonzero(black[1:] != black[:-1])
    return edges[::2], edges[1::2]


def word_spans(text: str) -> list[Span]:
    if len(text) < SHORT:
        return [m.span() for m in WORD.finditer(text)]
    starts, ends = word_bounds(text)
    return list(zip(starts.tolist(), ends.tolist()))


def sentence_spans(text: str) -> list[Span]:
    """Sentences that tile the text: white space stays with the sentence before it; no cut after an abbreviation."""
    cuts = [0] if text else []
    for gap in SENTENCE_END.finditer(text):
        last = text[cuts[-1] : gap.start()].split()[-1:]
        if not last or last[0].rstrip(".").lower() not in ABBREVIATIONS:
            cuts.append(gap.end())
    return list(zip(cuts, [*cuts[1:], len(text)]))


def pack(spans: list[Span], sizes: list[int], budget: int, overlap: int = 0) -> list[Span]:
    """Greatest windows of spans within the budget (one span at least), each reaching back over the overlap."""
    return windows([a for a, _ in spans], [b for _, b in spans], [0, *accumulate(sizes)], budget, overlap)


def windows(starts: list[int], ends: list[int], total: list[int], budget: int, overlap: int = 0) -> list[Span]:
    """As pack, from bounds and the tokens before each span and before the end.

    With prefix sums a window's end and its successor's start are both binary searches.
    """
    out, i, n = [], 0, len(starts)
    while i < n:
        end = max(i + 1, bisect_right(total, total[i] + budget, i) - 1)
        out.append((starts[i], ends[end - 1]))
        if end >= n:
            break
        i = max(i + 1, bisect_right(total, total[end] - overlap, 0, end + 1) - 1) if overlap > 0 else end
    return out


def fixed_chunks(text: str, max_tokens: int = 400, overlap: int = 60, counter: Counter = content_tokens) -> list[Span]:
    if overlap >= max_tokens:
        raise ValueError("the overlap must be smaller than the chunk")
    words = Words.of(text) if counter is content_tokens else Words(text, counter)
    return windows(words.starts, words.ends, words.before, max_tokens - SPECIALS, overlap)


def window_chunks(text: str, size: int = 60) -> list[Span]:
    """Runs of so many words."""
    spans = word_spans(text)
    return [(spans[i][0], spans[min(i + size, len(spans)) - 1][1]) for i in range(0, len(spans), size)]


def line_chunks(text: str) -> list[Span]:
    ends = [*accumulate(len(line) + 1 for line in text.split("\n"))]
    return [(a, b - 1) for a, b in zip([0, *ends], ends) if b - 1 > a]


def pieces(text: str, words: Words, start: int, end: int, budget: int) -> list[Span]:
    """A span as runs of whole sentences within the budget; where one sentence is over it, as runs of its words.

    Every boundary between sentences is known by the tokens before it, so a run's end is a binary search among them.
    """
    bounds = [start + a for a, _ in sentence_spans(text[start:end])] + [end]
    before, out, i = [words.before[bisect_left(words.starts, x)] for x in bounds], [], 0
    while i < len(bounds) - 1:
        j = bisect_right(before, before[i] + budget, i + 1) - 1
        if j > i:
            out.append((bounds[i], bounds[j]))
            i = j
        else:
            p, q = words.between(bounds[i], bounds[i + 1])
            out += windows(words.starts[p:q], words.ends[p:q], words.before[p : q + 1], budget)
            i += 1
    return out


def section_chunks(text: str, units: list[tuple[str, str | None, int, int]], max_tokens: int = 400, min_tokens: int = 50, counter: Counter = content_tokens) -> list[Span]:
    """Chunks that keep to units (type, heading, start, end): long ones are split, small neighbours joined.

    A neighbour may be joined for one of two reasons, each a key that both sides must share: pieces of one unit (its
    number), and whole units that follow one another under one known heading. Captions have no key and stand alone.
    The smaller side must be under min_tokens and both together within max_tokens.
    """
    words = Words.of(text) if counter is content_tokens else Words(text, counter)
    spans: list[Span] = []
    unit_key = heading_key = None  # of the last span
    for no, (kind, heading, start, end) in enumerate(units):
        whole = words.tokens(start, end) + SPECIALS <= max_tokens
        for a, b in [(start, end)] if whole else pieces(text, words, start, end, max_tokens - SPECIALS):
            own_unit, own_heading = (None, None) if kind == "caption" else (no, heading if whole else None)
            shared = (own_unit is not None and own_unit == unit_key) or (own_heading is not None and own_heading == heading_key)
            if shared:
                sizes = [words.tokens(x, y) + SPECIALS for x, y in (spans[-1], (a, b), (spans[-1][0], b))]
                shared = min(sizes[:2]) < min_tokens and sizes[2] <= max_tokens
            if shared:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
            unit_key, heading_key = own_unit, own_heading
    return spans


def line_units(text: str) -> list[tuple[str, str | None, int, int]]:
    """A text without markup as units, a line each: the first is its abstract, every seventh from the fourth on a caption, five share a heading."""
    out, at = [], 0
    for pos, line in enumerate(text.split("\n")):
        if line.strip():
            out.append(("abstract" if pos == 0 else "caption" if pos % 7 == 3 else "section", f"H{pos // 5}", at, at + len(line)))
        at += len(line) + 1
    return out


# Strategies by name: each takes a text and returns its chunks' spans. Others can be added.
CHUNKERS: dict[str, Callable[[str], list[Span]]] = {"fixed": fixed_chunks, "section_aware": lambda text: section_chunks(text, line_units(text))}


def checked(text: str, start: int, end: int, expected: str | None = None) -> str:
    """The slice of a chunk; spans outside the text, empty ones and a slice other than expected are errors."""
    if not 0 <= start < end <= len(text):
        raise ValueError(f"the span {start}-{end} does not lie in a text of {len(text)} characters")
    if expected is not None and text[start:end] != expected:
        raise ValueError(f"the text at {start}-{end} is not the one expected")
    return text[start:end]


COLUMNS = {"paper_id": "long", "chunker": "string", "kept": "boolean", "chunk_no": "int", "char_start": "int", "char_end": "int", "n_tokens": "int", "text": "string"}
ARROW = dict(zip(COLUMNS, (pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())))


def chunk_batches(batches: Iterator[pa.RecordBatch], chunker: str, cut: Callable, min_tokens: int = 0, counter: Counter = content_tokens, columns: tuple[str, ...] = tuple(COLUMNS)) -> Iterator[pa.RecordBatch]:
    """columns of the chunks of batches (paper_id, text, what else cut takes), OUT_ROWS rows or OUT_CHARS characters at a time, whatever the sizes of batches and texts."""
    at = [list(COLUMNS).index(c) for c in columns]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], ARROW[c]) for k, c in zip(at, columns)], names=list(columns))

    out, size, with_text = [], 0, "text" in columns
    for batch in batches:
        for s in range(0, batch.num_rows, DOCS):
            for row in zip(*(c.to_pylist() for c in batch.slice(s, DOCS).columns)):
                text = row[1] or ""
                numbers = {True: 0, False: 0}
                for a, b in cut(text, *row[2:]):
                    piece = checked(text, a, b)
                    whole = counter is content_tokens and len(text) >= SHORT and all(x in (0, len(text)) or text[x].isspace() or text[x - 1].isspace() for x in (a, b))  # no word is cut
                    n = (Words.of(text).tokens(a, b) if whole else counter(piece)) + SPECIALS
                    keep = n >= min_tokens
                    out.append((row[0], chunker, keep, numbers[keep], a, b, n, piece if with_text else None))
                    numbers[keep] += 1
                    size += len(piece) * with_text
                    if len(out) >= OUT_ROWS or size >= OUT_CHARS:
                        yield made(out)
                        out, size = [], 0
    if out:
        yield made(out)


def chunk_documents(docs: DataFrame, chunker: str, cut: Callable, extra: str | None = None, min_tokens: int = 0, counter: Counter = content_tokens, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """paper_id, chunker, kept, chunk_no, char_start, char_end, n_tokens, text of every chunk, or those of them that columns names.

    cut takes a text (and the extra column's value) and returns spans; chunks under min_tokens are numbered apart, as not kept.
    """
    run = lambda batches: chunk_batches(batches, chunker, cut, min_tokens, counter, columns)
    return docs.select("paper_id", "text", *([extra] if extra else [])).mapInArrow(run, ", ".join(f"{c} {COLUMNS[c]}" for c in columns))


def word_sums(docs: DataFrame, counter: Counter = content_tokens) -> DataFrame:
    """paper_id, n, starts, ends, tokens: the number of a document's words and the sums of their bounds and tokens; documents without words are left out.

    A row a document leaves its task, not one a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                starts, ends = word_bounds(text)
                tokens = int(((ends - starts + 3) // 4).sum()) if counter is content_tokens else sum(counter(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist()))
                if len(starts):
                    rows.append((key, len(starts), int(starts.sum()), int(ends.sum()), tokens))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["paper_id", "n", "starts", "ends", "tokens"])

    parts = docs.select("paper_id", "text").mapInArrow(run, "paper_id long, n long, starts long, ends long, tokens long")
    return parts.groupBy("paper_id").agg(*[F.sum(c).alias(c) for c in ("n", "starts", "ends", "tokens")])  # rows that repeat an id are one document
