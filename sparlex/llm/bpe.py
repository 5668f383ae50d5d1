"""Byte-level BPE over slices of texts: each distinct chunk is encoded once by the tokenizers library.

A chunk is white space and the word behind it. The pre-tokeniser's pattern never matches
across the end of a word before white space, nor from an ASCII letter to a comma or the like
(where a chunk ends too), so chunks are encoded independently and the ids are those of the
whole text. Texts with white space outside ASCII are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .arrays import TRIMMED, Known, Texts

WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
MOST_CHUNKS = 2_000_000
LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
STOP[list(b",.;:!?)")] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.vocab = self.tok.get_vocab_size()
        self.known = Known(MOST_CHUNKS)

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        t.words()
        mark = np.zeros(len(t.buf) + 1, bool)
        mark[t.end] = mark[t.offs[1:]] = True
        mark[1:-1] |= LETTER[t.buf[:-1]] & STOP[t.buf[1:]]
        mark[0] = False
        ends = np.flatnonzero(mark)
        for m in list(WIDE_SPACE.finditer(t.buf.data if t.buf.flags.c_contiguous else t.buf.tobytes())) if len(t.buf) else []:
            k = int(np.searchsorted(t.offs, m.start(), "right")) - 1
            if len(ends) == 0 or ends[np.searchsorted(ends, m.end())] != t.offs[k + 1]:
                ends = ends[(ends <= t.offs[k]) | (ends >= t.offs[k + 1])]
        start = np.r_[0, ends[:-1]] if len(ends) else ends

        def learn(i):
            out = self.tok.encode_batch_fast([t.raw(s, e).decode("utf-8", "replace") for s, e in zip(start[i].tolist(), ends[i].tolist())], add_special_tokens=False)
            ids = [x.ids for x in out]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size

        ids, total = self.known.spell(self.known.rows(t.buf, start, ends, np.zeros(len(ends), np.uint8), learn))
        return ids, total[np.searchsorted(ends, t.offs, "right")]


class Encoders(dict):
    """A worker's encoders by path; they go at the end of a task that used none, as the worker then does another step's work."""

    used = False

    def __missing__(self, path: str) -> Encoder:
        self[path] = Encoder(path)
        return self[path]

    def clear(self):
        if not self.used:
            super().clear()
        self.used = False


_ENCODERS = Encoders()
TRIMMED.append(_ENCODERS)


def encoder(path: str) -> Encoder:
    """One for each worker, so that chunks stay known from task to task of a step."""
    _ENCODERS.used = True
    return _ENCODERS[path]


def with_end(ids: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id behind each text's ids."""
    n = len(offs) - 1
    out = np.empty(len(ids) + n, np.int32)
    ends = offs[1:] + np.arange(n)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask], out[ends] = ids, end_id
    return out, offs + np.arange(n + 1)
