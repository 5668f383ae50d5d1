"""Token ids in fixed-width bit-packed files.

File: magic, then little-endian u32 bits a id, u32 ids a block, u64 documents, u64 ids;
int64 document ids; u64 document starts (documents + 1); u64 block starts in bytes, from
the first block (blocks + 1); the blocks. Each block holds ids at the least bits that the
vocabulary needs, lowest bits first, and begins on a byte, so any range of ids is read by
its blocks alone, and unpacks by vectors: eight ids take as many bytes as an id has bits.

Documents stand in ascending id order over all files (range partitions, sorted). Null ids
come first (stored as the least int64 and returned as null); rows that repeat an id are
separate documents, ordered by text; a null or empty text is the end id alone; a very
long text may be a file of its own; an empty table writes no file; further columns are
not read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import SLICE_BYTES, slices
from .bpe import default_path, encoder, with_end
from .common import map_arrow, shared_dir, utf8_bytes
from .files import opened, written

MAGIC, HEAD, NONE = b"SPXIDS01", struct.Struct("<8sIIQQ"), np.iinfo(np.int64).min


def bits_for(vocab: int) -> int:
    return max(1, int(vocab - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """ids at bits each, lowest bits first; the last byte is filled with zeros."""
    n = len(ids)
    x = np.zeros(-(-n // 8) * 8, np.uint64)
    x[:n] = ids
    x = x.reshape(-1, 8)
    out = np.zeros((len(x), bits), np.uint8)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        value = x[:, k] << np.uint64(shift)
        for j in range((shift + bits + 7) // 8):
            out[:, at + j] |= ((value >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: (n * bits + 7) // 8]


def unpack_ids(data: bytes, n: int, bits: int) -> np.ndarray:
    groups = -(-n // 8)
    raw = np.zeros(groups * bits + 8, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    raw = raw[: groups * bits].reshape(groups, bits)
    out = np.zeros((groups, 8), np.uint64)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        for j in range((shift + bits + 7) // 8):
            out[:, k] |= raw[:, at + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] >>= np.uint64(shift)
    return (out.reshape(-1)[:n] & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_file(uri: str, doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int, block: int) -> None:
    sizes = [len(ids[a : a + block]) for a in range(0, len(ids), block)]
    with written(uri) as out:
        out.write(HEAD.pack(MAGIC, bits, block, len(doc_ids), len(ids)))
        out.write(doc_ids.astype("<i8").tobytes() + starts.astype("<u8").tobytes())
        out.write(np.cumsum([0] + [(n * bits + 7) // 8 for n in sizes]).astype("<u8").tobytes())
        for a in range(0, len(ids), block):
            out.write(pack_ids(ids[a : a + block], bits))


class IdFile:
    """Random access to a file's ids."""

    def __init__(self, uri: str):
        self.f = opened(uri)
        magic, self.bits, self.block, self.docs, self.n = HEAD.unpack(self.f.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.doc_ids = np.frombuffer(self.f.read(8 * self.docs), "<i8")
        self.starts = np.frombuffer(self.f.read(8 * (self.docs + 1)), "<u8").astype(np.int64)
        blocks = -(-self.n // self.block)
        self.blocks = np.frombuffer(self.f.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.base = HEAD.size + 8 * (2 * self.docs + 1 + blocks + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-end // self.block)
        self.f.seek(self.base + int(self.blocks[a]))
        data = self.f.read(int(self.blocks[b] - self.blocks[a]))
        out = [unpack_ids(data[int(self.blocks[k] - self.blocks[a]) : int(self.blocks[k + 1] - self.blocks[a])], min(self.block, self.n - k * self.block), self.bits) for k in range(a, b)]
        return np.concatenate(out)[start - a * self.block : end - a * self.block]


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, block: int = 1 << 16, ids_per_file: int = 1 << 23, folder: str | None = None) -> list[tuple[str, int, int]]:
    """(uri, first id's place over all files, ids) of the files, in order."""
    path, folder = path or default_path(), folder or shared_dir(docs.sparkSession, "ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, min(1 << 16, -(-utf8_bytes(rows) // (24 << 20))))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        tok, part, made = encoder(path), TaskContext.get().partitionId(), []
        bits, held, have = bits_for(max(tok.vocab, end_id + 1)), [], 0

        def close():
            doc_ids = np.concatenate([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held])
            starts = np.r_[0, np.cumsum(np.concatenate([x[2] for x in held]))]
            uri = f"{folder}/part-{part:06d}-{len(made):05d}.ids"
            write_file(uri, doc_ids, starts, ids, bits, block)
            made.append((uri, len(made), len(ids)))

        for b in batches:
            own = b.column(0).fill_null(int(NONE)).to_numpy()
            for at, t in slices(b.column(1), min(SLICE_BYTES, 4 * ids_per_file)):
                ids, offs = with_end(*tok.encode(t), end_id)
                held.append((own[at : at + t.n], ids, np.diff(offs)))
                have += len(ids)
                if have >= ids_per_file:
                    close()
                    held, have = [], 0
        if held:
            close()
        if made:
            yield [part] * len(made), [x[0] for x in made], [x[1] for x in made], [x[2] for x in made]

    files = sorted((r.part, r.k, r.uri, r.n) for r in map_arrow(rows, write, "part int, uri string, k int, n long").collect())
    starts = np.cumsum([0] + [f[3] for f in files])
    return [(f[2], int(s), f[3]) for f, s in zip(files, starts)]


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (over all files), ids (array) is what a file holds; here with n_tokens and ids_crc32 in place of the ids."""
    todo = spark.createDataFrame(files, "uri string, start long, n long").repartition(max(1, min(len(files), 1 << 16)), "uri")

    def read(batches):
        for b in batches:
            for uri, base, _ in zip(*(b.column(c).to_pylist() for c in range(3))):
                f = IdFile(uri)
                ids = f.ids(0, f.n).astype("<u4")
                at, raw = f.starts, memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.array(f.doc_ids, mask=f.doc_ids == NONE), base + at[:-1], np.diff(at), crc

    return map_arrow(todo, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


