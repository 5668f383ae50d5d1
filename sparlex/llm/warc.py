"""WARC: records written as gzip members with revisits, and a splittable reader.

Reader: a task gets a byte range of an archive, looks for gzip magic, and takes a
candidate as a member only if its header decodes to ``WARC/`` (and, in archives of
this writer, if its extra field holds the archive's mark, so an archive inside a
payload is not taken for the outer one). Records that *start* in the range are its
own; it reads past the range's end to finish the last. After a damaged member the
search goes on from the next byte.

Defined results: null html is an empty payload; a null url leaves out the target; a
null page id is always a response of its own; rows that repeat the least page id of a
payload are all responses; payloads under ``min_revisit_bytes`` are never revisits; a
very long payload is one record, read on past its range; an empty table writes no
archive, and no archive has no records; columns besides the three are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, saved
from .files import opened, written

MAGIC, PROFILE = b"\x1f\x8b\x08", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
READ, MOST_TASKS = 1 << 20, 1 << 16  # of a reader; beyond, a task reads several ranges


def member(data: bytes, mark: bytes, level: int = 6) -> bytes:
    """One gzip member whose extra field SX holds the archive's mark."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    extra = b"SX" + struct.pack("<H", len(mark)) + mark
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def mark_of(head: bytes) -> bytes | None:
    return head[12 : 12 + struct.unpack("<H", head[10:12])[0]] if len(head) > 16 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"SX" else None


def record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes, length: int, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if uri is not None:
        head.append(("WARC-Target-URI", quote(uri, safe="!#$%&'()*+,/:;=?@[]~")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, roll_bytes: int = 256 << 20) -> list[tuple[str, int]]:
    """Writes page_id, url, html; (uri, bytes) of the archives. Ids of the records are urn:sparlex:page:<page_id>."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    equal = rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_revisit_bytes)).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    equal = saved(equal.where("n > 1").select("sha", "first_id"), "equal-payloads")
    rows = rows.join(equal, "sha", "left").select("page_id", "url", "html", "sha", "first_id")

    def write(batches):
        part, k, made = TaskContext.get().partitionId(), 0, []
        batches = iter(batches)
        todo = ((r, b) for b in batches for r in range(b.num_rows))
        item = next(todo, None)
        while item is not None:
            uri = f"{folder}/part-{part:06d}-{k:04d}.warc.gz"
            mark, size, n = hashlib.sha1(uri.encode()).digest()[:8], 0, 0
            with written(uri) as out:
                info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:sparlex:file:%d-%d>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (part, k, DATE.encode())
                data = member(info, mark)
                while True:
                    out.write(data)
                    size += len(data)
                    if item is None or size >= roll_bytes:
                        break
                    r, b = item
                    page, url, html, sha, first = (b.column(c)[r].as_py() for c in range(5))
                    again = first is not None and page is not None and page != first and len(html) >= min_revisit_bytes
                    data = member(record("revisit" if again else "response", f"urn:sparlex:page:{page}", url, base64.b32encode(sha).decode(), html, len(html), f"urn:sparlex:page:{first}"), mark)
                    n += 1
                    item = next(todo, None)
                    if item is None or size + len(data) >= roll_bytes:
                        out.write(data)
                        size += len(data)
                        break
            made.append((uri, size))
            k += 1
        if made:
            yield tuple(zip(*made))

    return sorted((r.uri, r.size) for r in map_arrow(rows, write, "uri string, size long").collect())


class _Range:
    """Bytes of a file from a place on, read as they are needed."""

    def __init__(self, file, start: int):
        self.file, self.at, self.buf = file, start, b""
        self.total = file.size()

    def more(self) -> bool:
        to = self.at + len(self.buf)
        if to >= self.total:
            return False
        self.file.seek(to)
        self.buf += self.file.read(READ)
        return True

    def skip(self, n: int) -> None:
        self.buf, self.at = self.buf[n:], self.at + n


def _member(r: _Range, mark: bytes | None):
    """(data, bytes consumed) of the member at r's front, or None if there is no whole WARC member."""
    while len(r.buf) < 64 and r.more():
        pass
    if r.buf[:3] != MAGIC or mark is not None and mark_of(r.buf[:64]) != mark:
        return None
    z, out, used, head = zlib.decompressobj(31), [], 0, b""
    try:
        while not z.eof:
            if used >= len(r.buf) and not r.more():
                return None
            data = r.buf[used : used + (256 if used == 0 else READ)]
            out.append(z.decompress(data))
            used += len(data)
            if len(head) < 5:
                head += out[-1][:5]
                if not b"WARC/".startswith(head[:5]) and head[:5] != b"WARC/":
                    return None
        return b"".join(out), used - len(z.unused_data)
    except zlib.error:
        return None


def records(file, start: int, end: int):
    """(offset, headers, block) of the records that start in [start, end)."""
    mark = mark_of(_Range(file, 0).more() and file.read_at(64, 0) or b"")
    r = _Range(file, start)
    while True:
        while (found := r.buf.find(MAGIC)) < 0:
            r.skip(max(0, len(r.buf) - 2))
            if r.at >= end or not r.more():
                return
        r.skip(found)
        if r.at >= end:
            return
        if (got := _member(r, mark)) is None:
            r.skip(1)
            continue
        data, used = got
        head, _, block = data.partition(b"\r\n\r\n")
        fields = dict(re.findall(r"^([^:\r\n]+):[ \t]*(.*?)\r?$", head.decode("utf-8", "replace"), re.M))
        yield r.at, fields, block[: int(fields.get("Content-Length", len(block)))]
        r.skip(used)


def read_warc(spark: SparkSession, archives: list[tuple[str, int]], range_bytes: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """uri, offset, record_type, record_id, target_uri, payload_digest, payload_bytes, refers_to, payload, damaged of every response and revisit."""
    n = sum(max(1, -(-size // range_bytes)) for _, size in archives)
    todo = spark.createDataFrame(archives, "uri string, size long").select("uri", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    todo = todo.select("uri", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("end")).repartition(max(1, min(n, MOST_TASKS)), "uri", "start")

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                held, size = [], 0
                with opened(row["uri"]) as f:
                    for offset, h, block in records(f, row["start"], row["end"]):
                        if (kind := h.get("WARC-Type")) not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = h.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                        n = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                        wrong = kind == "response" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        ids = [x.strip("<>") if (x := h.get(k)) else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
                        length = len(payload) if kind == "response" else int(n[1]) if n else None
                        held.append((row["uri"], offset, kind, ids[0], h.get("WARC-Target-URI"), digest, length, ids[1], payload if payloads and kind == "response" else None, wrong))
                        size += len(payload)
                        if size > 16 << 20 or len(held) >= 4096:
                            yield tuple(map(list, zip(*held)))
                            held, size = [], 0
                if held:
                    yield tuple(map(list, zip(*held)))

    return map_arrow(todo, read, "uri string, offset long, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary, damaged boolean")


def page_id(record_id: str):
    """The page id in a record id of this writer."""
    return F.expr(f"try_cast(regexp_extract({record_id}, 'page:(-?[0-9]+)$', 1) AS bigint)")
