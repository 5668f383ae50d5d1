"""Session and table helpers of the llm operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .arrays import TRIMMED

ZSTD = pa.Codec("zstd", compression_level=1)
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2048
BYTES_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
MOST_BROADCAST = 1 << 18  # rows of two numbers: some 20 MB


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one is set in local mode (tests); on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparlex-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn, schema: str, **first) -> DataFrame:
    """fn: an iterator of RecordBatch to an iterator of column tuples (numpy, Arrow or list), in the schema's order; columns of ``first`` (name=type) stand before it."""
    schema = StructType([StructField(n, t) for n, t in first.items()] + _parsed(schema).fields)
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def run(batches):
        cols = arrays = None
        try:
            for cols in fn(batches):
                arrays = [c if isinstance(c, pa.Array) and c.type == f.type else c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow)]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            cols = arrays = None  # else the last ones outlive the trimming
            trim()

    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:  # batches of texts lie in the executor's and the worker's memory, some at a time
        conf.set(BATCH_CONF, BATCH_ROWS)
    most = conf.get(BYTES_CONF, None)  # rows of later steps are far larger than texts, and a batch lies outside the executor's heap more than once
    if most is None or df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most) > BATCH_BYTES:
        conf.set(BYTES_CONF, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives a worker's free memory back at the end of a task: workers live on while other tasks need the room."""
    for p in TRIMMED:
        p.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def column(name: str):
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(*columns) -> list:
    """Two hashes of columns (null is a value of its own), by which equal rows are found."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(*parts).alias("key_a"), F.xxhash64(F.lit(1), *parts).alias("key_b")]


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has MOST_BROADCAST rows at most, and to be joined by sorting beyond."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df.hint("merge")


def without(docs: DataFrame, gone: DataFrame, *names: str) -> DataFrame:
    """docs less the rows whose columns ``names`` have a row_key in gone (key_a, key_b). Only keys are shuffled while they are few."""
    doc = docs.select(F.struct("*").alias("doc"))
    a, b = row_key(*[F.col("doc")[n] for n in names])
    gone = small(saved(gone.select("key_a", "key_b").distinct(), "gone"))
    return doc.join(gone, (a == F.col("key_a")) & (b == F.col("key_b")), "left_anti").select("doc.*")


def released(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver's JVM finds them unused; this makes it look."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _parsed(schema: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema)


def _arrow(t):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def pack(a: np.ndarray) -> bytes:
    """An integer array as bytes, zstd-compressed behind its length."""
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + ZSTD.compress(raw, asbytes=True)


def unpack(b: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(ZSTD.decompress(b[8:], n, asbytes=True), dtype)


def strings(buf: np.ndarray, offs: np.ndarray) -> pa.Array:
    """UTF-8 texts buf[offs[i]:offs[i + 1]] as an Arrow string array."""
    buf = np.ascontiguousarray(buf)
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(buf))


def utf8_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: sets the sizes of sketches and shards."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)


def ceil_pow2(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))
