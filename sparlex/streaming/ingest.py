"""Structured Streaming: incremental chunk ingest, a judgment log, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import upsert_latest


def read_new_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the rows of new files only; a checkpoint remembers those that are done."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).format(fmt).load(path)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str, version: str, buckets: int = 64):
    """Keeps the latest row of each key. Keys are dealt to buckets by hash; a batch writes path/v=<batch> with the buckets
    that its keys are in, each from its newest version before and the batch's rows, and leaves the others alone.

    A batch that is tried again writes the same version again, so rows are neither lost nor doubled. read_latest reads the table.
    """

    def write(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        old = read_latest(spark, path, batch.schema, touched, no - 1) if no > 0 and touched else batch.limit(0)
        rows = upsert_latest(old.select(batch.columns), batch, key, version).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={no}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, schema, only: list[int] | None = None, upto: int | None = None) -> DataFrame:
    """The rows of the newest version of every bucket (of ``only``; no version beyond ``upto``): other files are not read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest: dict[int, int] = {}
    for status in files.globStatus(hadoop.Path(root, "v=*/bucket=*")) or ():
        name = status.getPath()
        bucket, v = (int(n.split("=")[1]) for n in (name.getName(), name.getParent().getName()))
        if (only is None or bucket in only) and (upto is None or v <= upto):
            newest[bucket] = max(v, newest.get(bucket, v))
    paths = [f"{path}/v={v}/bucket={b}" for b, v in sorted(newest.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def first_seen(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key; repeats within the watermark are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, late: str, size: str, slide: str | None, *keys: str) -> DataFrame:
    """Rows by window and keys (tumbling, or sliding); rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size, slide), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, late: str, gap: str, key: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def judgment_stream(stream: DataFrame, qid: Column, verdict: Column) -> DataFrame:
    """qid, relevant, negative: running counts of a judgment log, undo taking back the question's last verdict."""

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        relevant, negative, last = state.get if state.exists else (0, 0, "")
        for frame in frames:
            for v in frame["verdict"]:
                if v == "undo":
                    relevant, negative, last = relevant - (last == "relevant"), negative - (last == "negative"), ""
                else:
                    relevant, negative, last = relevant + (v == "relevant"), negative + (v == "negative"), v
        state.update((relevant, negative, last))
        yield pd.DataFrame({"qid": [key[0]], "relevant": [relevant], "negative": [negative]})

    log = stream.select(qid.cast("string").alias("qid"), verdict.alias("verdict"))
    return log.groupBy("qid").applyInPandasWithState(update, "qid string, relevant int, negative int", "relevant int, negative int, last string", "update", GroupStateTimeout.NoTimeout)
