"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.replace("WITH ", "WITH RECURSIVE ", 1) if "chase(" in sql and not sql.startswith("WITH RECURSIVE") else sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK_BYTES, MOST_BROADCAST = 32 << 20, 1 << 18  # of files, that a task reads where rows are dealt; rows that are broadcast


def spread(df):
    """Rows dealt to all cores where the input is fewer files than half of them, TASK_BYTES a task at most, however large a file is; more files stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores // 2:
        return df
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(max(cores, min(-(-size // TASK_BYTES), 1 << 14)))


def small(df):
    """df, to be broadcast if it has MOST_BROADCAST rows at most."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df
