"""Positional operators over unbounded input: position order is event time, stage lag is the watermark."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sliding_stats(rows: DataFrame, time: str, keys: list[str], value: str, size: str, slide: str, lag: str) -> DataFrame:
    """Counts and means over sliding windows; rows that come later than `lag` behind the head are dropped."""
    return rows.withWatermark(time, lag).groupBy(F.window(time, size, slide), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def clusters(rows: DataFrame, time: str, keys: list[str], gap: str, lag: str) -> DataFrame:
    """Clusters of rows closer than `gap`."""
    return rows.withWatermark(time, lag).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def coverage_runs(rows: DataFrame, time: str, key: str, lag: str) -> DataFrame:
    """Running count by key, kept in state until the watermark passes: (key, n, last)."""

    def step(k, batches, state: GroupState):
        n, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "n": [n], "last": [last]})
            return
        for pdf in batches:
            n, last = n + len(pdf), max(last, int(pdf["at"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)

    rows = rows.withWatermark(time, lag).select(F.col(key).cast("long").alias("key"), F.unix_millis(F.col(time)).alias("at"), time)
    return rows.groupBy("key").applyInPandasWithState(step, "key long, n long, last long", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(out: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what its source holds now and returns the sink's rows, kept in the shared folder."""
    spark = out.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    root = root.rstrip("/")
    path = f"{root}/stream-{uuid.uuid4().hex}"
    sink = out.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows"))
    sink.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")
