"""Streams give what a batch gives once all is read."""

from pyspark.sql import functions as F

from gridlark.streaming import positions

SCHEMA = "id long, ts timestamp, k long, v double"


def _files(spark, tmp_path):
    df = spark.range(60).select("id", F.timestamp_seconds(1704067200 + F.col("id") * 10).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    for i in range(3):
        df.filter((F.col("id") >= i * 20) & (F.col("id") < i * 20 + 20)).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    return str(tmp_path / "in/*"), df


def _run(out, name, spark, tmp_path):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_sliding_and_clusters(spark, tmp_path):
    path, df = _files(spark, tmp_path)
    s = positions.source(spark, path, SCHEMA, 1)
    got = _run(positions.sliding_stats(s, "ts", ["k"], "v", "60 seconds", "30 seconds", "0 seconds"), "slide", spark, tmp_path)
    batch = df.groupBy(F.window("ts", "60 seconds", "30 seconds"), "k").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    have = {(r.window.start, r.k): (r.n, r.mean) for r in got.collect()}
    want = {(r.window.start, r.k): (r.n, r.mean) for r in batch.collect()}
    assert have and all(want[k] == v for k, v in have.items())
    assert len(have) >= len(want) - 9  # the last windows are still open
