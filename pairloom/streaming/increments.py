"""An extra, beyond batch: increments of counts keep the totals by feature and by cell up to date.

The sums are associative, so each micro-batch is summed by itself and merged into a Parquet table of
running totals; a batch that is delivered again is recognised by its number and skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _latest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    done = [int(f.getPath().getName().split("=")[1]) for f in (fs.listStatus(p) if fs.exists(p) else []) if "=" in f.getPath().getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return (max(done), spark.read.parquet(f"{path}/epoch={max(done)}")) if done else (-1, None)


def merge_totals(path: str, by: str = "feature"):
    """For foreachBatch: each epoch's table holds the totals up to it."""

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last, old = _latest(spark, path)
        if epoch <= last:
            return
        new = batch.groupBy(by).agg(F.sum("count").alias("total"))
        if old is not None:
            new = new.unionByName(old).groupBy(by).agg(F.sum("total").alias("total"))
        new.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return put


def totals(spark: SparkSession, path: str) -> DataFrame | None:
    return _latest(spark, path)[1]


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, value of a stream of events (ts, event_type, value) in tumbling windows."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
