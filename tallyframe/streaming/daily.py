"""Daily batches from a stream: late rows, duplicates and upserts by day.

The state is bounded by the watermark: an event's key is remembered for as long as rows may be late, then forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import periods
from tallyframe.functions.keep import keep_last
from tallyframe.operators.application import upsert
from tallyframe.session import materialize


def fresh_events(events: DataFrame, key: str, at: str, late: str = "24 hours") -> DataFrame:
    """Events once per key; later than late they are dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "24 hours") -> DataFrame:
    """Counts and sums per window and kind, given out when the watermark has passed the window."""
    rows = events.withWatermark(at, late)
    return rows.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def upsert_batches(events: DataFrame, path: str, checkpoint: str, keys: list[str], seq: str, at: str):
    """Starts a query that merges each micro-batch into a table by day under path. Only the days that a batch has rows
    of are read and rewritten. A batch that runs again after a failure gives the same rows again."""

    def merge(batch: DataFrame, n: int) -> None:
        new = materialize(keep_last(batch.withColumn("day", periods.ny_date_key(F.col(at))), [*keys, "day"], [seq]), "daily-new")
        touched = [r.day for r in new.select("day").distinct().collect()]  # a batch has few days
        if not touched:
            return
        jvm = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        there = jvm.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(jvm)
        old = batch.sparkSession.read.schema(new.schema).parquet(path).where(F.col("day").isin(touched)) if there else new.limit(0)
        merged = materialize(upsert(old.select(new.columns), new, [*keys, "day"], seq), "daily-merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_batch(articles: DataFrame, owner: str, key: str, at: str, end: str, hours: int = 24) -> DataFrame:
    """The articles of the last so many hours before end, one per owner, day and key (the newest): what a daily run
    merges into its tables."""
    stop = F.to_timestamp(F.lit(end))
    fresh = articles.where((F.col(at) <= stop) & (F.col(at) >= stop - F.make_interval(hours=F.lit(hours))))
    return keep_last(fresh.withColumn("day", periods.ny_date_key(F.col(at))), [owner, "day", key], [at])
