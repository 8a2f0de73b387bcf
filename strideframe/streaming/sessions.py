"""Usage sessions and success rates over an event stream.

The transformations are plain DataFrame functions, so the same code runs on a
batch table and on a stream with a watermark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: relative error of timing quantiles, and the bucket of values that have no logarithm
ACCURACY, LOWEST = 0.01, -(1 << 30)
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.col("ts").cast("timestamp"))


def usage_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Visits per user, split where nothing happened for ``gap``."""
    return events.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "purchase").alias("n_done"), F.max("at").alias("last_at")
    ).select("user_id", F.col("s.start").alias("start_at"), "last_at", "n_events", "n_done")


def outcome_rates(events: DataFrame, failed: Column, width: str = "1 hour") -> DataFrame:
    """Requests, failures and timing per window."""
    return events.groupBy(F.window("at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failed"), F.sum("value").alias("sum_value"), F.max("value").alias("max_value")
    ).select(F.col("w.start").alias("start_at"), "n", "n_failed", "sum_value", "max_value")


def timing_counts(events: DataFrame, value: str = "value", width: str = "1 hour", accuracy: float = ACCURACY) -> DataFrame:
    """Quantile sketch of a timing per window, as rows: counts of values in buckets that grow by a fixed factor.

    The counts are the state of the stream under the watermark: sums, so they
    merge in any order and a replayed batch adds nothing. A bucket is as wide
    as ``accuracy`` allows on either side of its middle, whatever the values,
    so a window has a few hundred buckets for each power of ten. Values of zero
    and less share the bucket of the smallest number; missing ones have none.
    """
    growth = math.log((1 + accuracy) / (1 - accuracy))
    bucket = F.when(F.col(value) > 0, F.ceil(F.log(F.col(value)) / growth).cast("int"))
    live = events.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return live.groupBy(F.window("at", width).alias("w"), F.coalesce(bucket, F.lit(LOWEST)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start_at"), "bucket", "n")


def timing_quantiles(counts: DataFrame, qs: dict[str, float], accuracy: float = ACCURACY) -> DataFrame:
    """Quantiles of each window from its bucket counts, within ``accuracy`` of the value of that rank.

    The rank is floor(q * (n - 1)), from 0. The window over buckets holds one
    time window's buckets, which ``accuracy`` bounds, never its events.
    """
    from pyspark.sql import Window

    growth = math.log((1 + accuracy) / (1 - accuracy))
    order = Window.partitionBy("start_at").orderBy("bucket")
    ranked = counts.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy("start_at"))})
    middle = F.when(F.col("bucket") == LOWEST, 0.0).otherwise(F.exp(F.col("bucket") * growth) * (1 - accuracy))
    return ranked.groupBy("start_at").agg(F.max("total").alias("n"), *[F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("total") - 1)), middle)).alias(name) for name, q in qs.items()])


def open_stream(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    return with_event_time(spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob).parquet(folder))


def run_updates(stream: DataFrame, key: list[str], name: str) -> DataFrame:
    """Run to the end of the available input in update mode and return the last state per key.

    Every micro-batch overwrites its own folder, so a replayed batch changes nothing.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    q = (stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch_path(spark, name + "-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    done = spark.read.parquet(out).drop("part")
    rest = [c for c in done.columns if c not in (*key, "batch_no")]
    return done.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col("batch_no")).alias("r")).select(*key, "r.*")


def run_appends(stream: DataFrame, name: str) -> DataFrame:
    """Run in append mode (only closed groups) and return what was written."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", scratch_path(spark, name + "-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
