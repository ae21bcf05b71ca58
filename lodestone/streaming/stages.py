"""Streams: stage metrics, event windows, and the per-video stage machine as idempotent micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.lifecycle import next_stage


def events(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stage_metrics(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, event_type, n, total): tumbling windows with a watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there, in micro-batches, then stops; a restart goes on from the checkpoint."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query


def step(videos: DataFrame, transforms: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Videos one stage on: each stage's transform gets the rows before it and adds `ok`; rows that fail stay where they are.

    Rows that triage turned down, or that wait for it, don't move.
    """
    moving = videos.filter(F.col("triage_status") == "ACCEPTED")
    out = videos.filter(F.coalesce(F.col("triage_status") != "ACCEPTED", F.lit(True)))
    staged = moving.withColumn("__next", next_stage(F.col("checkpoint_stage")))
    known = list(transforms)
    out = out.unionByName(staged.filter(~F.coalesce(F.col("__next").isin(known), F.lit(False))).drop("__next"))
    for stage, transform in transforms.items():
        rows = transform(staged.filter(F.col("__next") == stage).drop("__next"))
        out = out.unionByName(rows.withColumn("checkpoint_stage", F.when(F.coalesce("ok", F.lit(False)), F.lit(stage)).otherwise(F.col("checkpoint_stage"))).drop("ok").select(*videos.columns))
    return out


def eta(metrics: DataFrame, remaining_videos: int) -> DataFrame:
    """One row (seconds): remaining videos times the sum of mean stage times."""
    means = metrics.groupBy("stage").agg(F.avg("duration_seconds").alias("mean"))
    return means.agg((F.coalesce(F.sum("mean"), F.lit(0.0)) * remaining_videos).alias("seconds"))


def throughput(metrics: DataFrame) -> DataFrame:
    """One row (videos_per_hour): distinct videos over the hours between the first and the last start; null under a second."""
    span = F.timestamp_diff("SECOND", F.min("started_at").cast("timestamp"), F.max("started_at").cast("timestamp"))
    return metrics.agg(F.try_divide(F.count_distinct("video_id") * 3600.0, F.nullif(span, F.lit(0))).alias("videos_per_hour"))
