"""Streaming: facts files through the rules into a review log, and a live view of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import rules as rl


def facts_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def findings_stream(facts: DataFrame, rules: list[dict]) -> DataFrame:
    """Rules are projections, so a stream of facts is checked without state."""
    return rl.findings(facts, rules)


def into_log(findings: DataFrame, log: str, checkpoint: str):
    """Appends each batch to the review log; batches are named, so a repeated one replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_findings")).withColumn("status", F.lit("pending"))
        rows.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

    return findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Review events per window and kind, late ones within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
