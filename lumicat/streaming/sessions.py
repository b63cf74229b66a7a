"""Incremental operators on streams: offsets, sessions and availableNow jobs.

Offsets live in the checkpoint of the query, so a batch is processed once even
if the job restarts between reading and writing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumicat.operators.sync import latest
from lumicat.session import folder_exists


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(path)


def upsert_latest(events: DataFrame, out: str, checkpoint: str, keys: list[str], order: list[str], merge_every: int = 16) -> DataFrame:
    """The last row per key of all that a stream has brought; runs what is there, then stops.

    Each batch writes the last row of its own keys only. Every ``merge_every`` batches one also takes in what was before, so
    that a reader begins at the newest such batch. A repeated batch overwrites its own folder with the same rows, and a
    run without new data returns the state as it is.
    """
    spark = events.sparkSession

    def log() -> DataFrame:
        return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in events.schema)}, merged int, batch long").parquet(out)

    def since(rows: DataFrame) -> DataFrame:
        begun = rows.where("merged = 1").agg(F.max("batch")).first()[0] or 0
        return latest(rows.where(F.col("batch") >= begun), keys, order).select(*events.columns)

    def write(batch: DataFrame, number: int) -> None:
        rows, merged = batch, int(number > 0 and number % merge_every == 0)
        if merged and folder_exists(spark, out):
            rows = since(log().where(F.col("batch") < number)).unionByName(batch)
        latest(rows, keys, order).select(*batch.columns).write.mode("overwrite").parquet(f"{out}/merged={merged}/batch={number}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return since(log()) if folder_exists(spark, out) else spark.createDataFrame([], events.schema)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type, for streams and batches alike (an extra)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
