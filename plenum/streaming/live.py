"""Streams of records: landed files, late duplicates, live shares, and annotation by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from plenum.operators import annotate


def landed(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON records as their files land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def once(records: DataFrame, key: str, ts: str, delay: str = "7 days") -> DataFrame:
    """Each key once, whatever repaired pages bring again within the delay."""
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def live_counts(records: DataFrame, ts: str, category: str, window: str = "14 days", delay: str = "7 days") -> DataFrame:
    """Counts by tumbling window and category; a window is final when the watermark passes its end."""
    timed = records if records.isStreaming is False else records.withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, window).alias("w"), category).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), category, "n")


def annotate_stream(records: DataFrame, id_col: str, text_col: str, path: str, checkpoint: str, model: annotate.Model = annotate.rule_model) -> DataStreamWriter:
    """A writer that annotates each micro-batch and appends what is new to path; a batch that comes again adds nothing."""

    def each(batch: DataFrame, _: int) -> None:
        annotate.run_stage(batch.sparkSession, batch.dropDuplicates([id_col]), id_col, text_col, path, model)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
