"""Queries over streams of landed files that run to their end, and agree with what a batch gives."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import functions as F

from plenum.operators import annotate
from plenum.plans.registry import query
from plenum.plans.texts import _RULE
from plenum.sources import cursors
from plenum.storage import cut, discard, scratch, table
from plenum.streaming import attempts, live


def _hesitant(text: str, attempt: int) -> dict | None:
    """The model that stands for another, but one text in seven gets its answer at the second attempt only."""
    return None if attempt == 1 and zlib.crc32(text.encode()) % 7 == 0 else json.loads(annotate.rule_model([text])[0])


@query(f"WITH {_RULE} SELECT record_id, argument_type, stance, key_point FROM r")
def live_annotation(spark, sf_dir):
    """Annotations of a stream in which a tenth of the records comes first in part, and again in full, and some answers take two attempts."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("id"), "conv_id", F.substring("text", 1, 800).alias("text"))
    root = scratch(spark, "live-annotation")
    early = c.withColumn("version", F.when(F.col("conv_id") % 10 == 0, 0).otherwise(1)).withColumn("text", F.when(F.col("conv_id") % 10 == 0, F.substring("text", 1, 20)).otherwise(F.col("text")))
    early.select("id", "version", "text").write.json(f"{root}/landed")
    again = c.filter("conv_id % 10 = 0 or conv_id % 10 = 1").withColumn("version", F.lit(1))  # repaired ones, and repeated ones
    again.select("id", "version", "text").write.mode("append").json(f"{root}/landed")
    records = live.landed(spark, f"{root}/landed", "id string, version long, text string")
    held = attempts.run_to_the_end(records, _hesitant, f"{root}/rows", f"{root}/state", pause=50)
    answer = F.from_json("answer", "argument_type string, stance string, key_point string")
    out = cut(held.select(F.col("id").alias("record_id"), answer.alias("a")).select("record_id", "a.*"))
    discard(spark, root)
    return out


#: Conversations of a landed page.
PAGE = 25


@query("SELECT concat_ws('_', conv_id, turn) AS id, role AS author, text AS raw_text FROM conversations")
def cursor_stream(spark, sf_dir):
    """Turns of conversations that lie in pages, each naming the next, read as a stream by cursor; half of the way the stream stops, and goes on from its checkpoint."""
    root = scratch(spark, "cursor-stream")
    c = table(spark, sf_dir, "conversations").withColumn("cursor", F.floor(F.col("conv_id") / PAGE))
    nodes = F.collect_list(F.struct(F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("role").alias("author"), F.col("text").alias("raw_text")))
    pages = cut(c.groupBy("cursor").agg(nodes.alias("nodes")))  # a page has the turns of PAGE conversations
    last = pages.agg(F.max("cursor")).first()[0]
    every = spark.range(-1 if last is None else last + 1).select(F.col("id").alias("cursor")).join(pages, "cursor", "left")
    info = F.struct((F.col("cursor") < last).alias("hasNextPage"), (F.col("cursor") + 1).cast("string").alias("endCursor")).alias("pageInfo")
    answer = F.to_json(F.struct(F.coalesce("nodes", F.array()).alias("nodes"), info))
    every.select("cursor", answer.alias("value")).write.partitionBy("cursor").text(f"{root}/landed")
    spark.dataSource.register(cursors.CursorSource)
    schema = "id string, author string, raw_text string"
    for batches in (1, None):
        stream = spark.readStream.format("cursor").schema(schema).options(client="plenum.sources.cursors:landed_answer", endpoint=f"{root}/landed").load()
        run = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").start(f"{root}/rows")
        try:
            if batches is None:
                run.processAllAvailable()
            else:
                while run.isActive and (run.lastProgress is None or run.lastProgress.batchId + 1 < batches):
                    run.awaitTermination(0.2)
        finally:
            run.stop()
    out = cut(spark.read.schema(schema).parquet(f"{root}/rows"))
    discard(spark, root)
    return out
