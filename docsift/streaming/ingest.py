"""Ingest as a stream: uploaded text files become cleaned, chunked and embedded sections.

The path is stateless but for the removal of uploads sent twice, whose state a
watermark bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsift.functions import text as X
from docsift.operators.chunk import overlap_chunks
from docsift.operators.embed import embedder_udf


def uploads(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """path, modified, text of text files that arrive in a folder."""
    raw = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).format("text").load(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.make_valid_utf8("value").alias("text"))


def sections(documents: DataFrame, delay: str = "1 hour") -> DataFrame:
    """path, modified, pos, chunk, embedding of each new document; the same text within the delay counts once."""
    cleaned = documents.withColumn("text", X.clean_ingest("text")).withColumn("digest", F.sha2("text", 256))
    fresh = cleaned.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["digest"]).drop("digest")
    return overlap_chunks(fresh, "text").withColumn("embedding", embedder_udf()("chunk"))


def run(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append sections to a folder until what is there is done."""
    return sections(documents).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """window start, event_type, events: counts per tumbling window; rows later than the delay are left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "event_type", "events")
