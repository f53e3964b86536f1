"""Ingestion of files as they arrive: a stream of files, each micro-batch ingested by the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.text import category, suffix
from ledgerloom.plans.ingest import Ingested, extract, ingest_tables
from ledgerloom.sources import files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of documents: every new file of a folder once."""
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)
    own = found.select(F.col("path").alias("doc_id"), "path", suffix("path").alias("suffix"), F.col("length").alias("n_bytes"), "content")
    return own.withColumn("category", category("suffix"))


def ingest_stream(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[Ingested, int], None], once: bool = True) -> StreamingQuery:
    """Hand the Ingested of every micro-batch to sink. A document is one file, so its roll-ups lie within a batch."""

    def run(batch: DataFrame, number: int) -> None:
        raw, failed = extract(batch)
        sink(ingest_tables(batch, raw, files.routing_errors(batch).unionByName(failed)), number)

    writer = arriving(spark, folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
