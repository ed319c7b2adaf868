"""Incremental ingest as a stream of files: each micro-batch is converted and merged into the document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkweft.sources.convert import convert_files
from inkweft.sources.scan import FILE_SCHEMA, file_name
from inkweft.sources.sinks import write_changed


def ingest_stream(spark: SparkSession, drop_folder: str, documents: str, checkpoint: str, hosts: tuple[str, ...] = (), glob: str = "*", once: bool = True) -> StreamingQuery:
    """Convert files as they arrive; only changed documents are written.  With ``once`` what is there is read and the
    query ends."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(drop_folder)

    def merge(batch: DataFrame, _id: int) -> None:
        done = convert_files(batch.select(file_name().alias("name"), "content"), hosts)
        write_changed(done.where("error is null").select("name", "source_id", "title", "md"), documents)

    writer = files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``window_start, event_type, n, total`` over a stream or table of ``ts, event_type, value``."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
