"""Incremental reads of a folder: every micro-batch reads the files that came since the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillframe.options import ReadOptions, Schema
from quillframe.sources.reader import read_csv


def stream_csv(spark: SparkSession, folder: str, schema: Schema, sink: Callable[[DataFrame, int], None], checkpoint: str, options: ReadOptions | None = None, files_per_batch: int = 64) -> StreamingQuery:
    """Strictly read new files as they come (once, then stop) and hand each batch's rows to the sink.

    Records never span files, so a batch is a set of whole files, read in one scan; the files of a batch
    have one header. The file source's log in `checkpoint` makes sure that each file is read once.
    Rows have the column file beside the requested ones.
    """
    source = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch)
    names = source.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def read(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.distinct().orderBy("path").collect()]  # files_per_batch at most
        if paths:
            sink(read_csv(spark, paths, schema, options, keep_order=True).withColumnRenamed("_file", "file").drop("_blk", "_pos"), number)

    return names.writeStream.foreachBatch(read).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
