"""Documents that arrive as files: the batch's transformations, a micro-batch at a time.

A document is scored from its own lines, so nothing is kept between batches and
late files need no watermark; a batch that is run again overwrites its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def documents(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of ``doc_id`` (the path) and ``text`` of the text files that land in a folder."""
    files = spark.readStream.schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).text(folder)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def score_into(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Write ``transform`` of every micro-batch below ``target``, a folder a batch."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
