"""A landing folder as a stream: new documents run through the same batch functions.

Documents are independent of each other and arrive whole, so no state crosses batches.
Each batch replaces its own folder of the sink, so a repeated batch writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def process_landing(spark: SparkSession, landing: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], files_per_batch: int = 64, once: bool = False) -> StreamingQuery:
    """Runs transform over each micro-batch of Parquet files below landing; rows go to sink/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
