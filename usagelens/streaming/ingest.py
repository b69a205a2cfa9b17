"""Polling as a stream of landing files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery


def ingest(
    spark: SparkSession, landing: str, schema: T.StructType, apply: Callable[[DataFrame, int], None],
    checkpoint: str, fmt: str = "parquet", files_per_batch: int | None = None,
) -> StreamingQuery:
    """Hand every landing file that has not been seen to ``apply``, then stop.

    The stream's checkpoint is the memory of what was seen. A batch that fails is
    delivered again, so ``apply`` must be repeatable, as replacing by key is. Run
    it from a scheduler for a fixed delay; runs that find nothing do nothing.
    """
    source = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return (
        source.load(landing).writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
