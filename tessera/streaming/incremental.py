"""Incremental scoring of new candidate pairs: a stream of files joined with static evidence, exactly once by batch id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def score_new_pairs(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 16):
    """Score every new Parquet file of pairs once; a batch that runs again replaces what it wrote.

    Returns the started query; it ends when all files that exist are done.
    """
    pairs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
