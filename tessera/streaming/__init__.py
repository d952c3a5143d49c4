"""Schemas in Structured Streaming: every operation is stateless, so the batch forms run unchanged."""

from __future__ import annotations

from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import Options, parse


def parse_stream(stream: DataFrame, column: str, s: Any, into: str = "value", mode: str = "permissive", options: Options | None = None) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("parse_stream takes a streaming DataFrame")
    return parse(stream, column, s, into=into, mode=mode, options=options)


def split_stream(stream: DataFrame, column: str, s: Any, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Valid rows to one Parquet folder, failing rows with their errors to another, once each per batch."""
    parsed = parse_stream(stream, column, s)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)  # parsed once for both writes
        batch.filter("value_error is null").drop("value_error").withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        batch.filter("value_error is not null").drop("value").withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        batch.unpersist()

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
