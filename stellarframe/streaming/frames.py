"""Frames that arrive as files: each micro-batch of pairs is subtracted with solutions fitted before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Result, Subtractor


def subtract_stream(spark: SparkSession, source: str, schema: str, solutions: DataFrame, engine: Subtractor, sink: Callable[[Result, int], None], checkpoint: str, files_per_batch: int = 8) -> StreamingQuery:
    """Read pair tiles (Parquet files under source) as a stream and hand each batch's Result to sink.

    Solutions are frozen, so batches are independent and nothing is kept between them; the checkpoint folder makes each
    file count once. The query runs until it is stopped; processAllAvailable() takes what is there.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        pairs = df.persist()
        try:
            sink(engine.apply(solutions, pairs), number)
        finally:
            pairs.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
