"""Running streams: until the input is used up, into files or a batch function."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from shelfwise.sources.tables import BATCH, latest_per_key

BatchFunction = Callable[[DataFrame, int], None]


def _run(writer: DataStreamWriter, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append the stream's results to parquet at ``path`` and read them back."""
    _run(stream.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, each: BatchFunction, checkpoint: str, mode: str = "append") -> None:
    """Hand every micro-batch to ``each``; it must give the same result when repeated."""
    _run(stream.writeStream.outputMode(mode).foreachBatch(each), checkpoint)


def run_updates(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Store every change of an aggregate and read back the last state of each key.

    Append mode would hold results back until the watermark has passed them. Here
    each micro-batch's changed rows get a folder of their own, written again if the
    batch is repeated, and the latest batch of a key counts.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    _run(stream.writeStream.outputMode("update").foreachBatch(store), checkpoint)
    schema = T.StructType([*stream.schema, T.StructField(BATCH, T.LongType())])
    stored = stream.sparkSession.read.schema(schema).parquet(path)
    return latest_per_key(stored, keys, [BATCH]).drop(BATCH)
