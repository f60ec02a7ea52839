"""A fitted pipeline over a folder that new files of sessions arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from visitflow.plans.pipeline import FittedPipeline


def session_stream(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 1000) -> DataFrame:
    """Raw sessions of the parquet files in ``folder``, each file once, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def transform_stream(
    sessions: DataFrame, pipeline: FittedPipeline, sink: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Start writing model input of arriving sessions to a parquet folder, each session once.

    The checkpoint remembers which files were read, and the sink's log which of its files belong to finished batches, so a run
    that was stopped or lost goes on where it was. Without ``every`` all that is there is worked off in batches,
    and the query ends; with it, say ``"1 minute"``, it goes on. The pipeline is row-local: no state is kept.
    """
    writer = pipeline.transform(sessions).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    """What finished batches wrote; files of a batch that was cut off do not count."""
    return spark.read.parquet(sink)
