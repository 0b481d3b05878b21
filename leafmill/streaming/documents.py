"""Continuous document processing.  Keyed job status on a stream is ``jobs.folded_status`` in update mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import fields


def read_new_documents(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they appear below a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Structured records of a document stream: the batch expressions, stateless."""
    return fields.structured_records(docs, id_col, text_col)


def run_available(df: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process what is there and stop; the checkpoint remembers finished files."""
    query = df.writeStream.format(fmt).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def run_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """The same through a batch writer (any named sink)."""
    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
