"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from leafmill.session import shared_folder

SLICE_BYTES = 4 << 20


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder below the shared one, for tables that are written and read again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared folder and cut from its lineage.  A lost executor loses nothing."""
    df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes in a string or binary column, a longer value alone.  Batches
    come with a number of rows, and texts may be long; what a task holds per byte stays bounded this way."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin] - sizes[begin]
            end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def renamed(df: DataFrame, taken: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with spare names for its columns that clash with ``taken``, and the way back (spare to own name)."""
    back = {f"__own_{k}": c for k, c in enumerate(df.columns) if c.lower() in taken}
    for spare, own in back.items():
        df = df.withColumnRenamed(own, spare)
    return df, back
