"""Token ids in Parquet: list columns with dictionary or delta encoding, bounded row groups and page indexes.

A corpus is written as one row per document in ascending doc_id order: the ids as a list column, their number, the
file part and the place within it.  Ids take 2 bytes or less with a dictionary (one page of at most 200 kB holds a
50,000 word vocabulary); ``encoding="delta"`` writes DELTA_BINARY_PACKED pages instead, which suits sorted or
clustered ids.  Row groups and pages are small enough that a reader with a doc_id filter skips by row group
statistics and page index, and a reader of the counts never touches the id pages.

Defined cases: a null text counts as empty; an empty text has only the end id; rows with the same doc_id stand in
the order of a hash of their texts, each a row of its own; a null doc_id sorts first; other columns are ignored; an
empty table gives an empty corpus.  Texts are taken whole whatever their length; a task holds a slice of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.chunk_encoder import encoder
from leafmill.llm.common import sliced

WRITER = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "compression": "zstd",
          "parquet.page.row.count.limit": "2000", "parquet.writer.version": "PARQUET_2_0",
          "parquet.dictionary.page.size": str(1 << 20)}
ENCODINGS = {"dictionary": "true", "delta": "false"}
#: Words a worker keeps encoded, some 100 MB; most of a corpus's words are rare, and a small cache forgets them between slices.
KEPT_WORDS = 500_000
TOKENS = "doc_id long, tokens array<int>, n_tokens int, part int, start_in_part long"


def encode(docs: DataFrame, tokenizer: str, pattern: str | None, end_id: int) -> DataFrame:
    """``TOKENS`` rows in ascending doc_id order: within a partition, and from one partition to the next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, start = encoder(tokenizer, pattern, True, KEPT_WORDS), TaskContext.get().partitionId(), 0
        for batch in sliced(batches):
            ids, bounds = own.encode(batch.column("text"))
            n = batch.num_rows
            bounds = bounds + np.arange(n + 1)
            out = np.full(bounds[-1], end_id, np.int32)
            keep = np.ones(bounds[-1], bool)
            keep[bounds[1:] - 1] = False
            out[keep] = ids
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out)),
                pa.array(np.diff(bounds).astype(np.int32)), pa.array(np.full(n, part, np.int32)),
                pa.array(start + bounds[:-1])], names=["doc_id", "tokens", "n_tokens", "part", "start_in_part"])
            start += int(bounds[-1])

    return rows.mapInArrow(tokens, TOKENS)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, pattern: str | None, end_id: int,
                 encoding: str = "dictionary") -> None:
    """Write the corpus to ``folder``/tokens and the first place of each part to ``folder``/parts."""
    writer = encode(docs, tokenizer, pattern, end_id).write.options(**WRITER)
    writer.option("parquet.enable.dictionary", ENCODINGS[encoding]).parquet(f"{folder}/tokens")
    sizes = docs.sparkSession.read.parquet(f"{folder}/tokens").groupBy("part").agg(
        F.sum("n_tokens").alias("part_tokens"), F.count("*").alias("part_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file part
    sizes.withColumn("part_start", F.coalesce(F.sum("part_tokens").over(before), F.lit(0))).write.parquet(
        f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str, with_tokens: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and, if asked for, the ids.  Filters on doc_id or
    n_tokens reach the scan; without ``with_tokens`` the id pages are not read."""
    rows = spark.read.parquet(f"{folder}/tokens")
    parts = spark.read.parquet(f"{folder}/parts").select("part", "part_start")
    kept = ["tokens"] if with_tokens else []
    return rows.join(parts, "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"),
                                           F.col("n_tokens").cast("long").alias("n_tokens"), *kept)


def ids_crc32(tokens: DataFrame) -> DataFrame:
    """The rows with ``tokens`` replaced by the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    names = [c for c in tokens.columns if c != "tokens"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            values = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
            bounds = lists.offsets.to_numpy().astype(np.int64) * 4
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(crcs, pa.int64())],
                                             names=[*names, "ids_crc32"])

    kinds = dict(tokens.dtypes)
    return tokens.mapInArrow(digest, ", ".join(f"{c} {kinds[c]}" for c in names) + ", ids_crc32 long")
