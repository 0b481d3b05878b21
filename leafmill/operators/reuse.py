"""Reuse of results at scale: a bucketed table of known keys with a Bloom filter in front.

The keys lie in a table that is bucketed and sorted by key, so a join with it moves the documents' keys only.  The
filter is a table too, of blocks of ``BLOCK_BITS`` bits: a key's hash picks its block, ``HASHES`` further ones its
bits there, so a lookup needs one row.  A key with a bit unset is new for certain and skips the join; the others are
looked up, which resolves the filter's false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap of Spark's bitmap functions.
BLOCK_BITS = 32_768
HASHES = 5


def write_keys(keys: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Distinct non-null ``key`` values as a table bucketed by key; mode ``append`` adds keys to it."""
    rows = keys.select("key").where("key is not null").distinct().repartition(buckets, "key")
    rows.write.bucketBy(buckets, "key").sortBy("key").mode(mode).saveAsTable(table)


def filter_blocks(n_keys: int, bits_per_key: int = 12) -> int:
    """Blocks of a filter for so many keys; 12 bits a key leave about 0.4 % false positives."""
    return max(1, -(-n_keys * bits_per_key // BLOCK_BITS))


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BLOCK_BITS)) for k in range(HASHES)]


def key_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): one row per block that holds a key.  Filters of the same number of blocks are merged by
    ``merged_filters``."""
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    placed = keys.where("key is not null").select(block.alias("block"), F.explode(F.array(*_bits(F.col("key")))).alias("bit"))
    return placed.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged_filters(*filters: DataFrame) -> DataFrame:
    """One filter for all keys of several."""
    rows = filters[0]
    for other in filters[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def with_suspicion(docs: DataFrame, filter_: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """``docs`` with ``maybe_known``: false if the key is new for certain (a null key is)."""
    def held(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        masks = F.array(*[F.lit(1 << i) for i in range(8)])
        return byte.bitwiseAND(F.element_at(masks, (bit % 8 + 1).cast("int"))) > 0

    probe = docs.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    found = probe.join(filter_, "block", "left")
    all_set = F.lit(True)
    for bit in _bits(F.col(key)):
        all_set = all_set & held(bit)
    maybe = F.coalesce(F.col(key).isNotNull() & F.col("bits").isNotNull() & all_set, F.lit(False))
    return found.withColumn("maybe_known", maybe).drop("block", "bits")


def new_keys(docs: DataFrame, table: str, filter_: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """Documents whose key is not in the table, without a shuffle of the table: suspects are moved to its buckets,
    documents that are new for certain stay where they are."""
    known = docs.sparkSession.table(table).select(F.col("key").alias("_known"))
    marked = with_suspicion(docs, filter_, blocks, key)
    suspects = marked.where("maybe_known").join(known, F.col(key) == F.col("_known"), "left_anti")
    return marked.where(~F.col("maybe_known")).unionByName(suspects).drop("maybe_known")
