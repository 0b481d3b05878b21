"""Content keys, result reuse and exact duplicates.

Only hashes travel: the text is read once to make its key and never shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(content: Column, params: dict | None = None) -> Column:
    """``ocr:`` + sha256 of the content followed by the parameters as sorted-key JSON."""
    tail = F.lit(json.dumps(params, sort_keys=True)) if params else F.lit("")
    return F.concat(F.lit("ocr:"), F.sha2(F.concat(content, tail), 256))


def valid_entries(entries: DataFrame, asof: Column) -> DataFrame:
    """Latest write per key if it has not expired (a later write replaces an earlier one).

    ``max_by`` combines on the map side, so a key written very often costs one row per task.
    """
    latest = entries.groupBy("key").agg(F.max_by(
        F.struct("created_at", "expires_at", "hit_count"), F.struct("created_at", "expires_at")).alias("e"))
    return latest.select("key", "e.*").filter(F.col("expires_at") > asof)


def cached(docs: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    """Documents whose result is already there."""
    return docs.join(entries.select(key), key, "left_semi")


def uncached(docs: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    """Documents that still have to be processed."""
    return docs.join(entries.select(key), key, "left_anti")


def cache_statistics(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("n_keys"), F.sum("hit_count").alias("total_hits"))


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One id per distinct content: the smallest, with the number of copies.

    Partial aggregation sends one (hash, min, count) per task, so a content that makes up a
    third of the corpus is no hot spot.
    """
    return docs.select(id_col, F.sha2(F.col(text_col), 256).alias("file_hash")).groupBy("file_hash").agg(
        F.min(id_col).alias(id_col), F.count("*").alias("n_copies"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contents that occur more than once."""
    return first_copies(docs, id_col, text_col).filter(F.col("n_copies") > 1)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its hash, the id kept for that hash and whether it is a copy.
    The kept ids come from an aggregate, not from a window over all copies of a content."""
    hashed = docs.select(id_col, F.sha2(F.col(text_col), 256).alias("file_hash"))
    kept = hashed.groupBy("file_hash").agg(F.min(id_col).alias("kept_id"), F.count("*").alias("n")).filter("n > 1")
    joined = hashed.join(kept.drop("n"), "file_hash", "left")
    keep = F.coalesce("kept_id", F.col(id_col))
    return joined.select(id_col, "file_hash", keep.alias("kept_id"), (keep != F.col(id_col)).alias("is_copy"))
