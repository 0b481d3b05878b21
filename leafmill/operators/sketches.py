"""Sketches per key and day that are kept and merged later, without the rows: quantiles and frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch, and its published normalised rank error with 99 % confidence (2.296 / k^0.9723).
QUANTILE_K = 200
RANK_ERROR = 2.296 / QUANTILE_K ** 0.9723


def quantile_sketches(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, low, high, total, sketch): one row per group, some KB each whatever its size.  Nulls don't count."""
    known = values.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_K)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The same for coarser groups."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.kll_merge_agg_double("sketch", F.lit(QUANTILE_K)).alias("sketch"))


def quantiles(sketches: DataFrame, keys: list[str], ranks: dict[str, float]) -> DataFrame:
    """(keys, n, low, high, mean, one column per rank): each a value whose rank is within ``RANK_ERROR`` of the one
    asked for; groups of up to ``QUANTILE_K`` values are exact."""
    return sketches.select(*keys, "n", "low", "high", (F.col("total") / F.col("n")).alias("mean"), *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in ranks.items()])


def frequent_sketches(rows: DataFrame, keys: list[str], item: str, most: int) -> DataFrame:
    """(keys, n, hitters): the items that occur most in each group, ``most`` tracked.  Nulls don't count."""
    known = rows.where(F.col(item).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(`{item}`, {int(most)})").alias("hitters"))


def merged_frequent(sketches: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The same for coarser groups."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(hitters, {int(most)})").alias("hitters"))


def frequent_items(sketches: DataFrame, keys: list[str], k: int, most: int) -> DataFrame:
    """(keys, item, count, bound): the ``k`` most frequent items of each group with an upper estimate of their count,
    too high by at most ``bound``; 0 as long as no group met more items than it tracks."""
    listed = sketches.select(*keys, "n", F.explode(F.expr(f"approx_top_k_estimate(hitters, {int(k)})")).alias("h"))
    table_size = 1 << max(3, (most * 4 // 3 - 1).bit_length())  # of the sketch, a power of two that is at most 3/4 full
    return listed.select(*keys, F.col("h.item").alias("item"), F.col("h.count").alias("count"),
                         F.ceil(F.col("n") * 3.5 / table_size).alias("bound"))
