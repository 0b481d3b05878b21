"""Audit records whose details differ from record to record, as variant values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where records keep resource and outcome, the first path that holds a value counts.
RESOURCE_TYPE = ("$.resource.type", "$.resource_type")
RESOURCE_ID = ("$.resource.id", "$.resource_id", "$.target")
OUTCOME = ("$.outcome", "$.result.status", "$.status")
#: Size of a distinct sketch, and its standard error.
DISTINCT_K = 12
DISTINCT_ERROR = 1.04 / 2 ** (DISTINCT_K / 2)


def _first_path(details: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_variant_get(details, p, "string") for p in paths])


def audit_records(logs: DataFrame, keep: list[str], details: str = "details") -> DataFrame:
    """``keep`` columns, resource_type, resource_id, outcome and the details (JSON text) as a variant.

    Text that is no JSON has null details; a record whose details name no resource or outcome has null there."""
    parsed = logs.withColumn("_details", F.try_parse_json(details))
    return parsed.select(*keep, _first_path(F.col("_details"), RESOURCE_TYPE).alias("resource_type"),
                         _first_path(F.col("_details"), RESOURCE_ID).alias("resource_id"),
                         _first_path(F.col("_details"), OUTCOME).alias("outcome"), F.col("_details").alias("details"))


def with_path(records: DataFrame, name: str, path: str, kind: str) -> DataFrame:
    """``records`` with a value of the details by path; null where it is missing or of another type."""
    return records.withColumn(name, F.try_variant_get("details", path, kind))


def audit_summary(records: DataFrame, keys: list[str], user: str) -> DataFrame:
    """(keys, n_events, users): counts and a mergeable sketch of distinct users, e.g. per action, resource type,
    outcome and day."""
    return records.groupBy(*keys).agg(F.count("*").alias("n_events"), F.hll_sketch_agg(user, DISTINCT_K).alias("users"))


def merged_summary(summary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_events, n_users) of coarser groups, from the sketches alone; the number of users has a standard error
    of ``DISTINCT_ERROR``."""
    return summary.groupBy(*keys).agg(F.sum("n_events").alias("n_events"), F.hll_sketch_estimate(
        F.hll_union_agg("users")).alias("n_users"))


def details_schemas(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, schema): the common schema of the details of each group."""
    return records.where("details is not null").groupBy(*keys).agg(F.schema_of_variant_agg("details").alias("schema"))
