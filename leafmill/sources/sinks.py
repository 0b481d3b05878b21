"""Output connectors by name, with one field mapping for all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def map_fields(df: DataFrame, mapping: dict[str, str] | None, strict: bool = False) -> DataFrame:
    """Keep and rename the mapped columns that exist; an empty mapping keeps all columns
    (or none with ``strict``, the rule of a transform step)."""
    if not mapping and not strict:
        return df
    return df.select(*[F.col(src).alias(dst) for src, dst in (mapping or {}).items() if src in df.columns])


def map_keys(values, mapping: dict[str, str]):
    """The same for a map column."""
    names = F.create_map(*[x for pair in mapping.items() for x in map(F.lit, pair)])
    kept = F.map_filter(values, lambda k, _: F.map_contains_key(names, k))
    return F.transform_keys(kept, lambda k, _: F.try_element_at(names, k))


def write_files(df: DataFrame, path: str, fmt: str = "json", mapping: dict | None = None, mode: str = "append",
                partition_by: list[str] = ()) -> None:
    """File drop: json, xml, parquet, or csv with a header."""
    writer = map_fields(df, mapping).write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    if fmt == "xml":
        writer = writer.option("rowTag", "record")
    writer.format(fmt).save(path)


def write_database(df: DataFrame, url: str, table: str, run_ts: str, mapping: dict | None = None, **properties) -> None:
    """Append through JDBC, every row stamped with ``created_at``."""
    stamped = map_fields(df, mapping).withColumn("created_at", F.lit(run_ts))
    stamped.write.jdbc(url, table, mode="append", properties=properties)


def write_table(df: DataFrame, path: str, run_ts: str, mapping: dict | None = None) -> None:
    """The database sink's rows as a parquet table."""
    map_fields(df, mapping).withColumn("created_at", F.lit(run_ts)).write.mode("append").parquet(path)


def write_outbox(df: DataFrame, path: str, mapping: dict | None = None, endpoint: str = "") -> None:
    """Requests for an HTTP destination, as rows a sender picks up."""
    out = map_fields(df, mapping)
    out.select(F.lit(endpoint).alias("endpoint"), F.to_json(F.struct("*")).alias("body")).write.mode("append").json(path)


SINKS: dict[str, Callable] = {"files": write_files, "sftp": write_files, "database": write_database,
                              "table": write_table, "rest": write_outbox, "sap": write_outbox}


def register_sink(name: str, writer: Callable) -> None:
    SINKS[name] = writer


def write(df: DataFrame, kind: str, **options) -> None:
    """Write with a named connector."""
    if kind not in SINKS:
        raise ValueError(f"Unknown connector type: {kind}")
    SINKS[kind](df, **options)


def save_results(df: DataFrame, path: str) -> None:
    """Results as JSON below a two-digit bucket of the job id, so one job reads one directory
    while the number of directories stays fixed."""
    bucketed = df.withColumn("bucket", F.lpad(F.pmod(F.xxhash64("job_id"), F.lit(64)).cast("string"), 2, "0"))
    bucketed.write.mode("overwrite").partitionBy("bucket").json(path)


def read_result(spark: SparkSession, path: str, job_id: int, schema: str) -> DataFrame:
    """Result of one job; the bucket filter prunes the other directories."""
    bucket = F.lpad(F.pmod(F.xxhash64(F.lit(job_id).cast("bigint")), F.lit(64)).cast("string"), 2, "0")
    return spark.read.schema(f"{schema}, bucket string").json(path).filter(
        (F.col("bucket") == bucket) & (F.col("job_id") == job_id)).drop("bucket")


def rendered_format(requested: str) -> str:
    """Output format of a request: json, xml or csv, anything else json."""
    return requested if requested in ("json", "xml", "csv") else "json"


__all__ = ["SINKS", "map_fields", "map_keys", "read_result", "register_sink", "rendered_format", "save_results",
           "write", "write_database", "write_files", "write_outbox", "write_table"]
