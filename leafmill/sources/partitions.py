"""Tables in partitions of tenant and day, and their clean-up."""

from __future__ import annotations

import uuid
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import shared_folder


def write_by_day(rows: DataFrame, table: str, ts: Column, by: tuple[str, ...] = ()) -> None:
    """Append rows to a table in partitions of ``by`` and the day of ``ts``, one file per partition and task that holds
    rows of it.  Rows without a time go to the default partition, which no clean-up touches."""
    dated = rows.withColumn("day", F.to_date(ts))
    dated.write.partitionBy(*by, "day").mode("append").saveAsTable(table)


def _specs(spark: SparkSession, table: str) -> list[dict[str, str]]:
    """The table's partitions, as the catalogue lists them."""
    rows = spark.sql(f"show partitions {table}").collect()
    return [dict((unquote(kv.split("=", 1)[0]), unquote(kv.split("=", 1)[1])) for kv in r[0].split("/")) for r in rows]


def _drop(spark: SparkSession, table: str, specs: list[dict[str, str]]) -> None:
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    told = ["partition (" + ", ".join(f"`{k}` = {quote(v)}" for k, v in spec.items()) + ")" for spec in specs]
    for k in range(0, len(told), 500):
        spark.sql(f"alter table {table} drop if exists " + ", ".join(told[k:k + 500]))


def clean_up(spark: SparkSession, table: str, ts: str, cutoff: str) -> dict[str, int]:
    """Remove the rows of ``write_by_day`` older than ``cutoff`` (yyyy-MM-dd HH:mm:ss, UTC).

    Partitions of earlier days are dropped whole, unread.  Those of the cutoff's own day are rewritten with the rows
    that stay, by way of a staged copy and a dynamic overwrite that
    replaces nothing else, or dropped if none stays.  Later ones stay as they
    are, files untouched.  Running it again changes nothing.  Returns how many partitions were dropped and rewritten."""
    edge = datetime.fromisoformat(cutoff)
    day = edge.date().isoformat()
    days = [s for s in _specs(spark, table) if s["day"] != "__HIVE_DEFAULT_PARTITION__"]
    expired = [s for s in days if s["day"] < day]
    boundary = [s for s in days if s["day"] == day]
    _drop(spark, table, expired)
    rewritten = []
    if boundary and edge.time() != datetime.min.time():
        by = [k for k in boundary[0] if k != "day"]
        own = spark.table(table).where(F.col("day") == F.lit(day).cast("date"))
        staged = f"{shared_folder(spark)}/cleanup-{uuid.uuid4().hex[:12]}"  # a table can't be read while it is replaced
        own.where(F.col(ts) >= F.lit(cutoff).cast("timestamp")).write.parquet(staged)
        left = spark.read.schema(own.schema).parquet(staged)
        staying = {tuple(str(v) for v in r) for r in left.select(*by).distinct().collect()} if by else {()} if not left.isEmpty() else set()
        rewritten = [s for s in boundary if tuple(s[k] for k in by) in staying]
        if rewritten:
            mode = "spark.sql.sources.partitionOverwriteMode"  # a table takes it from the session, not from the writer
            before = spark.conf.get(mode)
            spark.conf.set(mode, "dynamic")
            try:
                left.write.mode("overwrite").insertInto(table)
            finally:
                spark.conf.set(mode, before)
        _drop(spark, table, [s for s in boundary if s not in rewritten])
        expired += [s for s in boundary if s not in rewritten]
    return {"dropped": len(expired), "rewritten": len(rewritten)}
