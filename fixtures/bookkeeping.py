"""Service tables derived from ``orders``, ``events`` and others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures.render_docs import table


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job per order: status from the order status, priority 1-3 from the order priority,
    start and end some seconds after creation."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    created = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("double"))
    started = F.when(F.col("o_orderstatus") != "O", created + F.make_dt_interval(secs=(F.col("o_custkey") % 60).cast("double")))
    done = started + F.make_dt_interval(secs=(F.col("o_orderkey") % 500).cast("double"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.lit("ocr").alias("task_type"), status.alias("status"),
        F.when(digit <= 2, 1).when(digit == 3, 2).otherwise(3).alias("priority"), created.alias("created_at"),
        started.alias("started_at"), done.alias("completed_at"),
        F.when(status == "failed", "timeout").alias("error"), (F.col("o_custkey") % 3).cast("int").alias("retries"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a plain timestamp (UTC session)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job attempts: the user is the job; errors fail, purchases complete, signups cancel."""
    src = events(spark, sf_dir).filter(F.col("event_type").isin("error", "purchase", "signup"))
    outcome = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise("cancel")
    return src.select(F.col("user_id").alias("job_id"), "ts", "event_id", outcome.alias("outcome"))


def webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A webhook per supplier: event lists by key, every fourth one inactive."""
    key = F.col("s_suppkey")
    lists = F.when(key % 3 == 0, F.array(F.lit("error"), F.lit("purchase"))).when(
        key % 3 == 1, F.array(F.lit("signup"))).otherwise(F.array(F.lit("click"), F.lit("view"), F.lit("error")))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("wh-"), key.cast("string")).alias("id"),
        F.concat(F.lit("https://example.com/hook/"), key.cast("string")).alias("url"),
        F.sha2("s_name", 256).alias("secret"), lists.alias("events"), (key % 4 != 0).alias("active"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivery per event: the user's number picks the webhook."""
    src = events(spark, sf_dir)
    ok = F.col("event_type") != "error"
    return src.select(F.col("event_id").alias("delivery_id"), F.concat(F.lit("wh-"), (F.col("user_id") % 20).cast("string")).alias("webhook_id"),
                      "ts", ok.alias("success"), F.when(ok, F.col("event_id") % 3 + 1).otherwise(3).cast("int").alias("attempts"))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document catalogue: tenant = source, dates spread over a year, some deleted."""
    day = F.make_dt_interval(days=(F.col("doc_id") % 360).cast("int"))
    created = F.lit("2024-01-01 00:00:00").cast("timestamp") + day
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("tenant_id"), created.alias("created_at"),
        (F.floor(F.col("n_chars") / 1000) + 1).cast("bigint").alias("total_pages"),
        F.octet_length("text").cast("bigint").alias("file_size_bytes"),
        F.when(F.col("doc_id") % 10 == 0, created + F.make_dt_interval(days=F.lit(5))).alias("deleted_at"))


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits per source."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("bigint")
    return table(spark, sf_dir, "documents").select("source").distinct().select(
        F.col("source").alias("tenant_id"), (number % 4 + 2).alias("monthly_document_limit"),
        F.lit(10).alias("monthly_page_limit"), F.lit(1).alias("storage_limit_mb"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache write per event: key by user, one hour to live."""
    return events(spark, sf_dir).select(
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(hours=F.lit(1))).alias("expires_at"),
        (F.col("event_id") % 5).cast("bigint").alias("hit_count"))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An API key per customer."""
    key = F.concat(F.lit("sk_"), F.md5("c_name"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key_id"), key.alias("secret"), F.col("c_name").alias("name"),
        (F.col("c_custkey") % 5 != 0).alias("is_active"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(days=(F.col("c_custkey") % 60).cast("int"))).alias("expires_at"))
