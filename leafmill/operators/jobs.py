"""Job, latency, usage, audit and key bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import catalog as C


def job_status(jobs: DataFrame) -> DataFrame:
    """Status listing with ISO timestamps; add ``.filter(job_id = …)`` for one job."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return jobs.select("job_id", "status", "task_type", *[
        F.date_format(c, iso).alias(c) for c in ("created_at", "started_at", "completed_at")], "error", "retries")


def queue_statistics(jobs: DataFrame) -> DataFrame:
    """Jobs per status; waiting jobs also counted as queue size."""
    return jobs.groupBy("status").agg(F.count("*").alias("n_jobs"), F.count_if(F.col("status") == "pending").alias("queue_size"))


def next_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """Waiting jobs in the order they would be taken: priority (1 first), age, id.
    A top-n: each task keeps n rows, so nothing is sorted as a whole."""
    return jobs.filter(F.col("status") == "pending").orderBy("priority", "created_at", "job_id").limit(n)


def folded_status(attempts: DataFrame, max_retries: int = C.MAX_JOB_RETRIES) -> DataFrame:
    """Retries, status and last time per job from its attempt events (job_id, ts, event_id, outcome complete | fail |
    cancel); events of one time are taken by their id.

    Counts and maxima only, so map-side combining carries most of the work and the same aggregate runs on a
    stream.  The last outcome that is no cancel decides: a completion completes, a failure fails the job or, before
    the last retry, makes it wait again.  A cancel counts only if it comes while the job waits.
    """
    at, cancel = F.struct("ts", "event_id"), F.col("outcome") == "cancel"
    folded = attempts.groupBy("job_id").agg(
        F.count_if(F.col("outcome") == "fail").alias("retries"), F.max("ts").alias("last_ts"),
        F.max(F.when(~cancel, F.struct(at.alias("at"), "outcome"))).alias("last"), F.max(F.when(cancel, at)).alias("cancelled"))
    waits = F.col("last").isNull() | (F.col("cancelled") > F.col("last.at"))
    status = (F.when(F.col("last.outcome") == "complete", "completed")
              .when(F.col("retries") >= max_retries, "failed")
              .when(F.col("cancelled").isNotNull() & waits, "cancelled").otherwise("pending"))
    return folded.select("job_id", "retries", status.alias("status"), "last_ts")


def batch_summary(files: DataFrame, limit: int = C.BATCH_FILE_LIMIT) -> DataFrame:
    """Per batch: total, successful, failed, and whether it holds more files than allowed."""
    ok = F.col("status") == "completed"
    return files.groupBy("batch_id").agg(
        F.count("*").alias("total_files"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed")
    ).withColumn("over_limit", F.col("total_files") > limit)


def durations(jobs: DataFrame, group: str) -> DataFrame:
    """Processing time per group; the mean is guarded against empty groups."""
    ms = F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("completed_at"))
    done = jobs.filter(F.col("completed_at").isNotNull()).withColumn("_ms", ms)
    return done.groupBy(group).agg(F.count("*").alias("n_jobs"), F.sum("_ms").alias("total_ms")).withColumn(
        "avg_ms", F.col("total_ms") / F.greatest(F.col("n_jobs"), F.lit(1)))


def service_counters(events: DataFrame, failed: Column, document: Column, pages: Column, ms: Column) -> DataFrame:
    """One row of running totals."""
    return events.agg(
        F.count("*").alias("requests_total"), F.count_if(~failed).alias("requests_success"),
        F.count_if(failed).alias("requests_failed"), F.count_if(document).alias("documents_processed"),
        F.sum(F.when(document, pages)).alias("pages_processed"),
        F.sum(F.when(document, ms)).alias("processing_time_total_ms"))


def _ranked(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values of each group with the ranks they cover (``_from`` < rank <= ``_to``).

    Equal values are counted first.  Groups are then cut into value ranges of about equal
    weight, ranks are summed inside a range and shifted by the ranges before it, so one
    large group is spread over many tasks.
    """
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    parts = 256
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx(value, [i / parts for i in range(1, parts)], 10000).alias("_cuts"))
    placed = counts.join(cuts, keys).withColumn(
        "_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sized = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sized.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    to = F.sum("_n").over(inside)
    return placed.withColumn("_in", to).join(shifts.drop("_size"), [*keys, "_part"]).select(
        *keys, value, (F.col("_shift") + F.col("_in") - F.col("_n")).alias("_from"),
        (F.col("_shift") + F.col("_in")).alias("_to"))


def latency_profile(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, max, mean, median, sample deviation, p95, p99 (from 100 values on) and throughput.

    Percentiles are exact order statistics ``sorted[int(n * p)]``; the median of an even
    count is the mean of the middle two.
    """
    base = values.groupBy(*keys).agg(
        F.count(value).alias("iterations"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"),
        F.avg(value).alias("mean_ms"), F.stddev_samp(value).alias("stdev_ms"))
    n = F.col("iterations")
    marks = {"p95_ms": F.floor(n * 0.95), "p99_ms": F.floor(n * 0.99), "_lo": F.floor((n - 1) / 2), "_hi": F.floor(n / 2)}
    ranked = _ranked(values.filter(F.col(value).isNotNull()), keys, value).join(base.select(*keys, "iterations"), keys)
    picked = ranked.groupBy(*keys).agg(*[
        F.max(F.when((F.col("_from") <= at) & (at < F.col("_to")), F.col(value))).alias(name)
        for name, at in marks.items()])
    return base.join(picked, keys).select(
        *keys, "iterations", "min_ms", "max_ms", "mean_ms", ((F.col("_lo") + F.col("_hi")) / 2).alias("median_ms"),
        F.when(n > 1, F.col("stdev_ms")).otherwise(0.0).alias("stdev_ms"), "p95_ms",
        F.when(n >= 100, F.col("p99_ms")).alias("p99_ms"), (F.lit(1000.0) / F.col("mean_ms")).alias("throughput_per_sec"))


def tenant_usage(docs: DataFrame, tenants: DataFrame) -> DataFrame:
    """Documents, pages and storage per tenant and month against the tenant's limits.

    Usage is aggregated before the join, so the join sees one row per tenant and month.  A tenant without limits, or
    with a NULL one, is never over it.
    """
    used = docs.groupBy("tenant_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("documents"), F.sum("total_pages").alias("pages"),
        F.sum("file_size_bytes").alias("bytes"))
    joined = used.join(tenants, "tenant_id", "left")
    over = [F.col("documents") > F.col("monthly_document_limit"), F.col("pages") > F.col("monthly_page_limit"),
            F.col("bytes") > F.col("storage_limit_mb") * F.lit(1024 * 1024)]
    return joined.select("tenant_id", "month", "documents", "pages", "bytes", F.exists(
        F.array(*over), lambda x: F.coalesce(x, F.lit(False))).alias("over_quota"))


def unexpired(rows: DataFrame, ts: Column, now: Column, hours: int) -> DataFrame:
    """Rows at most ``hours`` old; the complement is what a clean-up removes."""
    return rows.filter(ts >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def audit_trail(events: DataFrame, action: Column, width: str = "1 day") -> DataFrame:
    """Events per action and window with the number of distinct users."""
    return events.groupBy(F.window("ts", width).alias("w"), action.alias("action")).agg(
        F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "action", "n_events", "n_users")


def visible(rows: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return rows.filter(F.col("deleted_at").isNull())


def active_keys(keys: DataFrame, now: Column) -> DataFrame:
    """Usable API keys, without hash or secret."""
    live = F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return keys.filter(live).select("key_id", "key_prefix", "name", "expires_at")


def key_usage(events: DataFrame, key: str) -> DataFrame:
    """Requests and last use per key."""
    return events.groupBy(key).agg(F.count("*").alias("total_requests"), F.max("ts").alias("last_used_at"))
