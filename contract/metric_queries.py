"""Queries over streams of alerts, sessions and buckets, clean-up, audit records and mergeable sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.grid_queries import scratch_database
from contract.service_queries import _BUCKETS, _TOKENS, collected, event_stream, micros
from fixtures import bookkeeping as B
from leafmill.operators import audit, sketches
from leafmill.sources import partitions
from leafmill.streaming import admission, windows

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


# --- streams -----------------------------------------------------------------------------------


#: A time after all events and delays: an event then closes all windows.
LAST = "2030-01-01 00:00:00"


@register("stream_alerts", f"""with {_BUCKETS}, b as (select w from w where n_failed / n > 0.05)
    select epoch_us(a.w) as window_us from b a where exists (select 1 from b where b.w = a.w - interval 5 minute)""")
def _(spark, sf):
    alerts = windows.stream_sustained(event_stream(spark, sf, late_hours=24, last=LAST), F.col("event_type") == "error", 0.05, "5 minutes", 2, "2 days")
    return collected(spark, alerts.select(micros("start").alias("window_us")), "window_us bigint").select("window_us")


@register("stream_sessions", """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
    n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as no from g)
    select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 6 hour) as end_us, count(*) as n from n group by user_id, no""")
def _(spark, sf):
    found = windows.stream_sessions(event_stream(spark, sf, late_hours=24, last=LAST), "user_id", "6 hours", "2 days").select(
        "user_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n")
    return collected(spark, found, "user_id bigint, start_us bigint, end_us bigint, n bigint").drop("_batch")


@register("stream_token_bucket", f"""with a as ({_TOKENS}) select user_id, count(*) filter (allowed) as allowed, count(*) filter (not allowed) as denied
    from a join events using (event_id) group by user_id""")
def _(spark, sf):
    counts = admission.stream_bucket(event_stream(spark, sf), "user_id", 1, "1 hour")
    rows = collected(spark, counts, "user_id bigint, allowed bigint, denied bigint", "update")
    return rows.groupBy("user_id").agg(F.sum("allowed").alias("allowed"), F.sum("denied").alias("denied"))


# --- clean-up ------------------------------------------------------------------------------------


@register("cleaned_up", """select 't' || user_id % 3 as tenant, event_id, epoch_us(ts) as ts_us from events where ts >= (select date_trunc('day', min(ts)) + interval 255 hour from events)""")
def _(spark, sf):
    table = f"{scratch_database(spark)}.kept"
    events = B.events(spark, sf)
    tenant = F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string"))
    partitions.write_by_day(events.select("event_id", "ts", tenant.alias("tenant")), table, F.col("ts"), ("tenant",))
    cutoff = events.select(F.date_format(F.date_trunc("day", F.min("ts")) + F.expr("interval 255 hours"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    partitions.clean_up(spark, table, "ts", cutoff)
    return spark.table(table).select("tenant", "event_id", micros().alias("ts_us"))


# --- sketches ------------------------------------------------------------------------------------


RANKS = {"median": 0.5, "p95": 0.95, "p99": 0.99}


@register("latency_sketches", """select event_type, count(value) as n, min(value) as low, max(value) as high, round(avg(value), 6) as mean,
    true as median_ok, true as p95_ok, true as p99_ok from events group by event_type""")
def _(spark, sf):
    events = B.events(spark, sf)
    stored = sketches.quantile_sketches(events.withColumn("day", F.to_date("ts")), ["event_type", "user_id", "day"], "value")
    found = sketches.quantiles(sketches.merged_quantiles(stored, ["event_type"]), ["event_type"], RANKS)
    told = events.join(found, "event_type").groupBy("event_type", "n", "low", "high", "mean").agg(*[
        ((F.count_if(F.col("value") < F.col(q)) <= (p + 2 * sketches.RANK_ERROR) * F.col("n"))
         & (F.count_if(F.col("value") <= F.col(q)) >= (p - 2 * sketches.RANK_ERROR) * F.col("n"))).alias(f"{q}_ok") for q, p in RANKS.items()])
    return told.withColumn("mean", F.round("mean", 6))


@register("frequent_users", "select event_type, user_id, count(*) as n, true as within_bound from events group by all")
def _(spark, sf):
    events = B.events(spark, sf)
    stored = sketches.frequent_sketches(events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id", 10_000)
    found = sketches.frequent_items(sketches.merged_frequent(stored, ["event_type"], 10_000), ["event_type"], 10_000, 10_000)
    exact = events.groupBy("event_type", F.col("user_id").alias("item")).agg(F.count("*").alias("n"))
    return exact.join(found, ["event_type", "item"], "left").select(
        "event_type", F.col("item").alias("user_id"), "n", (F.col("count") - F.col("n")).between(0, F.col("bound")).alias("within_bound"))


# --- audit records -------------------------------------------------------------------------------

_KIND = "['document', 'job', 'key'][(event_id % 3 + 1)::int]"
_OUTCOME = "case when event_id % 5 = 4 then null when event_type = 'error' then 'failed' else 'ok' end"


def _audit_logs(spark, sf):
    """Records of the events whose details come in five shapes, one of them without an outcome, some no JSON."""
    e = B.events(spark, sf)
    kind = F.element_at(F.array(F.lit("document"), F.lit("job"), F.lit("key")), (F.col("event_id") % 3 + 1).cast("int"))
    outcome = F.when(F.col("event_type") == "error", "failed").otherwise("ok")
    key, shape = F.col("event_id").cast("string"), F.col("event_id") % 5
    nested = F.to_json(F.struct(F.struct(kind.alias("type"), key.alias("id")).alias("resource"), outcome.alias("outcome"), F.col("value").alias("ms")))
    result = F.to_json(F.struct(kind.alias("resource_type"), F.col("event_id").alias("resource_id"), F.struct(outcome.alias("status")).alias("result")))
    flat = F.to_json(F.struct(kind.alias("resource_type"), key.alias("target"), outcome.alias("status"), F.array(F.lit("a"), F.lit("b")).alias("tags")))
    bare = F.to_json(F.struct(kind.alias("resource_type")))
    details = F.when(shape == 0, nested).when(shape == 1, result).when(shape == 2, flat).when(shape == 3, F.lit("{no json")).otherwise(bare)
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("action"), details.alias("details"))


@register("audit_records", f"""select event_id, event_type as action, case when event_id % 5 <> 3 then {_KIND} end as resource_type,
    case when event_id % 5 < 3 then event_id::varchar end as resource_id, case when event_id % 5 < 3 then {_OUTCOME} end as outcome,
    case when event_id % 5 = 0 then value end as ms from events""")
def _(spark, sf):
    records = audit.audit_records(_audit_logs(spark, sf), ["event_id", "action"])
    return audit.with_path(records, "ms", "$.ms", "double").drop("details")


@register("audit_by_resource", f"""select event_type as action, case when event_id % 5 <> 3 then {_KIND} end as resource_type, case when event_id % 5 < 3 then {_OUTCOME} end as outcome,
    count(*) as n_events, count(distinct user_id) as n_users, true as estimate_ok from events group by all""")
def _(spark, sf):
    records = audit.audit_records(_audit_logs(spark, sf), ["action", "user_id", F.to_date("ts").alias("day")])
    keys = ["action", "resource_type", "outcome"]
    merged = audit.merged_summary(audit.audit_summary(records, [*keys, "day"], "user_id"), keys)
    exact = records.groupBy(*keys).agg(F.count_distinct("user_id").alias("n_exact"))
    same = F.lit(True)
    for k in keys:
        same = same & merged[k].eqNullSafe(exact[k])
    off = F.abs(F.col("n_users") - F.col("n_exact")) / F.col("n_exact")
    return merged.join(exact, same).select(*[merged[k] for k in keys], "n_events", F.col("n_exact").alias("n_users"),
                                           (off <= 4 * audit.DISTINCT_ERROR).alias("estimate_ok"))


@register("audit_schemas", """select unnest(['failed', 'ok']) as outcome, 'OBJECT<resource_type: STRING, status: STRING, tags: ARRAY<STRING>, target: STRING>' as schema""")
def _(spark, sf):
    records = audit.audit_records(_audit_logs(spark, sf), ["action"])
    return audit.details_schemas(records.where(F.try_variant_get("details", "$.target", "string").isNotNull()), ["outcome"])
