"""Bookkeeping, source, sink and streaming queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from contract import sql as S
from fixtures import bookkeeping as B
from fixtures import render_docs as R
from leafmill.functions import catalog as C
from leafmill.operators import checks, classify, dedup, jobs, notify
from leafmill.session import shared_folder
from leafmill.sources import files, sinks
from leafmill.streaming import admission, documents, windows

QUERIES, ORACLES = {}, {}
NOW = "2024-01-31 00:00:00"


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def scratch(spark) -> str:
    """New folder for files a query writes and reads back."""
    return f"{shared_folder(spark)}/leafmill-{os.urandom(6).hex()}"


def now():
    return F.lit(NOW).cast("timestamp")


def micros(col="ts"):
    return F.unix_micros(col)


ISO = "%Y-%m-%dT%H:%M:%S"
JOBS = """jobs as (select o_orderkey as job_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'failed' end as status,
    case when substr(o_orderpriority, 1, 1)::int <= 2 then 1 when substr(o_orderpriority, 1, 1)::int = 3 then 2 else 3 end as priority,
    o_orderdate + to_seconds(o_orderkey % 86400) as created_at,
    case when o_orderstatus <> 'O' then o_orderdate + to_seconds(o_orderkey % 86400) + to_seconds(o_custkey % 60) end as started_at,
    case when o_orderstatus <> 'O' then o_orderdate + to_seconds(o_orderkey % 86400) + to_seconds(o_custkey % 60) + to_seconds(o_orderkey % 500) end as completed_at,
    case when o_orderstatus = 'P' then 'timeout' end as error, (o_custkey % 3)::int as retries from orders)"""

# --- jobs ------------------------------------------------------------------------------------


@register("job_status", f"with {JOBS} select job_id, status, 'ocr' as task_type, strftime(created_at, '{ISO}') as created_at, strftime(started_at, '{ISO}') as started_at, strftime(completed_at, '{ISO}') as completed_at, error, retries from jobs")
def _(spark, sf):
    return jobs.job_status(B.jobs(spark, sf))


@register("queue_statistics", f"with {JOBS} select status, count(*) as n_jobs, count(*) filter (status = 'pending') as queue_size from jobs group by status")
def _(spark, sf):
    return jobs.queue_statistics(B.jobs(spark, sf))


@register("next_jobs", f"with {JOBS} select job_id, priority from jobs where status = 'pending' order by priority, created_at, job_id limit 50")
def _(spark, sf):
    return jobs.next_jobs(B.jobs(spark, sf), 50).select("job_id", "priority")


_REPLAY = """with recursive a as (select user_id as job_id, ts, case event_type when 'error' then 'fail' when 'purchase' then 'complete' else 'cancel' end as outcome,
      row_number() over (partition by user_id order by ts, event_id) as i from events where event_type in ('error', 'purchase', 'signup')),
    s as (select job_id, 0::bigint as i, 0::bigint as retries, 'pending' as status from a where i = 1
      union all select s.job_id, a.i, s.retries + (outcome = 'fail')::bigint, case when outcome = 'complete' then 'completed'
        when outcome = 'fail' and s.retries + 1 < 3 then 'pending' when outcome = 'fail' then 'failed' when status = 'pending' then 'cancelled' else status end
      from s join a on a.job_id = s.job_id and a.i = s.i + 1),
    f as (select s.job_id, retries, status from s join (select job_id, max(i) as n from a group by job_id) m on m.job_id = s.job_id and m.n = s.i)"""


@register("job_status_from_attempts", f"{_REPLAY} select job_id, retries, status, last_us from f join (select job_id, epoch_us(max(ts)) as last_us from a group by job_id) using (job_id)")
def _(spark, sf):
    return jobs.folded_status(B.attempts(spark, sf)).select("job_id", "retries", "status", micros("last_ts").alias("last_us"))


@register("batch_summary", """select o_custkey as batch_id, count(*) as total_files, count(*) filter (o_orderstatus <> 'P') as successful, count(*) filter (o_orderstatus = 'P') as failed, count(*) > 10 as over_limit
    from orders group by o_custkey""")
def _(spark, sf):
    made = R.table(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id"), F.when(
        F.col("o_orderstatus") == "P", "error").otherwise("completed").alias("status"))
    return jobs.batch_summary(made)


@register("job_durations", f"with {JOBS} select priority, count(*) as n_jobs, sum(epoch_ms(completed_at) - epoch_ms(started_at))::bigint as total_ms, round(sum(epoch_ms(completed_at) - epoch_ms(started_at))::double / count(*), 4) as avg_ms from jobs where completed_at is not null group by priority")
def _(spark, sf):
    return jobs.durations(B.jobs(spark, sf), "priority").withColumn("avg_ms", F.round("avg_ms", 4))


@register("service_counters", """select count(*) as requests_total, count(*) filter (event_type <> 'error') as requests_success, count(*) filter (event_type = 'error') as requests_failed,
    count(*) filter (event_type = 'purchase') as documents_processed, sum(case when event_type = 'purchase' then json_extract(props, '$.k')::bigint end)::bigint as pages_processed,
    sum(case when event_type = 'purchase' then floor(value)::bigint end)::bigint as processing_time_total_ms from events""")
def _(spark, sf):
    kind = F.col("event_type")
    return jobs.service_counters(B.events(spark, sf), kind == "error", kind == "purchase",
                                 F.get_json_object("props", "$.k").cast("bigint"), F.floor("value"))


@register("latency_profile", """with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
    select event_type, n as iterations, min(value) as min_ms, max(value) as max_ms, round(avg(value), 6) as mean_ms, round(median(value), 6) as median_ms, round(stddev_samp(value), 6) as stdev_ms,
    max(value) filter (i = floor(n * 0.95)) as p95_ms, case when n >= 100 then max(value) filter (i = floor(n * 0.99)) end as p99_ms, round(1000 / avg(value), 6) as throughput_per_sec from r group by event_type, n""")
def _(spark, sf):
    profile = jobs.latency_profile(B.events(spark, sf), ["event_type"], "value")
    for c in ("mean_ms", "median_ms", "stdev_ms", "throughput_per_sec"):
        profile = profile.withColumn(c, F.round(c, 6))
    return profile


_STORED = """stored as (select doc_id, source as tenant_id, timestamp '2024-01-01' + to_days((doc_id % 360)::int) as created_at, floor(n_chars / 1000)::bigint + 1 as total_pages,
    strlen(text)::bigint as file_size_bytes, case when doc_id % 10 = 0 then timestamp '2024-01-06' + to_days((doc_id % 360)::int) end as deleted_at from documents)"""


@register("tenant_usage", f"""with {_STORED}, t as (select distinct source as tenant_id, regexp_extract(source, '(\\d+)', 1)::bigint % 4 + 2 as docs_limit from documents)
    select tenant_id, strftime(created_at, '%Y-%m') as month, count(*) as documents, sum(total_pages)::bigint as pages, sum(file_size_bytes)::bigint as bytes,
    count(*) > any_value(docs_limit) or sum(total_pages) > 10 or sum(file_size_bytes) > 1048576 as over_quota from stored join t using (tenant_id) group by tenant_id, month""")
def _(spark, sf):
    return jobs.tenant_usage(B.stored_documents(spark, sf), B.tenants(spark, sf))


@register("visible_documents", f"with {_STORED} select tenant_id, count(*) as n_docs from stored where deleted_at is null group by tenant_id")
def _(spark, sf):
    return jobs.visible(B.stored_documents(spark, sf)).groupBy("tenant_id").agg(F.count("*").alias("n_docs"))


@register("unexpired_rows", f"select event_id from events where ts >= timestamp '{NOW}' - interval 48 hour")
def _(spark, sf):
    return jobs.unexpired(B.events(spark, sf), F.col("ts"), now(), 48).select("event_id")


@register("audit_trail", "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type as action, count(*) as n_events, count(distinct user_id) as n_users from events group by all")
def _(spark, sf):
    return jobs.audit_trail(B.events(spark, sf), F.col("event_type"))


_KEYS = """keys as (select c_custkey as key_id, 'sk_' || md5(c_name) as secret, c_name as name, c_custkey % 5 <> 0 as is_active,
    timestamp '2024-01-01' + to_days((c_custkey % 60)::int) as expires_at from customer)"""


@register("active_keys", f"with {_KEYS} select key_id, substr(secret, 1, 8) as key_prefix, name, strftime(expires_at, '%Y-%m-%d') as expires_at from keys where is_active and expires_at > timestamp '{NOW}'")
def _(spark, sf):
    keys = B.api_keys(spark, sf).withColumn("key_prefix", checks.key_prefix(F.col("secret")))
    return jobs.active_keys(keys, now()).withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd"))


@register("key_usage", "select user_id, count(*) as total_requests, epoch_us(max(ts)) as last_used_us from events group by user_id")
def _(spark, sf):
    return jobs.key_usage(B.events(spark, sf), "user_id").select("user_id", "total_requests", micros("last_used_at").alias("last_used_us"))


# --- checks and masking --------------------------------------------------------------------------


@register("url_check", f"""with u as (select page_id, url as u from pages union all select -1 - page_id, replace(url, 'http', 'ftp') from pages union all select 100000 + page_id, '' from pages)
    select page_id, case when u = '' or regexp_matches(u, {S.pattern(C.URL_PATTERN, ignore_case=True)}) then null else 'Invalid URL format: ' || u end as error from u""")
def _(spark, sf):
    p = R.table(spark, sf, "pages").select("page_id", "url")
    other = p.select((F.lit(-1) - F.col("page_id")).alias("page_id"), F.replace("url", F.lit("http"), F.lit("ftp")).alias("url"))
    blank = p.select((F.lit(100000) + F.col("page_id")).alias("page_id"), F.lit("").alias("url"))
    return p.unionByName(other).unionByName(blank).select("page_id", checks.url_error(F.col("url")).alias("error"))


@register("limit_checks", """select o_orderkey, case when o_custkey * 10 < 100 then 'Max tokens must be at least 100' when o_custkey * 10 > 8000 then 'Max tokens cannot exceed 8000' end as tokens_error,
    case when o_custkey * 5 < 256 then 'Image size must be at least 256' when o_custkey * 5 > 4096 then 'Image size cannot exceed 4096' end as size_error,
    case when o_custkey = 0 then 'API key is required' when length(o_custkey::varchar || 'abcde') < 8 then 'API key must be at least 8 characters' end as key_error from orders""")
def _(spark, sf):
    key = F.when(F.col("o_custkey") == 0, "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit("abcde")))
    return R.table(spark, sf, "orders").select(
        "o_orderkey", checks.tokens_error(F.col("o_custkey") * 10).alias("tokens_error"),
        checks.image_size_error(F.col("o_custkey") * 5).alias("size_error"), checks.key_error(key).alias("key_error"))


@register("safe_names", """with n as (select page_id, '../x|' || page_id || '..<a>*"b?".pdf' as name from pages) select page_id, replace(replace(replace(replace(replace(replace(replace(
    regexp_extract(name, '[^/]*$'), '..', ''), '<', ''), '>', ''), '|', ''), '*', ''), '?', ''), '"', '') as safe, 'unnamed' as fallback from n""")
def _(spark, sf):
    name = F.concat(F.lit("../x|"), F.col("page_id").cast("string"), F.lit('..<a>*"b?".pdf'))
    return R.table(spark, sf, "pages").select("page_id", checks.safe_name(name).alias("safe"),
                                             checks.safe_name(F.lit("a/***"), "unnamed").alias("fallback"))


@register("masked_keys", f"with {_KEYS} select key_id, substr(secret, 1, 8) || repeat('*', length(secret) - 8) as masked, substr(secret, 1, 8) as prefix, sha256(secret) as key_hash from keys")
def _(spark, sf):
    k = F.col("secret")
    return B.api_keys(spark, sf).select("key_id", checks.masked(k).alias("masked"), checks.key_prefix(k).alias("prefix"), checks.key_hash(k).alias("key_hash"))


# --- content keys and duplicates ---------------------------------------------------------------------

_PARAMS = {"max_tokens": 2048, "dpi": 150}
_PARAM_TEXT = '{"dpi": 150, "max_tokens": 2048}'


def _docs(spark, sf):
    return R.table(spark, sf, "documents").select("doc_id", "text")


@register("cache_keys", f"select doc_id, 'ocr:' || sha256(text || '{_PARAM_TEXT}') as key from documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", dedup.cache_key(F.col("text"), _PARAMS).alias("key"))


def _keyed(spark, sf):
    return _docs(spark, sf).select("doc_id", dedup.cache_key(F.col("text")).alias("key"))


def _done(spark, sf):
    labelled = R.table(spark, sf, "labels").select("doc_id")
    return _keyed(spark, sf).join(labelled, "doc_id").select("key")


@register("cached_documents", "select doc_id from documents where sha256(text) in (select sha256(text) from documents join labels using (doc_id))")
def _(spark, sf):
    return dedup.cached(_keyed(spark, sf), _done(spark, sf)).select("doc_id")


@register("uncached_documents", "select doc_id from documents where sha256(text) not in (select sha256(text) from documents join labels using (doc_id))")
def _(spark, sf):
    return dedup.uncached(_keyed(spark, sf), _done(spark, sf)).select("doc_id")


_VALID = "select 'k' || user_id as key, epoch_us(max(ts)) as created_us, arg_max(event_id % 5, ts)::bigint as hit_count from events group by user_id having max(ts) + interval 1 hour > timestamp '2024-01-30 22:00:00'"


@register("valid_cache_entries", _VALID)
def _(spark, sf):
    found = dedup.valid_entries(B.cache_entries(spark, sf), F.lit("2024-01-30 22:00:00").cast("timestamp"))
    return found.select("key", micros("created_at").alias("created_us"), "hit_count")


@register("cache_statistics", f"with v as ({_VALID}) select count(*) as n_keys, sum(hit_count)::bigint as total_hits from v")
def _(spark, sf):
    return dedup.cache_statistics(dedup.valid_entries(B.cache_entries(spark, sf), F.lit("2024-01-30 22:00:00").cast("timestamp")))


@register("duplicate_groups", "select sha256(text) as file_hash, min(doc_id) as doc_id, count(*) as n_copies from documents group by text having count(*) > 1")
def _(spark, sf):
    return dedup.duplicate_groups(_docs(spark, sf))


@register("marked_copies", "select doc_id, sha256(text) as file_hash, min(doc_id) over (partition by text) as kept_id, min(doc_id) over (partition by text) <> doc_id as is_copy from documents")
def _(spark, sf):
    return dedup.mark_copies(_docs(spark, sf))


# --- webhooks and messages --------------------------------------------------------------------------------

_HOOKS = """hooks as (select 'wh-' || s_suppkey as id, 'https://example.com/hook/' || s_suppkey as url, sha256(s_name) as secret,
    case s_suppkey % 3 when 0 then ['error', 'purchase'] when 1 then ['signup'] else ['click', 'view', 'error'] end as events, s_suppkey % 4 <> 0 as active from supplier)"""


@register("webhook_fan_out", f"with {_HOOKS} select id as webhook_id, event_type, event_id from events e join hooks h on active and list_contains(h.events, e.event_type)")
def _(spark, sf):
    return notify.fan_out(B.events(spark, sf), B.webhooks(spark, sf)).select("webhook_id", "event_type", "event_id")


@register("webhook_listing", f"with {_HOOKS} select id, url, array_to_string(events, ',') as events, active from hooks")
def _(spark, sf):
    return notify.listed(B.webhooks(spark, sf)).withColumn("events", F.array_join("events", ","))


_PAYLOAD = "'{\"event\":\"' || event_type || '\",\"event_id\":\"' || event_id || '\",\"timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\",\"data\":' || props || '}'"


def _messages(spark, sf):
    e = B.events(spark, sf)
    payload = notify.envelope(F.col("event_type"), F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
                              F.from_json("props", "k bigint"))
    return e.select("event_id", F.concat(F.lit("wh-"), (F.col("user_id") % 5 + 1).cast("string")).alias("webhook_id"), payload.alias("payload"))


@register("webhook_payloads", f"select event_id, 'wh-' || (user_id % 5 + 1) as webhook_id, replace({_PAYLOAD}, ': ', ':') as payload from events")
def _(spark, sf):
    return _messages(spark, sf)


def _padded(number: int) -> str:
    """A 64-character secret with every byte xored with a number, as bytes."""
    return (f"(select unhex(string_agg(lpad(printf('%x', xor(ascii(substr(secret, i::int + 1, 1)), {number})), 2, '0'), '' order by i)) from range(64) r(i))")


@register("webhook_signatures", f"""with {_HOOKS}, keys as (select id, {_padded(54)} as inner_key, {_padded(92)} as outer_key from hooks),
    sent as (select event_id, 'wh-' || (user_id % 5 + 1) as webhook_id, replace({_PAYLOAD}, ': ', ':') as payload from events)
    select event_id, webhook_id, sha256(outer_key || unhex(sha256(inner_key || encode(payload)))) as signature from sent join keys on id = webhook_id""")
def _(spark, sf):
    return notify.signed_outbox(_messages(spark, sf), B.webhooks(spark, sf)).select("event_id", "webhook_id", "signature")


@register("webhook_verification", "select user_id % 2 = 0 as signature_ok, count(*) as n from events group by 1")
def _(spark, sf):
    signed = notify.signed_outbox(_messages(spark, sf), B.webhooks(spark, sf))
    even = R.table(spark, sf, "events").select("event_id", (F.col("user_id") % 2 == 0).alias("even"))
    received = signed.join(even, "event_id").select("event_id", "webhook_id", "payload", F.when(
        F.col("even"), F.col("signature")).otherwise(F.reverse("signature")).alias("received"))
    return notify.verify(received, B.webhooks(spark, sf)).groupBy("signature_ok").agg(F.count("*").alias("n"))


_DELIVERIES = "d as (select event_id as delivery_id, 'wh-' || (user_id % 20) as webhook_id, ts, event_type <> 'error' as success, (case when event_type <> 'error' then event_id % 3 + 1 else 3 end)::int as attempts from events)"


@register("delivery_totals", f"with {_DELIVERIES} select webhook_id, count(*) filter (success) as delivery_count, count(*) filter (not success) as failure_count, max(attempts) as max_attempts from d group by webhook_id")
def _(spark, sf):
    return notify.delivery_totals(B.deliveries(spark, sf))


@register("delivery_retries", f"with {_DELIVERIES}, a as (select delivery_id, unnest(range(attempts)) as attempt from d) select delivery_id, attempt::int as attempt, case when attempt < 2 then (2 ** attempt)::bigint else 0 end as wait_seconds from a")
def _(spark, sf):
    return notify.retry_schedule(B.deliveries(spark, sf))


@register("delivery_history", f"with {_DELIVERIES} select webhook_id, delivery_id from d qualify row_number() over (partition by webhook_id order by ts desc, delivery_id desc) <= 10")
def _(spark, sf):
    return notify.last_deliveries(B.deliveries(spark, sf), 10).select("webhook_id", "delivery_id")


@register("notification_channels", "select event_type, c as channel, c <> 'pager' as accepted, count(*) as n from events, (values ('email'), ('pager')) t(c) group by all")
def _(spark, sf):
    rows = notify.channel_results(B.events(spark, sf), ["email", "pager"], ["email", "slack"])
    return rows.groupBy("event_type", "channel", "accepted").agg(F.count("*").alias("n"))


def _typed_messages(spark, sf):
    kind = F.when(F.col("event_type") == "error", "document.failed").when(
        F.col("event_type") == "purchase", "document.processed").when(F.col("event_type") == "view", "export.completed").when(
        F.col("event_type") == "click", "quota.warning").otherwise("user.invited")
    number = F.col("event_id").cast("string")
    data = F.create_map(F.lit("document_id"), number, F.lit("error"), F.lit("timeout"), F.lit("pages"), F.lit("3"),
                        F.lit("processing_time"), F.lit("1s"), F.lit("export_id"), number, F.lit("format"), F.lit("csv"),
                        F.lit("records"), number, F.lit("current"), F.lit("80"), F.lit("limit"), F.lit("100"))
    return B.events(spark, sf).select("event_id", kind.alias("kind"), data.alias("data"))


_OK = C.MESSAGE_TEMPLATES["document.processed"][1]
_BAD = C.MESSAGE_TEMPLATES["document.failed"][1]
_EXPORT = C.MESSAGE_TEMPLATES["export.completed"][1]
_QUOTA = C.MESSAGE_TEMPLATES["quota.warning"][1]


@register("notification_mails", f"""select event_id, case event_type when 'error' then 'Document Processing Failed' when 'purchase' then 'Document Processing Complete'
      when 'view' then 'Data Export Complete' when 'click' then 'Usage Quota Warning' else 'Notification' end as subject,
    case event_type when 'error' then replace(replace({S.q(_BAD)}, '{{document_id}}', event_id::varchar), '{{error}}', 'timeout')
    when 'purchase' then replace(replace(replace({S.q(_OK)}, '{{document_id}}', event_id::varchar), '{{pages}}', '3'), '{{processing_time}}', '1s')
    when 'view' then replace(replace(replace({S.q(_EXPORT)}, '{{export_id}}', event_id::varchar), '{{format}}', 'csv'), '{{records}}', event_id::varchar)
    when 'click' then replace(replace({S.q(_QUOTA)}, '{{current}}', '80'), '{{limit}}', '100')
    else '<p>You have a new notification.</p>' end as body from events""")
def _(spark, sf):
    return _typed_messages(spark, sf).select("event_id", notify.mail_message(F.col("kind"), F.col("data")).alias("m")).select("event_id", "m.*")


@register("notification_chats", """select event_id, case event_type when 'error' then '#ff0000' when 'purchase' then '#36a64f' when 'view' then '#2196f3' when 'click' then '#ff9800' else '#808080' end as color,
    case event_type when 'error' then ':x: Document Processing Failed' when 'purchase' then ':white_check_mark: Document Processed'
      when 'view' then ':outbox_tray: Export Completed' when 'click' then ':warning: Quota Warning' else 'Notification' end as title,
    'Document Id=' || event_id || ',Error=timeout,Pages=3,Processing Time=1s,Export Id=' || event_id || ',Format=csv,Records=' || event_id || ',Current=80,Limit=100' as fields from events""")
def _(spark, sf):
    made = _typed_messages(spark, sf).select("event_id", notify.chat_message(F.col("kind"), F.col("data")).alias("m"))
    return made.select("event_id", "m.color", "m.title", F.array_join(F.transform(
        "m.fields", lambda f: F.concat(f["title"], F.lit("="), f["value"])), ",").alias("fields"))


# --- sources and sinks ------------------------------------------------------------------------------------------

_PAGES = """p as (select conv_id as doc_id, (turn + 1)::int as page_number, case when (conv_id + turn) % 7 = 3 then 'Error processing image: ' || turn else text end as text, length(
    case when (conv_id + turn) % 7 = 3 then 'Error processing image: ' || turn else text end) as n from conversations)"""


@register("page_outcomes", f"with {_PAGES} select doc_id, page_number, not starts_with(text, 'Error') and not starts_with(text, 'CUDA') as success, case when starts_with(text, 'Error') then text end as error_message from p")
def _(spark, sf):
    return files.with_outcome(R.page_results(spark, sf)).select("doc_id", "page_number", "success", "error_message")


@register("recognised_pages", f"with {_PAGES} select doc_id, page_number, n::varchar as text, true as success from p")
def _(spark, sf):
    pages = R.page_results(spark, sf).select("doc_id", "page_number", F.col("text").alias("image"))
    done = files.recognise(pages, lambda images: images.str.len().astype(str), "image", "doc_id bigint, page_number int", 16)
    return done.select("doc_id", "page_number", "text", "success")


@register("assembled_documents", f"with {_PAGES} select doc_id, count(*) as n_pages, md5(string_agg(chr(10) || '--- Page ' || page_number || ' ---' || chr(10) || text, chr(10) || chr(10) order by page_number, text)) as text_hash from p group by doc_id")
def _(spark, sf):
    return files.assemble(R.page_results(spark, sf)).select("doc_id", "n_pages", F.md5("text").alias("text_hash"))


_TAGS = r"(?is)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!doctype[^>]*>"
_TEXT = f"regexp_replace(regexp_replace(html, {S.q(_TAGS)}, '', 'g'), '<[^>]*>', chr(1), 'g')"
for _name, _char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&")):  # all that the pages hold
    _TEXT = f"replace({_TEXT}, '{_name}', {S.q(_char)})"


@register("web_page_text", f"select page_id, array_to_string({S.non_blank(f'string_split({_TEXT}, chr(1))')}, chr(10)) as text from pages")
def _(spark, sf):
    return R.table(spark, sf, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


@register("object_keys", """select page_id, 't' || page_id % 3 || '/2024/01/' || lpad((page_id % 28 + 1)::varchar, 2, '0') || '/' || substr(sha256(page_id || '.html'), 1, 8) || '_' || page_id || '.html' as key from pages""")
def _(spark, sf):
    return _objects(spark, sf).select("page_id", "key")


def _objects(spark, sf):
    day = F.make_date(F.lit(2024), F.lit(1), (F.col("page_id") % 28 + 1).cast("int"))
    key = files.object_key(F.concat(F.lit("t"), (F.col("page_id") % 3).cast("string")), day, F.concat(F.col("page_id").cast("string"), F.lit(".html")))
    return R.table(spark, sf, "pages").select("page_id", key.alias("key"))


@register("object_listing", """with k as (select 't' || page_id % 3 || '/2024/01/' || lpad((page_id % 28 + 1)::varchar, 2, '0') || '/' || substr(sha256(page_id || '.html'), 1, 8) || '_' || page_id || '.html' as key from pages)
    select key from k where starts_with(key, 't1/') order by key limit 20""")
def _(spark, sf):
    return files.list_objects(_objects(spark, sf), "t1/", 20).select("key")


@register("upload_records", """select doc_id, substr(sha256(substr(text, 1, 1024) || doc_id), 1, 16) as file_id, doc_id || 'ab.txt' as filename, strlen(text)::bigint as size_bytes, sha256(text) as content_hash from documents""")
def _(spark, sf):
    name = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit("a<>b.txt"))
    return _docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in files.upload_record(F.col("text"), F.col("doc_id"), name).items()])


@register("storage_statistics", """select ['uploads', 'results', 'temp'][(doc_id % 3 + 1)::int] as area, count(*) as files, sum(strlen(text))::bigint as size_bytes, round_even(sum(strlen(text)) / 1048576, 2)::double as size_mb from documents group by 1""")
def _(spark, sf):
    area = F.element_at(F.array(F.lit("uploads"), F.lit("results"), F.lit("temp")), (F.col("doc_id") % 3 + 1).cast("int"))
    return files.storage_statistics(_docs(spark, sf).select(area.alias("area"), F.octet_length("text").alias("size_bytes")))


@register("file_metadata", """select doc_id, doc_id || '.Tiff' as filename, round_even(strlen(text) / 1048576, 2)::double as file_size_mb, 'TIFF' as file_type from documents""")
def _(spark, sf):
    path = F.concat(F.lit("/data/in/"), F.col("doc_id").cast("string"), F.lit(".Tiff"))
    return _docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in files.file_metadata(path, F.octet_length("text")).items()])


@register("mapped_fields", "select o_orderkey as id, o_totalprice as amount from orders")
def _(spark, sf):
    return sinks.map_fields(R.table(spark, sf, "orders"), {"o_orderkey": "id", "o_totalprice": "amount", "missing": "x"})


@register("saved_results", "select o_orderkey as job_id, o_orderstatus as status from orders")
def _(spark, sf):
    path = scratch(spark)
    sinks.save_results(R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status")), path)
    return spark.read.schema("job_id bigint, status string, bucket string").json(path).drop("bucket")


@register("csv_drop", "select c_custkey, c_name || ', \"' || c_mktsegment || '\"' as label from customer")
def _(spark, sf):
    path = scratch(spark) + "/out"
    label = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    sinks.write(R.table(spark, sf, "customer").select("c_custkey", label.alias("label")), "sftp", path=path, fmt="csv")
    return spark.read.schema("c_custkey bigint, label string").option("header", "true").option("escape", '"').csv(path)


@register("table_sink", f"select c_custkey as id, '{NOW}' as created_at from customer")
def _(spark, sf):
    path = scratch(spark) + "/out"
    sinks.write(R.table(spark, sf, "customer"), "table", path=path, run_ts=NOW, mapping={"c_custkey": "id"})
    return spark.read.parquet(path)


@register("rest_outbox", "select '/customers' as endpoint, count(*) as n, sum(c_custkey)::bigint as key_sum from customer")
def _(spark, sf):
    path = scratch(spark) + "/out"
    sinks.write(R.table(spark, sf, "customer"), "rest", path=path, endpoint="/customers", mapping={"c_custkey": "id"})
    rows = spark.read.schema("endpoint string, body string").json(path)
    return rows.groupBy("endpoint").agg(F.count("*").alias("n"), F.sum(F.get_json_object("body", "$.id").cast("bigint")).alias("key_sum"))


@register("json_log_source", "select event_type as action, count(*) as n, sum(json_extract(props, '$.k')::bigint)::bigint as k_sum from events group by event_type")
def _(spark, sf):
    path = scratch(spark) + "/logs"
    B.events(spark, sf).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit("INFO").alias("level"),
                               F.col("event_type").alias("action"), F.from_json("props", "map<string,string>").alias("details")).write.json(path)
    logs = files.read_logs(spark, path)
    return logs.groupBy("action").agg(F.count("*").alias("n"), F.sum(F.col("details")["k"].cast("bigint")).alias("k_sum"))


# --- streams and windows ------------------------------------------------------------------------------------------------

_BUCKETS = "w as (select time_bucket(interval 5 minute, ts) as w, count(*) as n, count(*) filter (event_type = 'error') as n_failed, avg(value) as avg_value from events group by 1)"


def _failed():
    return F.col("event_type") == "error"


@register("client_keys", """select event_id, case when event_id % 3 = 0 then 'key:' || user_id when event_id % 3 = 1 then 'ip:10.0.0.' || user_id % 250 else 'ip:host' || user_id end as client from events""")
def _(spark, sf):
    kind, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    api = F.when(kind == 0, user).when(kind == 1, "")
    forwarded = F.when(kind == 1, F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" , 10.1.1.1")))
    return B.events(spark, sf).select("event_id", windows.client_key(api, forwarded, F.concat(F.lit("host"), user)).alias("client"))


@register("request_rates", f"with {_BUCKETS} select epoch_us(w) as window_us, n, n_failed, round(n / 300, 9) as rate, round(n_failed / n, 9) as error_ratio from w")
def _(spark, sf):
    r = windows.request_rates(B.events(spark, sf), _failed())
    return r.select(micros("w.start").alias("window_us"), "n", "n_failed", F.round("rate", 9).alias("rate"), F.round("error_ratio", 9).alias("error_ratio"))


@register("alert_error_ratio", f"""with {_BUCKETS}, b as (select w from w where n_failed / n > 0.05) select epoch_us(a.w) as window_us from b a where exists (select 1 from b where b.w = a.w - interval 5 minute)""")
def _(spark, sf):
    r = windows.request_rates(B.events(spark, sf), _failed()).select(F.col("w.start").alias("start"), "error_ratio")
    return windows.sustained(r, F.col("error_ratio") > 0.05, "start", 300, 2).select(micros("start").alias("window_us"))


@register("alert_slow_processing", f"with {_BUCKETS} select epoch_us(w) as window_us from w where avg_value > 60")
def _(spark, sf):
    r = B.events(spark, sf).groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.avg("value").alias("avg_value"))
    return windows.sustained(r.select(F.col("w.start").alias("start"), "avg_value"), F.col("avg_value") > 60, "start", 300, 1).select(
        micros("start").alias("window_us"))


_WIDTH = 3_600_000_000


@register("trailing_load", f"select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between {_WIDTH - 1} preceding and current row) as load from events")
def _(spark, sf):
    return windows.trailing_load(B.events(spark, sf), "user_id", micros(), _WIDTH).select("event_id", "load")


# sliding-log decisions, one request after the other (window 12 h, limit 2)
_ADMIT = """with recursive r as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
    s as (select user_id, 1::bigint as i, event_id, true as allowed, 0::bigint as retry_after, [us] as log from r where i = 1
      union all select r.user_id, r.i, r.event_id, len(kept) < 2, case when len(kept) < 2 then 0 else (kept[1] - (r.us - 43200000000)) // 1000000 + 1 end::bigint,
        case when len(kept) < 2 then kept || [r.us] else kept end
      from (select r.*, list_filter(s.log, lambda x: x > r.us - 43200000000) as kept from s join r on r.user_id = s.user_id and r.i = s.i + 1) r)
    select event_id, allowed, retry_after, case when allowed then 2 - len(log) else 0 end::bigint as remaining from s"""


@register("sliding_log_admission", _ADMIT)
def _(spark, sf):
    return admission.admit_sliding(B.events(spark, sf), "user_id", "event_id", micros(), 2, 43_200_000_000).select(
        "event_id", "allowed", "retry_after", "remaining")


_TOKENS = """with recursive r as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
    s as (select user_id, 1::bigint as i, us, event_id, true as allowed, 0.0::double as tokens from r where i = 1
      union all select n.user_id, n.i, n.us, n.event_id, t >= 1, case when t >= 1 then t - 1 else t end
      from (select r.*, least(1.0::double, s.tokens + (r.us - s.us) / 1e6::double * (1 / 60::double)) as t from s join r on r.user_id = s.user_id and r.i = s.i + 1) n)
    select event_id, allowed, round(tokens, 6) as tokens from s"""


@register("token_bucket_admission", _TOKENS)
def _(spark, sf):
    return admission.admit_bucket(B.events(spark, sf), "user_id", "event_id", micros(), 1).select(
        "event_id", "allowed", F.round("tokens", 6).alias("tokens"))


@register("client_sessions", """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
    n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as no from g)
    select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 6 hour) as end_us, count(*) as n from n group by user_id, no""")
def _(spark, sf):
    return windows.sessions(B.events(spark, sf), "user_id", 21_600).select(
        "user_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n")


FILES = 4  # of a micro-batch


def event_stream(spark, sf, late_hours: int = 0, last: str | None = None):
    """The events in four slots by time, one per micro-batch of several files, so state goes from batch to batch.  With
    ``late_hours`` rows arrive up to that many hours late, by their id.  ``last`` is the time of one more event, of no
    user, after all others, which moves the watermark past them."""
    path = scratch(spark) + "/events"
    events = B.events(spark, sf)
    arrival = F.unix_seconds("ts") + F.col("event_id") % (late_hours + 1) * 3600
    low, high = events.agg(F.min(arrival), F.max(arrival)).first()
    for k in range(4):  # one after another: the source takes files by age
        slot = F.least(F.floor((arrival - low) * 4 / (high - low + 1)), F.lit(3))
        events.where(slot == k).repartition(FILES).write.mode("append").parquet(path)
    if last:
        events.limit(1).select("event_id", F.lit(last).cast("timestamp").alias("ts"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("").alias(
            "event_type"), "value", "props").write.mode("append").parquet(path)
    return spark.readStream.option("maxFilesPerTrigger", FILES).schema(
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").parquet(path)


def collected(spark, stream, schema: str, mode: str = "append"):
    """Run a stream over what is there and read back what each batch wrote; the last version of a
    row is found by its batch number."""
    base = scratch(spark)

    def keep(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(
        keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{schema}, _batch bigint").parquet(f"{base}/out")


@register("stream_request_rates", f"with {_BUCKETS} select epoch_us(w) as window_us, n, n_failed from w")
def _(spark, sf):
    rates = windows.request_rates(event_stream(spark, sf, late_hours=24), _failed(), watermark="2 days").select(
        micros("w.start").alias("window_us"), "n", "n_failed")
    rows = collected(spark, rates, "window_us bigint, n bigint, n_failed bigint", "update")
    return rows.groupBy("window_us").agg(F.max_by("n", "_batch").alias("n"), F.max_by("n_failed", "_batch").alias("n_failed"))


@register("stream_deduplicated", "select distinct user_id, event_type from events")
def _(spark, sf):
    fresh = windows.deduplicated(event_stream(spark, sf), ["user_id", "event_type"], "40 days").select("user_id", "event_type")
    return collected(spark, fresh, "user_id bigint, event_type string").drop("_batch")


@register("stream_job_status", f"{_REPLAY} select job_id, retries, status from f")
def _(spark, sf):
    e = event_stream(spark, sf, late_hours=24).filter(F.col("event_type").isin("error", "purchase", "signup"))
    outcome = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise("cancel")
    status = jobs.folded_status(e.select(F.col("user_id").alias("job_id"), "ts", "event_id", outcome.alias("outcome"))).drop("last_ts")
    rows = collected(spark, status, "job_id bigint, retries bigint, status string", "update")
    return rows.groupBy("job_id").agg(F.max_by("retries", "_batch").alias("retries"), F.max_by("status", "_batch").alias("status"))


@register("stream_sliding_log", f"with a as ({_ADMIT}) select user_id, count(*) filter (allowed) as allowed, count(*) filter (not allowed) as denied from a join events using (event_id) group by user_id")
def _(spark, sf):
    counts = admission.stream_sliding(event_stream(spark, sf), "user_id", 2, 43_200, "1 hour")
    rows = collected(spark, counts, "user_id bigint, allowed bigint, denied bigint", "update")
    return rows.groupBy("user_id").agg(F.sum("allowed").alias("allowed"), F.sum("denied").alias("denied"))


@register("stream_documents", f"""select c_custkey as doc_id, {R.PAPER_TYPES!r}[c_custkey % 10 + 1] as document_type,
    case c_custkey % 10 when 2 then 4 when 6 then 6 when 8 then 7 when 9 then 7 end::bigint as n_fields, 1::bigint as n_pages from customer""")
def _(spark, sf):
    base = scratch(spark)
    R.papers(spark, sf).repartition(8).write.parquet(f"{base}/in")
    stream = documents.read_new_documents(spark, f"{base}/in", "doc_id bigint, text string", files_per_batch=2)
    listed = F.col("document_type").isin("contract", "id_document", "tax_document", "medical")
    rows = documents.stream_records(stream).select("doc_id", "document_type", F.when(listed, F.size("extracted_fields").cast(
        "bigint")).alias("n_fields"), F.size("pages").cast("bigint").alias("n_pages"))
    documents.run_available(rows, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


# --- files and results as they lie in a folder ---------------------------------------------------


@register("scanned_files", "select n_nationkey::bigint as nation, 1::bigint as n_files from nation")
def _(spark, sf):
    path = scratch(spark)
    R.table(spark, sf, "nation").repartition(1).write.partitionBy("n_nationkey").json(path)
    found = files.scan_files(spark, path).select(F.regexp_extract("path", r"n_nationkey=(\d+)/part-.*\.json$", 1).alias("key"), "length")
    return found.where("key <> '' and length > 0").groupBy(F.col("key").cast("bigint").alias("nation")).agg(F.count("*").alias("n_files"))


@register("texts_from_files", "select n_nationkey::bigint as nation, n_name || chr(10) || 'second line' || chr(10) as text from nation")
def _(spark, sf):
    path = scratch(spark)
    R.table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("\nsecond line")).alias("value")).repartition(
        1).write.partitionBy("n_nationkey").text(path)
    return files.read_texts(spark, f"{path}/*", "text").select(
        F.regexp_extract("doc_id", r"n_nationkey=(\d+)", 1).cast("bigint").alias("nation"), "text")


@register("texts_from_tables", "select doc_id, md5(text) as text_hash from documents")
def _(spark, sf):
    return files.read_texts(spark, f"{sf}/documents.parquet").select("doc_id", F.md5("text").alias("text_hash"))


@register("saved_result_of_one", "select o_orderkey as job_id, o_orderstatus as status from orders where o_orderkey = (select max(o_orderkey) from orders)")
def _(spark, sf):
    path, orders = scratch(spark), R.table(spark, sf, "orders")
    sinks.save_results(orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status")), path)
    wanted = orders.agg(F.max("o_orderkey")).first()[0]
    return sinks.read_result(spark, path, wanted, "job_id bigint, status string")


@register("rendered_formats", """select c_custkey, case c_custkey % 4 when 0 then 'xml' when 1 then 'csv' else 'json' end as format from customer""")
def _(spark, sf):
    asked = ["xml", "csv", "pdf", "json"]
    made = F.array(*[F.lit(sinks.rendered_format(a)) for a in asked])
    return R.table(spark, sf, "customer").select("c_custkey", F.element_at(made, (F.col("c_custkey") % 4 + 1).cast("int")).alias("format"))


@register("accepted_files", """select p_partkey, p_partkey % 5 in (0, 1, 4) as accepted from part""")
def _(spark, sf):
    names = F.array(*[F.lit(e) for e in (".docx", ".PPTX", ".exe", "", ".tiff")])
    name = F.concat(F.lit("dir/"), F.col("p_name"), F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")))
    return R.table(spark, sf, "part").select("p_partkey", files.accepted(name).alias("accepted"))


@register("stream_batches", "select event_type, count(*) as n, 4::bigint as n_batches from events group by event_type")
def _(spark, sf):
    base = scratch(spark)

    def write(batch, number):
        batch.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    documents.run_batches(event_stream(spark, sf), write, f"{base}/checkpoint")
    rows = spark.read.parquet(f"{base}/out")
    return rows.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("n_batches"))


@register("alert_gauge", """with h as (select date_trunc('day', ts) as d, min(value) as low from events where event_type = 'purchase' group by 1),
    b as (select d from h where low > 0.2) select epoch_us(a.d) as window_us from b a join b p on p.d = a.d - interval 1 day""")
def _(spark, sf):
    readings = B.events(spark, sf).where("event_type = 'purchase'").select("ts", "value")
    return windows.gauge_alert(readings, "value", 0.2, True, "1 day", 86_400, 2).select(micros("start").alias("window_us"))


@register("alert_backlog", f"""with {JOBS}, steps as (select created_at as ts, 1 as d from jobs union all select started_at, -1 from jobs where started_at is not null),
    m as (select floor(epoch(ts) / 86400)::bigint as slot, sum(d) as moved from steps group by 1),
    q as (select slot, sum(coalesce(moved, 0)) over (order by slot) as waiting from (select unnest(range((select min(slot) from m), (select max(slot) from m) + 1)) as slot) left join m using (slot)),
    b as (select slot from q where waiting > 100)
    select a.slot * 86400000000 as window_us from b a where (select count(*) from b p where p.slot between a.slot - 4 and a.slot) = 5""")
def _(spark, sf):
    length = windows.queue_length(B.jobs(spark, sf), 86_400)
    return windows.sustained(length, F.col("waiting") > 100, "start", 86_400, 5).select(micros("start").alias("window_us"))
