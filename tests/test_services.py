import hashlib
import hmac
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from contract import markup_queries, service_queries, text_queries
from leafmill.operators import dedup, jobs, notify
from leafmill.plans import render, workflow
from leafmill.session import shared_folder
from leafmill.sources import files, sinks
from leafmill.streaming import admission, windows

SF = "/root/testdata/sf0.001"


def test_hmac_equals_stdlib(spark):
    secrets = ["s", "x" * 64, "long " * 40, "schlüssel"]
    hooks = spark.createDataFrame([(str(i), s) for i, s in enumerate(secrets)], "id string, secret string")
    messages = spark.createDataFrame([(str(i), f'{{"n":"é{i}"}}') for i in range(4)], "webhook_id string, payload string")
    for r in notify.signed_outbox(messages, hooks).collect():
        want = hmac.new(secrets[int(r.webhook_id)].encode(), r.payload.encode(), hashlib.sha256).hexdigest()
        assert r.signature == want


def test_fan_out_of_one_file_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(notify, "BLOCK_BITS", 2)
    lists = [["a", "b"], ["a", "a"], ["b", None], None, [], ["c"]]
    hooks = [(None if i % 9 == 8 else f"w{i % 20}", lists[i % 6], i % 4 != 0) for i in range(40)]
    events = [(i, [None, "a", "b", "d"][i % 4]) for i in range(50)] + [(1, "a")]
    want = sorted((str(w), t, e) for e, t in events for w, found, active in hooks if active and t and t in (found or []))
    frames = (spark.createDataFrame(events, "event_id long, event_type string").coalesce(1),
              spark.createDataFrame(hooks, "id string, events array<string>, active boolean"))
    got = notify.fan_out(*frames)
    assert got.columns == ["event_type", "event_id", "webhook_id"]
    assert sorted((str(r.webhook_id), r.event_type, r.event_id) for r in got.collect()) == want
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def _requests(seed, skew):
    rng, rows, number = random.Random(seed), [], 0
    for user in range(3):
        at = 0
        for _ in range(600 * (skew if user == 0 else 1)):
            at += int(rng.expovariate(1 / (2e6 if (at // 600_000_000) % 2 else 30e6)))
            rows.append((number, user, at))
            number += 1
            if rng.random() < 0.05:
                rows.append((number, user, at))
                number += 1
    return rows


@pytest.mark.parametrize("limit", [1, 3, 12])
def test_admission_equals_replay_one_by_one(spark, limit):
    rows = _requests(limit, 3)
    frame = spark.createDataFrame(rows, "event_id long, user_id long, us long").repartition(5)
    width = 60_000_000
    for factory, result, columns in (
            (admission.sliding_log(limit, width), admission.admit_sliding(frame, "user_id", "event_id", F.col("us"), limit, width),
             ("allowed", "retry_after", "remaining")),
            (admission.token_bucket(limit / 60, limit), admission.admit_bucket(frame, "user_id", "event_id", F.col("us"), limit),
             ("allowed", "tokens", "retry_after"))):
        want = {}
        for user in range(3):
            step = factory()
            for number, _, at in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
                want[number] = step(at)
        got = {r.event_id: tuple(r[c] for c in columns) for r in result.collect()}
        assert got.keys() == want.keys()
        for number, values in want.items():
            assert got[number] == pytest.approx(values, abs=1e-6), number


def _replayed(rows, step):
    return {number: step(at) for number, _, at in sorted(rows, key=lambda r: (r[2], r[0]))}


@pytest.mark.parametrize("rounds", [6, 1])
def test_long_stretches_are_cut_and_repaired(spark, monkeypatch, rounds):
    """Segments of 40 requests, whose states meet late, early or (evenly spaced requests) never."""
    monkeypatch.setattr(admission, "SEGMENT", 40)
    monkeypatch.setattr(admission, "ROUNDS", rounds)
    rng, rows, at = random.Random(5), [], 0
    for user, gap in ((0, lambda: int(rng.expovariate(1 / 7e6))), (1, lambda: 7_000_000), (2, lambda: int(rng.expovariate(1 / 25e6)))):
        at = 0
        for _ in range(500):
            at += gap()
            rows.append((len(rows) + 2**60, user, at))
    frame = spark.createDataFrame(rows, "event_id long, user_id long, us long").repartition(5)
    for factory, result, columns in (
            (admission.sliding_log(3, 60_000_000), admission.admit_sliding(frame, "user_id", "event_id", F.col("us"), 3, 60_000_000),
             ("allowed", "retry_after", "remaining")),
            (admission.token_bucket(3 / 60, 3), admission.admit_bucket(frame, "user_id", "event_id", F.col("us"), 3),
             ("allowed", "tokens", "retry_after"))):
        want = {}
        for user in range(3):
            want |= _replayed([r for r in rows if r[1] == user], factory())
        got = {r.event_id: tuple(r[c] for c in columns) for r in result.collect()}
        assert got.keys() == want.keys()
        assert all(got[n] == pytest.approx(want[n], abs=1e-9) for n in want)


def test_one_overloaded_key_is_replayed_by_many_tasks(spark, caplog):
    """A million requests of one key, ten times its limit without a break."""
    caplog.set_level("INFO", logger=admission.__name__)
    n, width = 1_000_000, 60_000_000
    gap = 20_000_000 * (F.xxhash64("id") % 1000 + 1000) / 2000
    requests = spark.range(n).select(F.col("id").alias("event_id"), F.lit("k").alias("user_id"),
                                     (F.col("id") * 10_000_000 + F.floor(gap)).alias("us"))
    times = sorted((r.us, r.event_id) for r in requests.toLocalIterator())
    step = admission.sliding_log(1, width)()
    want = {number: step(at)[0] for at, number in times}
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = admission.admit_sliding(requests, "user_id", "event_id", F.col("us"), 1, width).select(
            "event_id", "allowed", F.spark_partition_id().alias("task")).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got["task"].nunique() >= 8 and got.groupby("task").size().max() < n / 4
    assert dict(zip(got["event_id"].tolist(), got["allowed"].tolist(), strict=True)) == want
    rounds = [r.args for r in caplog.records if r.name == admission.__name__]
    assert rounds[-1][1] == 0 and sum(o for _, o in rounds) <= 3 * rounds[0][1]  # work: a few times the segments


def test_five_of_seven_requests(spark):
    frame = spark.createDataFrame([(i, "test", i * 1000) for i in range(7)], "event_id long, user_id string, us long")
    rows = admission.admit_sliding(frame, "user_id", "event_id", F.col("us"), 5, 10_000_000).orderBy("event_id").collect()
    assert [r.allowed for r in rows] == [True] * 5 + [False] * 2 and rows[-1].retry_after == 10


def test_trailing_load_has_an_open_lower_bound(spark):
    frame = spark.createDataFrame([(0, 1, 0), (1, 1, 10), (2, 1, 19), (3, 1, 10)], "event_id long, k long, us long")
    rows = windows.trailing_load(frame, "k", F.col("us"), 10).orderBy("event_id").collect()
    assert [r.load for r in rows] == [1, 2, 3, 2]


def test_order_statistics(spark):
    rng = random.Random(3)
    values = [float(rng.randint(0, 50)) for _ in range(1001)] + [7.5] * 500
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 4.0)], "g string, v double")
    got = {r.g: r for r in jobs.latency_profile(frame, ["g"], "v").collect()}
    ordered = sorted(values)
    assert got["a"].p95_ms == ordered[int(1501 * 0.95)] and got["a"].p99_ms == ordered[int(1501 * 0.99)]
    assert got["a"].median_ms == ordered[750] and got["b"].median_ms == 2.5 and got["b"].p99_ms is None


def test_attempts(spark):
    runs = ["fail fail", "fail fail fail", "complete", "cancel", "complete cancel", "fail fail fail cancel", "cancel fail", "fail cancel",
            "cancel complete", "fail fail fail complete", "cancel fail fail fail cancel", "complete fail cancel"]
    rows = [(j, i // 2, i, o) for j, run in enumerate(runs) for i, o in enumerate(run.split())]  # pairs of equal times
    random.Random(4).shuffle(rows)
    frame = spark.createDataFrame(rows, "job_id long, ts long, event_id long, outcome string")

    def replayed(run):
        status, retries = "pending", 0
        for outcome in run.split():
            if outcome == "complete":
                status = "completed"
            elif outcome == "fail":
                retries += 1
                status = "pending" if retries < 3 else "failed"
            elif status == "pending":
                status = "cancelled"
        return status, retries

    got = {r.job_id: (r.status, r.retries) for r in jobs.folded_status(frame).collect()}
    assert got == {j: replayed(run) for j, run in enumerate(runs)}


def test_tenant_without_limits(spark):
    docs = spark.sql("select t as tenant_id, timestamp'2024-01-02' as created_at, 5 as total_pages, 10L as file_size_bytes from values ('a'), ('b'), ('c') v(t)")
    limits = spark.createDataFrame([("a", 0, None, 5), ("b", None, 9, None)], "tenant_id string, monthly_document_limit int, monthly_page_limit int, storage_limit_mb int")
    assert {r.tenant_id: r.over_quota for r in jobs.tenant_usage(docs, limits).collect()} == {"a": True, "b": False, "c": False}


def test_cache_key_and_latest_entry(spark):
    params = {"max_tokens": 2048}
    row = spark.range(1).select(dedup.cache_key(F.lit("content"), params).alias("k")).first()
    assert row.k == "ocr:" + hashlib.sha256(b"content" + json.dumps(params, sort_keys=True).encode()).hexdigest()
    entries = spark.createDataFrame([("a", 1, 100, 0), ("a", 2, 5, 1), ("b", 1, 50, 2)], "key string, created_at long, expires_at long, hit_count long")
    assert [r.key for r in dedup.valid_entries(entries, F.lit(10)).collect()] == ["b"]


def test_assembly_is_whole(spark):
    pages = spark.range(1, 10_002).selectExpr("1L as doc_id", "cast(id as int) as page_number", "concat('t', id) as text", "0.5D as seconds")
    row, = files.assemble(pages).collect()
    assert row.n_pages == 10_001 and row.seconds == 5000.5
    assert row.text.startswith("\n--- Page 1 ---\nt1\n\n\n--- Page 2 ---\nt2") and row.text.endswith("\nt10001")


def test_cluster_needs_a_shared_folder(spark):
    class Cluster:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = {}, Cluster()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_recogniser_failures_become_rows(spark):
    pages = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "doc_id long, image string")

    def broken(images):
        raise ValueError("no memory")

    rows = files.recognise(pages, broken, "image", "doc_id long").collect()
    assert len(rows) == 4 and not any(r.success for r in rows) and rows[0].error_message.startswith("Error processing image")


def test_html_text(spark):
    html = "<!DOCTYPE html><style>p{}</style><p> a <b>b</b></p><!-- c --><script>if (x<1) {}</script>d &amp; e"
    assert spark.range(1).select(files.html_text(F.lit(html)).alias("t")).first().t == "a\nb\nd & e"


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'a "b"', 2.5)], "job_id long, name string, amount double")
    sinks.write(frame, "files", path=str(tmp_path / "c"), fmt="csv", mapping={"name": "label", "nope": "x"})
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "c")).collect()[0].asDict() == {"label": 'a "b"'}
    with pytest.raises(ValueError):
        sinks.write(frame, "fax")
    sinks.save_results(frame, str(tmp_path / "r"))
    assert sinks.read_result(spark, str(tmp_path / "r"), 1, "job_id long, name string, amount double").count() == 1
    assert sinks.map_fields(frame, {}).columns == frame.columns and sinks.map_fields(frame, {}, strict=True).columns == []
    assert [sinks.rendered_format(f) for f in ("xml", "csv", "other")] == ["xml", "csv", "json"]


def test_workflow_searches_each_text_once(spark):
    texts = ["Total Amount: 5\nNotes: none", "Notes: later", "", None]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, part string").select(
        "doc_id", F.concat("part", F.lit("\nmade here")).alias("text"))
    steps = [workflow.Step("extract", "field_extract", {"fields": ["Total Amount", "Notes"]}),
             workflow.Step("gate", "no_such_handler", condition="extract_output['Total Amount'] = ''")]
    dead = workflow.dead_letters(workflow.run(made, steps))
    plan = dead._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("ArrowEvalPython ["), plan.count("made here")) == (1, 1)
    assert "_values" not in dead.columns
    rows = {r.doc_id: r for r in dead.collect()}
    assert set(rows) == {1, 2, 3} and rows[1].gate_error == "Unknown handler: no_such_handler"
    assert rows[1].extract_output == {"Total Amount": "", "Notes": "later"}


def test_workflow_policies(spark):
    def explode(df, config):
        return df, F.lit("out"), F.when(F.col("n") > 1, F.lit("too big"))

    workflow.register_step("explode", explode)
    frame = spark.createDataFrame([(1,), (2,)], "n int")
    steps = [workflow.Step("a", "explode", on_failure="skip"), workflow.Step("b", "explode", condition="n > 1", on_failure="retry"),
             workflow.Step("c", "explode", condition="cast(null as boolean)")]
    rows = workflow.run(frame, steps).orderBy("n").collect()
    assert (rows[0].a_status, rows[0].b_status, rows[0].c_status, rows[0].workflow_status) == ("completed", "skipped", "completed", "completed")
    assert (rows[1].a_status, rows[1].b_status, rows[1].c_status, rows[1].workflow_status) == ("failed", "failed", "failed", "failed")
    odd = ["no_such_name > 1", "cast('x' as int) > 1", "n / 0 > 1", "((", "n = 1"]
    row = workflow.run(frame.where("n = 1"), [workflow.Step(f"s{i}", "explode", condition=c) for i, c in enumerate(odd)]).first()
    assert [row[f"s{i}_status"] for i in range(5)] == ["completed"] * 5 and row.workflow_status == "completed"
    last = workflow.run(frame.where("n = 2"), [workflow.Step("r", "explode", on_failure="retry")]).first()
    assert (last.r_status, last.workflow_status) == ("failed", "completed")


def test_xml_escapes(docs):
    from leafmill.operators import pages
    xml = render.render(pages.parse_documents(docs("a < b & c\n<watermark>X</watermark>")), "xml").first().output
    assert "a &lt; b &amp; c" in xml and 'number="1"' in xml and "<Equations>" not in xml


QUICK = ["type_by_language", "entities_all", "context_fields", "pages_split", "table_cells", "line_items", "label_statistics",
         "structured_fields", "schema_report", "workflow_invoice", "render_csv", "latency_profile", "tenant_usage", "duplicate_groups",
         "delivery_history", "web_page_text", "request_rates", "sliding_log_admission", "stream_deduplicated"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    for table in "customer documents events labels lineitem orders pages part supplier conversations".split():
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    want = con.sql(registry.oracle_sql()[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    got = [tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_every_query_has_sql():
    for group in (text_queries, markup_queries, service_queries):
        assert set(group.QUERIES) == set(group.ORACLES)


def test_stream_admission_over_batches(spark, tmp_path):
    batches = [[100, 101], [0, 1, 150], [250], [120, 251, 252]]
    for times in batches:
        spark.createDataFrame([(1, t) for t in times], "user_id long, t long").select(
            "user_id", F.timestamp_seconds(F.col("t") + 10_000).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    counts = admission.stream_sliding(stream, "user_id", 2, 100, "10 minutes")

    def keep(batch, number):
        batch.withColumn("n", F.lit(number)).write.mode("append").parquet(str(tmp_path / "out"))

    counts.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(keep).trigger(
        availableNow=True).start().awaitTermination()
    got = [(r.allowed, r.denied) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()]
    log, newest, want = [], 0, []  # by arrival: a late request is judged at the newest time
    for times in batches:
        allowed = 0
        for t in sorted(times):
            newest = max(newest, t)
            log = [x for x in log if x > newest - 100]
            if len(log) < 2:
                log.append(newest)
                allowed += 1
        want.append((allowed, len(times) - allowed))
    assert got == want
