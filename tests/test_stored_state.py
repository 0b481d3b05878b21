"""State that outlives a run: key tables, partitions, sketches, streams; and the table function."""

import bisect
import os
import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contract.grid_queries import scratch_database
from contract import grid_queries
from leafmill.operators import audit, reuse, sketches, table_function, table_tokenizer
from leafmill.sources import partitions
from leafmill.streaming import admission, windows


def test_new_keys_resolve_false_positives_without_moving_the_table(spark):
    table = f"{scratch_database(spark)}.known"
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    reuse.write_keys(keys.where("id < 2000").unionByName(spark.sql("select cast(null as string) as key"), True).select("key"), table, 4)
    docs = spark.range(6000).select("id", F.when(F.col("id") % 100 != 99, F.concat(F.lit("k"), "id")).alias("key"))
    others = spark.range(10_000).select(F.concat(F.lit("other"), "id").alias("key"))
    reuse.write_keys(others, table, 4, "append")
    crowded = reuse.key_filter(spark.table(table), 1)  # 12,000 keys in one block: many false positives
    suspects = reuse.with_suspicion(docs, crowded, 1).where("maybe_known and id >= 2000").count()
    assert suspects > 500
    got = reuse.new_keys(docs, table, crowded, 1)
    assert {r.id for r in got.collect()} == {i for i in range(6000) if i >= 2000 or i % 100 == 99}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reuse.new_keys(docs, table, crowded, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = plan[:plan.index("known")].splitlines()[-8:]
    assert "Bucketed: true" in plan and not any("Exchange" in line for line in scan[scan.index(next(x for x in scan[::-1] if "Sort" in x)):])
    # keys are added, filters of the same size merged
    reuse.write_keys(keys.where("id >= 2000"), table, 4, "append")
    merged = reuse.merged_filters(crowded, reuse.key_filter(keys.where("id >= 2000"), 1))
    assert {r.id for r in reuse.new_keys(docs, table, merged, 1).collect()} == {i for i in range(6000) if i >= 4000 or i % 100 == 99}
    assert reuse.filter_blocks(0) == 1 and reuse.filter_blocks(10**6) == 367
    assert reuse.new_keys(docs, table, merged.limit(0), 1).count() == 6000


def _files(spark, table):
    return {f.removeprefix("file:"): os.stat(f.removeprefix("file:").replace("%25", "%")).st_mtime_ns
            for f in (x.replace("file://", "file:") for x in spark.table(table).inputFiles())}


def test_clean_up_leaves_later_partitions_untouched(spark):
    table = f"{scratch_database(spark)}.kept"
    rows = [(i, f"t'{i % 2}", datetime(2024, 1, 1 + i // 24, i % 24, tzinfo=UTC)) for i in range(24 * 5)] + [(1000, "late", datetime(2024, 1, 3, 2, tzinfo=UTC))]
    frame = spark.createDataFrame([*rows, (2000, "t'0", None)], "id long, tenant string, ts timestamp")
    partitions.write_by_day(frame.coalesce(1), table, F.col("ts"), ("tenant",))
    before = _files(spark, table)
    assert partitions.clean_up(spark, table, "ts", "2024-01-03 10:30:00") == {"dropped": 2 * 2 + 1, "rewritten": 2}
    spark.catalog.refreshTable(table)
    want = {i for i, _, ts in rows if ts >= datetime(2024, 1, 3, 10, 30, tzinfo=UTC)} | {2000}
    assert {r.id for r in spark.table(table).select("id").collect()} == want
    after = _files(spark, table)
    later = {f for f in before if "day=2024-01-04" in f or "day=2024-01-05" in f or "HIVE" in f}
    assert len(later) == 5 and all(after[f] == before[f] for f in later)
    assert not any(os.path.exists(f) for f in before if "day=2024-01-01" in f or "day=2024-01-03" in f)
    assert partitions.clean_up(spark, table, "ts", "2024-01-03 10:30:00") == {"dropped": 0, "rewritten": 2}
    assert partitions.clean_up(spark, table, "ts", "2024-01-04 00:00:00") == {"dropped": 2, "rewritten": 0}
    assert spark.table(table).count() == 49


def test_quantile_sketches_stay_within_their_rank_error(spark):
    rng = random.Random(2)
    values = [(k % 3, k % 7, round(rng.lognormvariate(3, 2), 3)) for k in range(40_000)] + [(9, 0, 5.0), (9, 1, None)]
    frame = spark.createDataFrame(values, "k int, day int, v double").repartition(5)
    stored = sketches.quantile_sketches(frame, ["k", "day"], "v")
    ranks = {"p10": 0.1, "median": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r.k: r for r in sketches.quantiles(sketches.merged_quantiles(stored, ["k"]), ["k"], ranks).collect()}
    for k in range(3):
        own = sorted(v for key, _, v in values if key == k)
        assert got[k].n == len(own) and (got[k].low, got[k].high) == (own[0], own[-1])
        for name, p in ranks.items():
            value = got[k][name]
            assert bisect.bisect_left(own, value) / len(own) - 2 * sketches.RANK_ERROR <= p <= bisect.bisect_right(own, value) / len(own) + 2 * sketches.RANK_ERROR
    assert (got[9].n, got[9].median) == (1, 5.0)


def test_frequent_items_are_bounded(spark):
    rng = random.Random(3)
    items = [(k % 4, int(rng.paretovariate(0.7))) for k in range(30_000)]
    exact = Counter(v for _, v in items)
    stored = sketches.frequent_sketches(spark.createDataFrame([*items, (0, None)], "day int, item long").repartition(6), ["day"], "item", 400)
    rows = sketches.frequent_items(sketches.merged_frequent(stored.withColumn("all", F.lit(1)), ["all"], 400), ["all"], 10, 400).collect()
    assert len(rows) == 10 and all(0 <= r["count"] - exact[r.item] <= r.bound for r in rows)
    assert {r.item for r in rows[:5]} == {v for v, _ in exact.most_common(5)} and rows[0].bound < 300


def test_audit_details_of_all_shapes(spark):
    logs = spark.createDataFrame([(1, '{"resource":{"type":"doc","id":7},"outcome":"ok"}'), (2, '{"resource_type":"job","target":"x","result":{"status":"failed"}}'),
                                  (3, "no json"), (4, None), (5, "[1,2]"), (6, '{"resource":"doc","status":null}')], "id long, details string")
    rows = [tuple(r) for r in audit.audit_records(logs, ["id"]).drop("details").orderBy("id").collect()]
    assert rows == [(1, "doc", "7", "ok"), (2, "job", "x", "failed"), (3, None, None, None), (4, None, None, None), (5, None, None, None), (6, None, None, None)]


def test_distinct_users_by_sketches(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("day"), F.pmod(F.xxhash64("id"), F.lit(9_000)).alias("user"))
    got = audit.merged_summary(audit.audit_summary(rows, ["a", "day"], "user"), ["a"]).join(rows.groupBy("a").agg(F.count_distinct("user").alias("x")), "a").collect()
    assert len(got) == 3 and all(abs(r.n_users - r.x) <= 4 * audit.DISTINCT_ERROR * r.x and r.n_events == 20_000 for r in got)


def test_table_function(spark, docs):
    table_function.register(spark)
    texts = [None, "", "none", "<table><tr><th>a &amp; b</th><td> <b>x</b> </td></tr><tr></tr></table>",
             "<table><tr><td>o<table><tr><td>i</td></tr></table></td></tr>"]
    docs(*texts).createOrReplaceTempView("udtf_texts")
    rows = spark.sql("select d.doc_id, t.* from udtf_texts d, lateral extract_tables(d.text) t").collect()
    assert sorted(tuple(r) for r in rows) == [(3, 1, 0, 0, True, "a & b"), (3, 1, 0, 1, False, "x"), (4, 1, 0, 0, False, "oi"), (4, 2, 0, 0, False, "i")]


# --- streams -------------------------------------------------------------------------------

BEGIN = datetime(2024, 1, 1, tzinfo=UTC)


def arriving(spark, path, batches, columns="k long, minute double"):
    """A stream whose micro-batches are the given rows; the minute becomes ``ts``."""
    for rows in batches:
        spark.createDataFrame([(*r[:1], BEGIN + timedelta(minutes=r[1]), *r[2:]) for r in rows], columns.replace("minute double", "ts timestamp")).coalesce(
            1).write.mode("append").parquet(str(path))
    return spark.readStream.option("maxFilesPerTrigger", 1).schema(columns.replace("minute double", "ts timestamp")).parquet(str(path))


def outcome(frame, path, mode="append"):
    """Rows that the stream wrote, with the number of their batch."""
    seen = []
    frame.writeStream.outputMode(mode).option("checkpointLocation", str(path)).foreachBatch(
        lambda batch, n: seen.extend((n, *r) for r in batch.collect())).trigger(availableNow=True).start().awaitTermination()
    return seen


def minute(ts):
    return round((ts.replace(tzinfo=UTC) - BEGIN).total_seconds() / 60, 6)


def test_late_rows_bridge_sessions(spark, tmp_path):
    batches = [[(1, 0), (1, 8), (2, 3)], [(1, 30)], [(1, 4.5), (2, 50)], [(3, 900)]]
    found = windows.stream_sessions(arriving(spark, tmp_path / "in", batches), "k", "5 minutes", "2 hours")
    rows = sorted((k, minute(s), minute(e), n) for _, k, s, e, n in outcome(found, tmp_path / "state"))
    # 0 and 8 are apart until 4.5 arrives late
    assert rows == [(1, 0, 13, 3), (1, 30, 35, 1), (2, 3, 8, 1), (2, 50, 55, 1)]


def test_sessions_are_merged_before_the_shuffle(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), BEGIN + timedelta(seconds=rng.randint(0, 400_000))) for _ in range(5000)] + [(4, None)]
    frame = spark.createDataFrame(rows, "k long, ts timestamp").repartition(3)
    local = windows._local_sessions(frame.select("k", F.unix_micros("ts").alias("us")), "k", 120_000_000)
    assert local.count() < 0.85 * len(rows) and local.agg(F.sum("n")).first()[0] == 5000
    want = []
    for key in (1, 2, None):
        times = sorted(t for k, t in rows if k == key)
        begin = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or (times[i] - times[i - 1]).total_seconds() >= 120:
                want.append((key, minute(times[begin]), minute(times[i - 1] + timedelta(minutes=2)), i - begin))
                begin = i
    got = [(r.k, minute(r.start), minute(r.end), r.n) for r in windows.sessions(frame, "k", 120).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_alerts_of_a_stream(spark, tmp_path):
    def rows(window, n, failed):
        return [(i < failed, 5 * window + i / n) for i in range(n)]

    batches = [rows(0, 10, 5) + rows(1, 10, 1), rows(2, 10, 5) + rows(4, 10, 5), rows(5, 10, 5) + rows(1, 4, 4),  # window 1 breaches by late rows
               rows(7, 5, 5), rows(6, 3, 0) + rows(8, 3, 3) + [(False, 900)], [(True, 41)]]  # the last one is too late
    stream = arriving(spark, tmp_path / "in", batches, "failed boolean, minute double")
    alerts = windows.stream_sustained(stream, F.col("failed"), 0.3, "5 minutes", 2, "1 hour")
    told = sorted(minute(s) / 5 for _, s, _ in outcome(alerts, tmp_path / "state"))
    assert told == [1, 2, 5, 8]  # 0-1, 1-2, 4-5 and 7-8; 3 and 6 part the rest


@pytest.mark.parametrize("form", ["log", "bucket"])
def test_admission_streams_keep_their_state(spark, tmp_path, form):
    rng = random.Random(8)
    batches = [sorted((k, 30 * b + rng.randint(0, 1700) / 60) for k in (1, 2) for _ in range(60 if b != 2 else 3)) for b in range(4)]
    batches[3].append((1, 31.0))  # judged at its arrival
    stream = arriving(spark, tmp_path / "in", batches)
    if form == "log":
        counts, machine = admission.stream_sliding(stream, "k", 3, 240, "2 hours"), admission.sliding_log(3, 240_000_000)
    else:
        counts, machine = admission.stream_bucket(stream, "k", 1, "2 hours"), admission.token_bucket(1 / 60, 1)
    got = sorted((n, *r) for n, *r in outcome(counts, tmp_path / "state", "update"))
    want = []
    for key in (1, 2):
        step, newest = machine(), 0
        for n, batch in enumerate(batches):
            allowed = 0
            times = sorted(int(round(m * 60e6)) for k, m in batch if k == key)
            for t in times:
                newest = max(newest, t)
                allowed += step(newest)[0]
            want.append((n, key, allowed, len(times) - allowed))
    assert got == sorted(want)


def test_plain_tables_need_no_tokenizer(monkeypatch):
    plain = "☑ x\n<img>a</img><table><tr><th>H</th></tr>\n<tr><td> 1 </td><td></td></tr></table> & <table></table></b>"
    odd = ["<table><tr><td>a<table><tr><td>in</td></tr></table></td></tr></table>", "<table><tr><td>open", "<TABLE><tr><td>1</td></tr></table>",
           "<script><table></table></script>", "<table><tr><td>&amp;</td></tr></table>", "<!-- <table></table> -->", "a < b <table></table>"]
    for text in [plain, *odd]:
        own = [t["own"] for t in table_tokenizer.tables_in(text)]
        rows = lambda found: [[table_function._CELL.findall(r) for r in table_function._ROW.findall(t)] for t in found]
        assert rows(table_function._own_tables(text)) == rows(own)
    asked = []
    monkeypatch.setattr(table_function, "tables_in", lambda text: asked.append(text) or [])
    for text in [plain, *odd]:
        table_function._own_tables(text)
    assert asked == odd


def test_tables_of_forms_run_in_several_tasks(spark, tmp_path):
    rows = [(i, f"c{i}", "s") for i in range(4000)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = grid_queries.QUERIES["table_function_nested"](spark, str(tmp_path))
    assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 8 * len(rows)
