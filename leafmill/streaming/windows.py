"""Window metrics and alerts.  Every function takes a batch or a streaming DataFrame unless it says batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALO_FACTOR = 60  # a bucket of ``trailing_load`` is this many windows long


def client_key(api_key: Column, forwarded: Column, host: Column) -> Column:
    """``key:`` + API key, else ``ip:`` + first forwarded address, else ``ip:`` + host; '' counts as missing."""
    blank = F.lit("")
    first = F.btrim(F.get(F.split(F.nullif(forwarded, blank), ","), F.lit(0)))
    return F.coalesce(F.concat(F.lit("key:"), F.nullif(api_key, blank)), F.concat(F.lit("ip:"), first),
                      F.concat(F.lit("ip:"), host))


def request_rates(events: DataFrame, failed: Column, width: str = "5 minutes", watermark: str = "10 minutes",
                  slide: str | None = None) -> DataFrame:
    """Requests per second and error share per window."""
    src = events.withWatermark("ts", watermark) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return src.groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed")).select(
        "w", "n", "n_failed", (F.col("n") / seconds).alias("rate"), (F.col("n_failed") / F.col("n")).alias("error_ratio"))


def sustained(windows: DataFrame, breach: Column, start: str, width_s: int, spans: int) -> DataFrame:
    """Batch: starts of windows that end a run of ``spans`` directly adjacent breaching windows.

    Each breaching window votes for the ``spans`` windows it can be part of; a window with all
    votes has held.  That is one aggregation keyed by window start: no ordered pass over the
    whole series.
    """
    votes = windows.filter(breach).select(F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("k"),
                                          F.col(start).alias("_s"))
    ends = votes.select((F.col("_s") + F.make_dt_interval(secs=F.col("k") * F.lit(float(width_s)))).alias(start))
    return ends.groupBy(start).agg(F.count("*").alias("n")).filter(F.col("n") == spans).select(start)


def gauge_alert(series: DataFrame, value: str, limit: float, above: bool, width: str, width_s: int, spans: int) -> DataFrame:
    """Batch: starts of windows in which a gauge (columns ts and ``value``) has been beyond its limit for ``spans``
    adjacent windows: all readings of a window over it, or with ``above`` false under it.  A window without a
    reading ends a run."""
    read = series.groupBy(F.window("ts", width).alias("w")).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    breach = F.col("low") > limit if above else F.col("high") < limit
    return sustained(read.select("w.start", "low", "high"), breach, "start", width_s, spans)


def queue_length(jobs: DataFrame, width_s: int) -> DataFrame:
    """Batch: jobs that wait at the end of each window (start, waiting): created and not yet started.

    Jobs are counted per window first; the running sum sees one row per window of the covered time."""
    steps = jobs.select(F.col("created_at").alias("ts"), F.lit(1).alias("d")).unionByName(
        jobs.where("started_at is not null").select(F.col("started_at").alias("ts"), F.lit(-1).alias("d")))
    slot = F.floor(F.unix_timestamp("ts") / width_s)
    moved = steps.groupBy(slot.alias("slot")).agg(F.sum("d").alias("moved"))
    every = moved.agg(F.min("slot").alias("low"), F.max("slot").alias("high")).select(
        F.explode(F.sequence("low", "high")).alias("slot"))
    running = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(moved, "slot", "left").select(
        F.timestamp_seconds(F.col("slot") * width_s).alias("start"), F.sum(F.coalesce("moved", F.lit(0))).over(running).alias("waiting"))


def trailing_load(events: DataFrame, key: str, micros: Column, width_us: int, order: str | None = None) -> DataFrame:
    """Batch: requests of the same key in ``(t - width, t]`` for every request, as ``load``.

    Time is cut into buckets of many windows; a request is copied to the next bucket when it
    lies within one window of its end.  The range window then runs per (key, bucket), so a busy
    key is spread over its buckets.  Copies are dropped afterwards.  With ``order`` (an id),
    requests at the same instant are counted one after the other instead of together.
    """
    size = width_us * HALO_FACTOR
    bucket = F.floor(F.col("_t") / size)
    reach = F.floor((F.col("_t") + width_us) / size)
    spread = events.withColumn("_t", micros).withColumn(
        "_b", F.explode(F.array_distinct(F.array(bucket, reach)))).withColumn("_own", F.col("_b") == bucket)
    in_range = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(-(width_us - 1), 0)
    load = F.count("*").over(in_range)
    if order:
        tied = Window.partitionBy(key, "_b", "_t")
        load = load - F.count("*").over(tied) + F.row_number().over(tied.orderBy(order))
    return spread.withColumn("load", load).filter("_own").drop("_b", "_own", "_t")


def deduplicated(events: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    """Stream: drop repeats of a key that arrive within the watermark delay."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def stream_sustained(events: DataFrame, failed: Column, limit: float, width: str, spans: int, watermark: str) -> DataFrame:
    """Stream, append mode: ``start`` of windows that end a run of ``spans`` adjacent windows with an error share over
    ``limit``: ``sustained`` over ``request_rates``, told once the watermark has passed the window.

    Two stateful steps in a chain: windows of requests, then windows over the times of breaching windows, as long as
    the run and sliding by one window; one that holds ``spans`` breaches is all breaches.  Late rows count as long as
    the watermark allows; a window without requests ends a run.
    """
    rates = request_rates(events, failed, width, watermark)
    breaches = rates.filter(F.col("error_ratio") > limit).select(F.window_time("w").alias("at"))
    whole = F.expr(f"interval '{width}' * {spans}")
    length = events.sparkSession.range(1).select(F.unix_seconds(F.timestamp_seconds(F.lit(0)) + whole).alias("s")).first().s
    runs = breaches.groupBy(F.window("at", f"{length} seconds", width).alias("r")).agg(F.count("*").alias("n")).filter(F.col("n") == spans)
    return runs.select((F.col("r.end") - F.expr(f"interval '{width}'")).alias("start"), "n")


def sessions(events: DataFrame, key: str, gap_s: int) -> DataFrame:
    """Batch: activity sessions per key (start, end, n); requests at least ``gap_s`` apart part them, a session ends
    ``gap_s`` after its last request.

    Each batch of a task's rows is merged into sessions first (``_local_sessions``); only those are shuffled, and
    sessions of a key that touch are merged by a running maximum of ends.
    """
    local = _local_sessions(events.select(key, F.unix_micros("ts").alias("us")), key, gap_s * 1_000_000)
    order = Window.partitionBy(key).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("first") - before >= gap_s * 1_000_000, F.lit(True)).cast("int")
    numbered = local.withColumn("fresh", fresh).withColumn("no", F.sum("fresh").over(order))
    return numbered.groupBy(key, "no").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).select(
        key, F.timestamp_micros("first").alias("start"), F.timestamp_micros(F.col("last") + gap_s * 1_000_000).alias("end"), "n")


def _local_sessions(rows: DataFrame, key: str, gap_us: int) -> DataFrame:
    """(key, first, last, n): sessions of the rows of one batch of one task, in microseconds."""
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, first long, last long, n long"

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("us"))).sort_by([(key, "ascending"), ("us", "ascending")])
            if not batch.num_rows:
                continue
            us = batch.column("us").to_numpy()
            code = pc.fill_null(batch.column(key).dictionary_encode().indices, -1).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(us) >= gap_us)]))
            end = np.append(begin[1:], len(us))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(begin)), pa.array(us[begin]), pa.array(us[end - 1]),
                                              pa.array(end - begin)], names=[key, "first", "last", "n"])

    return rows.mapInArrow(merged, schema)


def stream_sessions(events: DataFrame, key: str, gap: str, watermark: str) -> DataFrame:
    """Stream: activity sessions per key (start, end, n).  The state holds a key's open sessions; a late row that
    bridges two of them makes one.  Rows are merged into sessions before the shuffle (set in ``session.prepare``)."""
    return events.withWatermark("ts", watermark).groupBy(key, F.session_window("ts", gap).alias("s")).agg(
        F.count("*").alias("n")).select(key, "s.start", "s.end", "n")
