"""Rate-limit admission: sliding log and token bucket.

A decision depends on earlier decisions of the same key, so it cannot be a plain window.
The batch forms cut a key's history where the state is known from the requests alone and
replay only what is left, in time order:

* sliding log - a request whose trailing load (all requests in the window, itself included) is
  within the limit is always admitted.  Only requests above it are open; a chain of open
  requests less than a window apart is replayed with the window before it.
* token bucket - if every request were admitted, the missing tokens would follow a queue; where
  that queue is empty the bucket is full whatever was decided before.  Each busy period of the
  queue is replayed on its own.

A replay streams a stretch through one task with constant state: sorted partitions, never a
group in memory.  A key overloaded without any break is one long stretch: it is cut into
segments of about ``SEGMENT`` requests that are replayed at once from speculated states and
repaired in rounds (``_entries``).  All running values over a key are taken per time bucket and
carried between buckets, so a busy key is spread there too.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import shared_folder
from leafmill.streaming.windows import HALO_FACTOR, trailing_load

LOGGER = logging.getLogger(__name__)
#: Requests of a segment of a stretch, and rounds of speculation before the rest is replayed in order.
SEGMENT = 50_000
ROUNDS = 6


def _bucketed(rows: DataFrame, bucket_us: int) -> DataFrame:
    return rows.withColumn("_b", F.floor(F.col("_us") / bucket_us))


def _running(rows: DataFrame, key: str, value: Column, how: str, name: str, before: bool = False) -> DataFrame:
    """Running sum, min or max of ``value`` along a key's time; ``before`` leaves the row itself out.

    Computed inside (key, bucket) and shifted by the buckets before; the carry table has one
    row per key and bucket.
    """
    aggregate = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    valued = rows.withColumn("_v", value)
    inside = Window.partitionBy(key, "_b").orderBy("_us", "_id").rowsBetween(
        Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = valued.groupBy(key, "_b").agg(aggregate("_v").alias("_part")).select(
        key, "_b", aggregate("_part").over(earlier).alias("_carry"))
    joined = valued.withColumn("_local", aggregate("_v").over(inside)).join(carry, [key, "_b"])
    zero = F.lit(0)
    both = {"sum": F.coalesce("_local", zero) + F.coalesce("_carry", zero),
            "min": F.least("_local", "_carry"), "max": F.greatest("_local", "_carry")}[how]
    return joined.withColumn(name, both).drop("_v", "_local", "_carry")


class SlidingLog:
    """One key's log: ``log(micros)`` is (allowed, retry_after, remaining)."""

    def __init__(self, limit: int, width_us: int, state: str | None = None):
        self.limit, self.width_us = limit, width_us
        self.log = deque(json.loads(state) if state else [])

    def __call__(self, us: int) -> tuple[bool, int, int]:
        log, begin = self.log, us - self.width_us
        while log and log[0] <= begin:
            log.popleft()
        if len(log) >= self.limit:
            return False, (log[0] - begin) // 1_000_000 + 1, 0
        log.append(us)
        return True, 0, self.limit - len(log)

    def fresh_at(self) -> int:
        """From when on it decides like a new one."""
        return self.log[-1] + self.width_us if self.log else 0

    def same(self, other: SlidingLog) -> bool:
        """Right after the same request: will both decide alike from now on."""
        return self.log == other.log

    def state(self) -> str:
        return json.dumps(list(self.log))


class TokenBucket:
    """One key's bucket: ``bucket(micros)`` is (allowed, tokens, retry_after)."""

    def __init__(self, rate_per_s: float, capacity: float, state: str | None = None):
        self.rate, self.capacity = rate_per_s, capacity
        self.tokens, self.last = json.loads(state) if state else (float(capacity), None)

    def __call__(self, us: int) -> tuple[bool, float, int]:
        tokens = self.tokens
        if self.last is not None:
            tokens = min(self.capacity, tokens + (us - self.last) / 1e6 * self.rate)
        allowed = tokens >= 1
        self.tokens, self.last = (tokens - 1 if allowed else tokens), us
        return allowed, self.tokens, 0 if allowed else int((1 - tokens) / self.rate) + 1

    def fresh_at(self) -> int:
        """From when on it decides like a new one."""
        return 0 if self.last is None else self.last + int((self.capacity - self.tokens) / self.rate * 1e6) + 1

    def same(self, other: TokenBucket) -> bool:
        return self.tokens == other.tokens

    def state(self) -> str:
        return json.dumps([self.tokens, self.last])


def sliding_log(limit: int, width_us: int):
    """Factory of logs: empty, or with the state of another one."""
    return partial(SlidingLog, limit, width_us)


def token_bucket(rate_per_s: float, capacity: float):
    """Factory of buckets: full, or with the state of another one."""
    return partial(TokenBucket, rate_per_s, capacity)


def _headed(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``rows`` and ``heads``, told apart by ``_body`` (0 for a head); columns that heads lack hold any value there."""
    spare = [F.lit(0).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in heads.columns]
    return rows.withColumn("_body", F.lit(1)).unionByName(heads.select("*", *spare, F.lit(0).alias("_body")))


def _exits(rows: DataFrame, key: str, segments: DataFrame, decide) -> DataFrame:
    """(key, _run, _seg, exit): the state after each segment of ``segments``, from its state ``_new``.

    A segment that was replayed from ``_entry`` to ``_exit`` before runs from both states side by side and is done
    as soon as they meet: the rest and the exit are as before."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    place = [key, "_run", "_seg"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, known, old, new = None, None, None, None
        for pdf in batches:
            done = []
            for at, us, entry, exit_, fresh in zip(zip(*(pdf[c].tolist() for c in place)), pdf["_us"].tolist(),
                                                   pdf["_entry"].tolist(), pdf["_exit"].tolist(), pdf["_new"].tolist()):
                if at != current:  # the row with the states comes first
                    if current is not None:
                        done.append((*current, known if new is None else new.state()))
                    current, known, new = at, exit_, decide(state=fresh)
                    old = decide(state=entry) if exit_ else None
                elif new is not None:
                    new(us)
                    if old is not None:
                        old(us)
                        if old.same(new):
                            new = None
            yield pd.DataFrame(done, columns=[*place, "exit"])
        if current is not None:
            yield pd.DataFrame([(*current, known if new is None else new.state())], columns=[*place, "exit"])

    text = F.lit(None).cast("string")
    body = rows.join(segments.select(*place), place, "left_semi").select(
        *place, "_us", "_id", text.alias("_entry"), text.alias("_exit"), text.alias("_new"))
    ordered = _headed(body, segments.select(*place, "_entry", "_exit", "_new")).repartition(*place).sortWithinPartitions(
        *place, "_body", "_us", "_id")
    return ordered.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in place) + ", exit string")


def _entries(rows: DataFrame, key: str, decide) -> DataFrame:
    """(key, _run, _seg, _entry): the state in which each segment of the cut stretches begins.

    Speculation: every segment is first replayed from the fresh state, all at once.  Then each takes the exit of the one
    before as its entry, and those whose entry changed are replayed again, again at once, until none changes.  After
    round r the first r + 1 segments of a stretch are right, and from wherever a replay meets the earlier one nothing
    changes, so the rounds are as many as the segments that the longest difference lasts.  What is open after ``ROUNDS``
    rounds (stretches whose states never meet) is replayed one segment after the other.
    """
    spark, place = rows.sparkSession, [key, "_run", "_seg"]
    segments = rows.select(*place).distinct()
    text = F.lit(None).cast("string")
    first = _exits(rows, key, segments.select(*place, *[text.alias(c) for c in ("_entry", "_exit", "_new")]), decide)
    segments = _kept(first.select(*place, text.alias("_entry"), F.col("exit").alias("_exit")), "segments")
    order = Window.partitionBy(key, "_run").orderBy("_seg")
    for spent in range(ROUNDS + 1):
        chained = segments.withColumn("_new", F.lag("_exit").over(order)).withColumn("_open", ~F.col("_new").eqNullSafe(F.col("_entry")))
        opened = chained.filter("_open")
        n_open = opened.count()
        LOGGER.info("replay round %d: %d segments open", spent, n_open)
        if not n_open:
            break
        if spent == ROUNDS:  # from the first open segment of a stretch on, one after the other
            begins = opened.groupBy(key, "_run").agg(F.min("_seg").alias("_begin"))
            rest = chained.join(begins, [key, "_run"]).filter("_seg >= _begin")
            exits = _exits_in_order(rows, key, rest, decide)
            follow = rest.join(exits, place).withColumn("_new", F.coalesce(F.lag("exit").over(order), "_new")).select(*place, F.col("_new").alias("_seq"))
            return chained.join(follow, place, "left").select(*place, F.coalesce("_seq", "_entry").alias("_entry"))
        exits = _exits(rows, key, opened, decide)
        segments = _kept(chained.join(exits, place, "left").select(
            *place, F.when(F.col("_open"), F.col("_new")).otherwise(F.col("_entry")).alias("_entry"),
            F.coalesce("exit", "_exit").alias("_exit")), "segments")
    return segments.select(*place, "_entry")


def _exits_in_order(rows: DataFrame, key: str, segments: DataFrame, decide) -> DataFrame:
    """(key, _run, _seg, exit) of the last segments of stretches, each stretch in one sorted pass."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    place = [key, "_run", "_seg"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for pdf in batches:
            done = []
            for at, us, fresh, begin in zip(zip(*(pdf[c].tolist() for c in place)), pdf["_us"].tolist(), pdf["_new"].tolist(), pdf["_begin"].tolist()):
                if at != current:
                    if current is not None:
                        done.append((*current, step.state()))
                    if at[2] == begin:
                        step = decide(state=fresh)
                    current = at
                step(us)
            yield pd.DataFrame(done, columns=[*place, "exit"])
        if current is not None:
            yield pd.DataFrame([(*current, step.state())], columns=[*place, "exit"])

    state = F.when(F.col("_seg") == F.col("_begin"), F.col("_new"))
    body = rows.join(segments.select(*place, "_begin", state.alias("_new")), place).select(*place, "_us", "_id", "_new", "_begin")
    ordered = body.repartition(key, "_run").sortWithinPartitions(*place, "_us", "_id")
    return ordered.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in place) + ", exit string")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _replay(rows: DataFrame, key: str, decide, extra: str) -> DataFrame:
    """Stream every stretch in time order through ``decide()``: a factory of machines ``micros -> tuple`` that start
    fresh or from a state.  Columns: key, _id, _us, _run and optionally _own.

    A stretch of more than ``SEGMENT`` requests is cut by time into segments of about that many, whose entry states
    are found first (``_entries``); then all segments are replayed at once.
    """
    own = ["_own"] if "_own" in rows.columns else []
    rows = _kept(rows.select(key, "_run", "_id", "_us", *own), "replay")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = [key, "_id", "_us", *own]
    schema = ", ".join(f"`{n}` {types[n]}" for n in kept) + ", " + extra
    out_names = [part.split()[0] for part in extra.split(",")]
    sizes = rows.groupBy(key, "_run").agg(F.count("*").alias("_n"), F.min("_us").alias("_low"), F.max("_us").alias("_high")).filter(
        F.col("_n") > SEGMENT)
    if sizes.isEmpty():
        marked = rows.withColumns({"_seg": F.lit(0).cast("long"), "_entry": F.lit(None).cast("string"), "_body": F.lit(1)})
    else:
        part = (F.col("_us") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * F.ceil(F.col("_n") / SEGMENT)
        cut = rows.join(sizes, [key, "_run"], "left").withColumn("_seg", F.coalesce(F.floor(part), F.lit(0)))
        entries = _entries(cut.filter("_n is not null"), key, decide)
        marked = _headed(cut.select(*kept, "_run", "_seg", F.lit(None).cast("string").alias("_entry")), entries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for pdf in batches:
            results, body = [], pdf["_body"] == 1
            for at, us, entry, is_body in zip(zip(pdf[key].tolist(), pdf["_run"].tolist(), pdf["_seg"].tolist()),
                                              pdf["_us"].tolist(), pdf["_entry"].tolist(), body.tolist()):
                if at != current:
                    current, step = at, decide(state=entry)
                if is_body:
                    results.append(step(us))
            out = pdf.loc[body, kept].copy()
            for name, values in zip(out_names, zip(*results)):
                out[name] = values
            if results:
                yield out

    ordered = marked.repartition(key, "_run", "_seg").sortWithinPartitions(
        key, "_run", "_seg", "_body", "_us", "_id")
    return ordered.mapInPandas(run, schema)


def _open_chains(open_rows: DataFrame, key: str, width_us: int) -> DataFrame:
    """``_run`` of every open request: time of the first one of its chain."""
    timed = _running(_bucketed(open_rows, width_us * HALO_FACTOR), key, F.col("_us"), "max", "_prev", before=True)
    starts = F.when(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= width_us), F.col("_us"))
    return _running(timed, key, starts, "max", "_run").select(key, "_id", "_run")


def admit_sliding(events: DataFrame, key: str, id_col: str, micros: Column, limit: int, width_us: int) -> DataFrame:
    """Batch decisions of the sliding log: id, key, allowed, retry_after, remaining."""
    rows = events.select(F.col(key), F.col(id_col).alias("_id"), micros.alias("_us"))
    loaded = trailing_load(rows, key, F.col("_us"), width_us, order="_id")
    chains = _open_chains(loaded.filter(F.col("load") > limit), key, width_us)
    size = width_us * HALO_FACTOR
    known = _bucketed(loaded.join(chains, [key, "_id"], "left"), size)
    mark = F.when(F.col("_run").isNotNull(), F.struct("_us", "_run"))
    # chain whose last open request is less than a window back: it decides this request
    placed = _running(known, key, mark, "max", "_past").withColumn(
        "_after", F.when(F.col("_us") - F.col("_past._us") < width_us, F.col("_past._run")))
    # chain that opens less than a window later: this request is part of its log.  Buckets are
    # extended backwards by one window to see it
    reach = F.floor((F.col("_us") - width_us) / size)
    spread = placed.withColumn("_own_b", F.col("_b")).withColumn(
        "_b", F.explode(F.array_distinct(F.array(F.col("_own_b"), reach))))
    ahead = Window.partitionBy(key, "_b").orderBy(F.desc("_us"), F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    sighted = spread.withColumn("_next", F.last(mark, ignorenulls=True).over(ahead)).filter(
        F.col("_b") == F.col("_own_b")).withColumn(
        "_before", F.when(F.col("_next._us") - F.col("_us") < width_us, F.col("_next._run")))
    copies = F.filter(F.array(
        F.struct(F.col("_after").alias("r"), F.lit(True).alias("own")),
        F.struct(F.nullif(F.col("_before"), F.coalesce("_after", F.lit(-1))).alias("r"), F.lit(False).alias("own"))),
        lambda c: c["r"].isNotNull())
    inputs = sighted.select(key, "_id", "_us", F.explode(copies).alias("c")).select(
        key, "_id", "_us", F.col("c.r").alias("_run"), F.col("c.own").alias("_own"))
    replayed = _replay(inputs, key, sliding_log(limit, width_us),
                       "allowed boolean, retry_after long, remaining long").filter("_own").drop("_us", "_own")
    quiet = placed.filter(F.col("_after").isNull()).select(
        key, "_id", F.lit(True).alias("allowed"), F.lit(0).cast("bigint").alias("retry_after"),
        (F.lit(limit) - F.col("load")).cast("bigint").alias("remaining"))
    return replayed.unionByName(quiet).withColumnRenamed("_id", id_col)


def admit_bucket(events: DataFrame, key: str, id_col: str, micros: Column, per_minute: int) -> DataFrame:
    """Batch decisions of the token bucket (capacity = requests per minute): id, key, allowed, tokens, retry_after."""
    token_us = -(-60_000_000 // per_minute)  # rounded up: a queue that empties is empty for certain
    rows = _bucketed(events.select(F.col(key), F.col(id_col).alias("_id"), micros.alias("_us")), 3_600_000_000)
    counted = _running(rows, key, F.lit(1), "sum", "_n")
    level = (F.col("_n") - 1) * token_us - F.col("_us")
    queued = _running(counted.withColumn("_level", level), key, F.col("_level"), "min", "_low", before=True)
    starts = F.when(F.col("_low").isNull() | (F.col("_level") <= F.col("_low")), F.col("_us"))
    runs = _running(queued, key, starts, "max", "_run")
    out = _replay(runs, key, token_bucket(per_minute / 60, per_minute), "allowed boolean, tokens double, retry_after long")
    return out.drop("_us").withColumnRenamed("_id", id_col)


def stream_sliding(events: DataFrame, key: str, limit: int, width_s: int, watermark: str = "10 minutes") -> DataFrame:
    """Structured Streaming form of the sliding log (columns: key, ts): admitted and denied counts per key and batch."""
    return _stream(events, key, sliding_log(limit, width_s * 1_000_000), watermark)


def stream_bucket(events: DataFrame, key: str, per_minute: int, watermark: str = "10 minutes") -> DataFrame:
    """Structured Streaming form of the token bucket (columns: key, ts): admitted and denied counts per key and batch."""
    return _stream(events, key, token_bucket(per_minute / 60, per_minute), watermark)


def _stream(events: DataFrame, key: str, decide, watermark: str) -> DataFrame:
    """Requests are judged in the order of arrival: within a micro-batch by time, and one that is older than the
    newest time seen of its key is judged as if it came at that time, as it does; one behind the watermark is dropped.
    The state of a key is that of its log or bucket, and that newest time.  A call holds the times of one key in one micro-batch, 8 bytes each, whose
    number the source's rate limit sets.  A key's state goes by an event-time timeout when it is as good as fresh: its
    log is empty, or its bucket full.
    """
    key_type = events.schema[key].dataType.simpleString()

    def run(group, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        kept, newest = state.get if state.exists else (None, 0)
        machine, times = decide(state=kept), [pdf["us"].to_numpy() for pdf in batches]
        allowed = total = 0
        for us in np.maximum(np.sort(np.concatenate(times)), newest).tolist():
            newest = us
            total += 1
            allowed += machine(us)[0]
        state.update((machine.state(), newest))
        state.setTimeoutTimestamp(max(machine.fresh_at() // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]], "allowed": [allowed], "denied": [total - allowed]})

    timed = events.withWatermark("ts", watermark).select(key, "ts", F.unix_micros("ts").alias("us"))
    return timed.groupBy(key).applyInPandasWithState(
        run, f"`{key}` {key_type}, allowed long, denied long", "state string, newest long", "update", "EventTimeTimeout")
