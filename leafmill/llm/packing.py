"""Best-fit packing with certified bin counts.

Documents become token pieces; only a document longer than the capacity is cut.  Pieces are dealt to partitions,
each partition packs by best-fit decreasing, and dual feasible functions bound from below how many bins any packing
of its pieces needs.  A partition that meets its bound is certified and keeps its well-filled bins.  Partitions with a
gap keep only their full bins.  The pieces of all other bins form a common pool, which is dealt anew to fewer
partitions and packed again, until the pool fits one partition, is empty or hardly shrinks any more.

Defined cases: a null text counts as empty; an empty text is one piece with the end id; every row is packed, also
rows with the same doc_id or text; other columns are ignored; an empty table gives no pieces.  A partition holds
at most about ``PIECES_PER_PART`` pieces (lengths and row numbers only, never texts).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.chunk_encoder import encoder
from leafmill.llm.common import checkpointed, sliced

#: An exchange that saves fewer bins than one in so many brings nothing more.
LEAST_SAVED = 1000
PIECES_PER_PART = 50_000
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", part long, bin int, offset long, fill long, gap int"
ROUND_IDS, PART_IDS = 1 << 50, 1 << 20


def pieces(docs: DataFrame, tokenizer: str, pattern: str | None, end_id: int, capacity: int) -> DataFrame:
    """One row per piece: where it starts in its document's ids, its length, and the crc32 of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, uid = encoder(tokenizer, pattern, False), TaskContext.get().partitionId() << 36
        for batch in sliced(batches):
            ids, bounds = own.encode(batch.column("text"))
            rows = []
            for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own_ids = np.append(ids[bounds[row]:bounds[row + 1]], end_id).astype("<u4")
                for k, start in enumerate(range(0, len(own_ids), capacity)):
                    part = own_ids[start:start + capacity]
                    rows.append((uid, doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
                    uid += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=[c.split()[0] for c in PIECES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def lower_bound(counts: np.ndarray) -> int:
    """Bins that pieces need at least; ``counts[x]`` pieces have length x, the capacity is the last index.

    The largest of: all tokens over the capacity; for each threshold t up to half the capacity, the function that
    counts pieces over capacity - t as whole bins, drops those under t and keeps the others; for each k the
    function that rounds (k + 1) x / capacity down to whole k-ths and keeps x where that is exact."""
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    number, tokens = np.cumsum(counts), np.cumsum(counts * sizes)
    for t in range(1, capacity // 2 + 1):
        big = int(number[-1] - number[capacity - t])
        best = max(best, big + -(-int(tokens[capacity - t] - tokens[t - 1]) // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        whole = int((counts * np.where(exact, 0, scaled // capacity)).sum())
        kept = int((counts * np.where(exact, sizes, 0)).sum())
        best = max(best, -(-(whole * capacity + kept * k) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, and what each bin holds.  A bit for each free size that
    some bin has finds the tightest bin at once."""
    bins, offsets, fill = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_sizes = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fits = open_sizes >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_sizes ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if room > size:
            free[room - size].append(b)
            open_sizes |= 1 << (room - size)
    return bins, offsets, np.array(fill, np.int64)


def pack_parts(rows: DataFrame, capacity: int) -> DataFrame:
    """Pack each ``part`` and state its gap: bins used less the certified lower bound."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("uid", kind="stable")
        lengths = part["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        gap = len(fill) - lower_bound(np.bincount(lengths, minlength=capacity + 1))
        return part.assign(bin=bins, offset=offsets, fill=fill[bins], gap=np.int32(gap))

    return rows.groupBy("part").applyInPandas(one, PLACED)


def pack(rows: DataFrame, capacity: int, pieces_per_part: int = PIECES_PER_PART) -> DataFrame:
    """``pieces`` rows with ``sequence_id`` and ``offset``.

    After each round the open bins of parts with a gap, and underfilled bins of all, exchange their pieces and are
    packed anew.  When an exchange saves fewer than one bin in ``LEAST_SAVED``, only underfilled bins go on; when
    that saves none either, or one part holds what is left, the rounds end."""
    rows = checkpointed(rows)
    shown = [c.split()[0] for c in PIECES.split(", ")]
    done = [rows.where(F.col("length") == capacity).select(
        *shown, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool, before, tails, turn = rows.where(F.col("length") < capacity), None, False, 0
    while number := pool.count():
        parts = max(1, -(-number // pieces_per_part))
        placed = checkpointed(pack_parts(pool.select(*shown, F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)).alias(
            "part")), capacity))
        sequence = F.lit((turn + 1) * ROUND_IDS) + F.col("part") * PART_IDS + F.col("bin")
        settled = placed.withColumn("sequence_id", sequence)
        saved = None if before is None else before - _bins(placed)
        if parts == 1 or tails and saved * LEAST_SAVED < before:
            done.append(settled.select(*shown, "sequence_id", "offset"))
            break
        tails = tails or saved is not None and saved * LEAST_SAVED < before
        underfilled = F.col("fill") * 10 < capacity * 9
        again = underfilled if tails else F.when(F.col("gap") > 0, F.col("fill") < capacity).otherwise(underfilled)
        done.append(settled.where(~again).select(*shown, "sequence_id", "offset"))
        pool, turn = placed.where(again), turn + 1
        before = _bins(pool)
    return _union(done)


def _bins(placed: DataFrame) -> int:
    return placed.select("part", "bin").distinct().count()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("uid")
