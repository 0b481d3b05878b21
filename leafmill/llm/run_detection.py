"""Periodic runs of words: stretches that repeat a block of words over and over, and the texts without the repeats.

A run has a smallest period q, at least ``max(SHORTEST, REPEATS * q)`` words, and no neighbouring word continues it.

Recursive frequency splitting: a word of a run with period q stands there at least once in any q words, so at least
``REPEATS`` times in the run.  A word that occurs less often within its current segment can't be in a run: it splits
the segment.  The parts are split again by their own counts until none changes; parts too short for a run are dropped.
The surviving segments are scanned lag by lag.  A run with period q has 3q neighbouring matches at lag q, so it shows
at three neighbouring multiples of q; only these places are looked at, about n log n in a segment of n words, and a
place where all match is widened to the whole run by the ranks of its blocks of 1, 2, 4, ... words.

Words are the runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.  Defined
cases: a null or empty text has no words, no runs and an empty collapsed text; repeated rows are treated each; a null
doc_id is carried along; other columns are ignored; an empty table gives no rows.  A text is worked on whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import sliced

REPEATS = 4
SHORTEST = 6
#: Places that are looked at together; bounds the memory of a scan.
PLACES = 1 << 20
#: Runs of at least this part of a segment are not found again at the multiples of their period.
FEW = 8
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def surviving(codes: np.ndarray, segments: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the segments in which every word occurs often enough.  ``segments`` numbers the first ones."""
    at = np.arange(len(codes))
    segment = segments.astype(np.int64)
    top = int(codes.max(initial=0)) + 1
    while len(at):
        _, place, times = np.unique(segment * top + codes[at], return_inverse=True, return_counts=True)
        keep = times[place] >= REPEATS
        shrunk = np.bincount(segment, ~keep) > 0
        stable = ~shrunk[segment]
        yield from _stretches(at[stable], segment[stable])
        keep &= ~stable
        at, segment = at[keep], segment[keep]
        if not len(at):
            return
        segment = np.cumsum(np.concatenate([[0], (np.diff(at) > 1) | (np.diff(segment) > 0)]))
        wide = np.bincount(segment)[segment] >= SHORTEST
        at, segment = at[wide], segment[wide]
        segment = np.cumsum(np.concatenate([[0], np.diff(segment) > 0])) if len(at) else segment


def _stretches(at: np.ndarray, segment: np.ndarray) -> Iterator[tuple[int, int]]:
    if not len(at):
        return
    first = np.flatnonzero(np.concatenate([[True], np.diff(segment) > 0]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    long = at[last] - at[first] + 1 >= SHORTEST
    yield from zip(at[first[long]].tolist(), (at[last[long]] + 1).tolist(), strict=True)


class Blocks:
    """Ranks of all blocks of 1, 2, 4, ... words, equal for equal blocks, to tell how far two places agree."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
        while 2 << len(self.ranks) - 1 <= self.n:
            size, rank = 1 << len(self.ranks) - 1, self.ranks[-1].astype(np.int64)
            pairs = rank[:len(rank) - size] * self.n + rank[size:]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from places i < j on."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, size = self.ranks[k], 1 << k
            fits = j + same + size <= self.n
            same[fits] += size * (rank[(i + same)[fits]] == rank[(j + same)[fits]])
        return same

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before places i < j."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, size = self.ranks[k], 1 << k
            fits = i - same - size >= 0
            same[fits] += size * (rank[(i - same - size)[fits]] == rank[(j - same - size)[fits]])
        return same


def scan(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a segment, by start, then period."""
    n, blocks, found = len(codes), None, []
    lags = np.arange(1, n // REPEATS + 1)
    places = np.maximum((n - 1) // lags - 2, 0)
    group = np.cumsum(places) // PLACES
    for g in range(int(group[-1]) + 1 if len(lags) else 0):
        own, many = lags[group == g], places[group == g]
        q = np.repeat(own, many)
        i = q * (np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many))
        for step in range(3):
            match = codes[i + step * q] == codes[i + (step + 1) * q]
            i, q = i[match], q[match]
        for start, length, period in (run for runs in found for run in runs.tolist() if run[1] * FEW >= n):
            new = (i < start) | (i + q >= start + length) | (q % period > 0)  # else at a multiple of a known period
            i, q = i[new], q[new]
        if not len(i):
            continue
        blocks = blocks or Blocks(codes)
        before = blocks.backward(i, i + q)
        start, length = i - before, before + blocks.forward(i, i + q) + q
        full = length >= np.maximum(SHORTEST, REPEATS * q)
        found.append(np.unique(np.stack([start[full], length[full], q[full]], 1), axis=0))
    if not found:
        return []
    found = np.unique(np.concatenate(found), axis=0)  # a run shows at multiples of its period too: the least counts
    least = np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(1)]) if len(found) else []
    return sorted(map(tuple, found[least].tolist()), key=lambda run: (run[0], run[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside the repeats of any run, joined by blanks."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per document: number of words, its runs by start and period (word numbers from 0), and its words
    without those after a run's first period, joined by single blanks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lists = [t.split() if t else [] for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            sizes = np.array(list(map(len, lists)), np.int64)
            numbers = defaultdict(count().__next__)
            codes = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
            begins = np.concatenate([[0], np.cumsum(sizes)])
            runs: list[list[tuple[int, int, int]]] = [[] for _ in lists]
            for start, end in surviving(codes, np.repeat(np.arange(len(lists)), sizes)):
                doc = int(np.searchsorted(begins, start, "right")) - 1
                offset = start - int(begins[doc])
                runs[doc] += [(offset + s, n, q) for s, n, q in scan(codes[start:end])]
            for own in runs:
                own.sort(key=lambda run: (run[0], run[2]))
            texts = [_collapsed(w, r) if r else b" ".join(w) for w, r in zip(lists, runs, strict=True)]
            flat = list(chain.from_iterable(runs))
            columns = zip(*flat, strict=True) if flat else ([], [], [])
            structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(list(map(len, runs)))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(offsets, structs),
                 pa.array(texts, pa.binary()).view(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, RUNS)


def strongest(runs: str = "runs"):
    """Column: the run with the greatest exact length / period; ties: smallest start, then period.  Null without runs."""
    def better(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a.isNull() | (right > left), b).otherwise(a)  # runs stand by start and period, so the first wins
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
