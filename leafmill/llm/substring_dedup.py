"""Removal of passages that repeat: every window of words whose sequence also starts earlier in the corpus goes.

Every window of ``WINDOW`` consecutive words has a Rabin-Karp hash, rolled over the words' own 64-bit hashes.  Within a
slice of texts the windows that repeat an earlier one are marked at once, so at most one window of each sequence leaves
a slice, however often a passage occurs.  The others go, packed as columns, to the bucket that a second rolling hash
names; Spark shuffles the buckets, each of which sorts its hashes and marks all places of a hash but the first.  The
marks are gathered by parts of the documents, packed again, and joined to their documents by doc_id, where overlapping
windows merge into maximal removal intervals.

The earlier place is the one with the smaller doc_id, then the smaller start.  Windows are judged on the input, not on
what is left.  Buckets hold the windows of about ``BUCKET_BYTES`` of text whatever the size of the corpus, so memory is
bounded; windows are compared by 64 bits and their bucket: with n windows about n * 4e6 / 2^65 false matches are to be
expected, 2e-5 in 150 million.

Words are the runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, unchanged.
Defined cases: a null or empty text has no words; a text of fewer words than a window keeps them all; repeated rows
(same doc_id) stand at the same place, so they don't remove one another, and a place that is removed in one of them is
removed in all; a null doc_id has no place: its text stays whole and removes nothing; other columns are ignored; an
empty table gives no rows.  A text is worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import sliced
from leafmill.llm.shingles import mix, word_numbers

WINDOW = 20
BUCKET_BYTES = 24 << 20
PIECE_BYTES = 1 << 20
SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
#: Odd bases of the two rolling hashes.
BASES = (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15)
PACKED = "bucket int, docs binary, counts binary, starts binary, hashes binary"
KEPT = "doc_id long, n_words long, removed array<struct<start: long, end: long>>, kept string"


def _pieces(line: bytes) -> Iterator[bytes]:
    """A text cut at blanks into pieces of about ``PIECE_BYTES``."""
    while len(line) > PIECE_BYTES:
        cut = line.find(b" ", PIECE_BYTES)
        if cut < 0:
            break
        yield line[:cut]
        line = line[cut + 1:]
    yield line


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of all texts, and where each text's words begin (one entry more than texts)."""
    pieces = [(i, p) for i, text in enumerate(texts) for p in _pieces((text or b"").translate(SPACES))]
    parts, sizes, begin = [], np.zeros(len(texts), np.int64), 0
    while begin < len(pieces):  # together as long as they are short: the hashing needs some 40 bytes a byte
        end, size = begin, 0
        while end < len(pieces) and (end == begin or size + len(pieces[end][1]) <= PIECE_BYTES):
            size += len(pieces[end][1])
            end += 1
        words, bounds = word_numbers([p for _, p in pieces[begin:end]])
        np.add.at(sizes, [i for i, _ in pieces[begin:end]], np.diff(bounds))
        parts.append(words)
        begin = end
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])


def rolled(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of all windows, from differences of prefix sums."""
    steps = np.ones((2, len(words) + 1), np.uint64)
    steps[0, 1:], steps[1, 1:] = base, pow(base, -1, 1 << 64)
    up, down = np.cumprod(steps, axis=1, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)])
    return mix((sums[window:] - sums[:-window]) * down[:len(words) + 1 - window])


def repeats(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the windows whose hash has an earlier place."""
    order = np.argsort(hashes, kind="stable")
    same = np.diff(hashes[order]) == 0
    several = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    several = several[np.lexsort((starts[several], docs[several], hashes[several]))]
    if not len(several):
        return several
    fresh = np.concatenate([[True], np.diff(hashes[several]) != 0])
    first = several[np.maximum.accumulate(np.where(fresh, np.arange(len(several)), 0))]
    return several[(docs[several] != docs[first]) | (starts[several] != starts[first])]


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers in the fewest bytes that hold the largest of them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // max(n, 1) or 1}").astype(np.int64)


def _row(bucket: int, docs: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None) -> tuple:
    """Windows in order of documents (as they come) and starts, as one packed row."""
    fresh = np.flatnonzero(np.concatenate([[True], np.diff(docs) != 0]))
    steps = np.diff(starts, prepend=0)
    steps[fresh] = starts[fresh]
    return (bucket, docs[fresh].tobytes(), pack(np.diff(np.append(fresh, len(docs)))), pack(steps),
            b"" if hashes is None else hashes.tobytes())


def _unpacked(docs: bytes, counts: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(docs, "<i8")
    many = unpack(counts, len(ids))
    total = int(many.sum())
    sums = np.cumsum(unpack(starts, total))
    fresh = np.cumsum(many) - many
    steps = unpack(starts, total)
    return np.repeat(ids, many), sums - np.repeat(sums[fresh] - steps[fresh], many)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                                      names=["bucket", "docs", "counts", "starts", "hashes"])


def _windows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed windows by bucket, and those that repeat an earlier one of their slice, without hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column("doc_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            batch = batch.take(pa.array(order))
            words, bounds = word_hashes(batch.column("text").cast(pa.large_binary()).to_pylist())
            if len(words) < window:
                continue
            doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
            inside = np.flatnonzero(doc[:len(words) + 1 - window] == doc[window - 1:])
            if not len(inside):
                continue
            hashes = rolled(words, window, BASES[0])[inside]
            bucket = (rolled(words, window, BASES[1])[inside] >> np.uint64(32)) % np.uint64(buckets)
            of, starts = ids[order][doc[inside]], inside - bounds[doc[inside]]
            later = np.sort(repeats(hashes, of, starts))
            out = [_row(int(bucket[later[0]]), of[later], starts[later], None)] if len(later) else []
            left = np.ones(len(hashes), bool)
            left[later] = False
            left = np.flatnonzero(left)
            left = left[np.argsort(bucket[left].astype(np.uint32), kind="stable")]
            for part in np.split(left, np.flatnonzero(np.diff(bucket[left])) + 1):
                out.append(_row(int(bucket[part[0]]), of[part], starts[part], hashes[part]))
            yield _batch(out)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, PACKED)


def _later(windows: DataFrame, parts: int) -> DataFrame:
    """Packed windows that repeat an earlier one, by part: one row for each bucket and part of the documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def dealt(docs: np.ndarray, starts: np.ndarray) -> list[tuple]:
            part = (mix(docs.astype(np.uint64)) >> np.uint64(32)) % np.uint64(parts)
            order = np.lexsort((starts, docs, part))
            groups = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []
            return [_row(int(part[g[0]]), docs[g], starts[g], None) for g in groups]

        for batch in batches:
            for row in batch.to_pylist():
                docs, starts = _unpacked(row["docs"], row["counts"], row["starts"])
                if row["hashes"]:
                    held.append((np.frombuffer(row["hashes"], "<u8"), docs, starts.astype(np.uint32)))
                else:
                    yield _batch(dealt(docs, starts))
        if held:
            hashes, docs, starts = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            later = repeats(hashes, docs, starts)
            if len(later):
                yield _batch(dealt(docs[later], starts[later].astype(np.int64)))

    return windows.mapInArrow(rows, PACKED)


def _by_document(later: DataFrame) -> DataFrame:
    """(doc_id, starts): one row per document and task, a part's documents in one task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpacked(row["docs"], row["counts"], row["starts"]) for batch in batches for row in batch.to_pylist()]
        if not held:
            return
        docs, starts = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((starts, docs))
        docs, starts = docs[order], starts[order]
        fresh = np.flatnonzero(np.concatenate([[True], np.diff(docs) != 0]))
        parts = [s.astype("<u4").tobytes() for s in np.split(starts, fresh[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(docs[fresh], pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "starts"])

    return later.mapInArrow(rows, "doc_id long, starts binary")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: number of words, the maximal removed intervals (word numbers from 0, end exclusive) and
    the kept words, joined by single blanks."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // BUCKET_BYTES)
    later = _later(_windows(docs, window, buckets).repartitionById(buckets, "bucket"), buckets)
    marks = _by_document(later.repartitionById(buckets, "bucket"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marks, "doc_id", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, texts, intervals = [], [], []
            for text, marked in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = (text or b"").split()
                sizes.append(len(words))
                starts = np.frombuffer(marked or b"", "<u4").astype(np.int64)
                starts = starts[starts + window <= len(words)]
                edges = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + window, minlength=len(words) + 1)
                gone = np.concatenate([[0], (np.cumsum(edges) > 0).astype(np.int8)])
                begins, ends = np.flatnonzero(np.diff(gone) > 0), np.flatnonzero(np.diff(gone) < 0)
                intervals.append([{"start": int(b), "end": int(e)} for b, e in zip(begins, ends, strict=True)])
                texts.append(b" ".join(words if not len(starts) else [words[k] for k in np.flatnonzero(gone[1:-1] == 0)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(intervals, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(texts, pa.binary()).view(pa.string())], names=["doc_id", "n_words", "removed", "kept"])

    return joined.mapInArrow(rows, KEPT)


def n_removed(removed: str = "removed"):
    """Column: number of removed words."""
    return F.aggregate(removed, F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"])
