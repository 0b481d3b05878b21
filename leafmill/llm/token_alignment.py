"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids is linked in a corpus.

A and B tokens of a text stand for bytes of a blank and the text.  Byte offsets where both a token of A and one of B
end cut them into groups, and the two tokens that end there are linked.

First pass: each task aligns its documents and sums the linked pairs.  The distinct pairs get a minimal perfect hash
that keeps its keys; each task's sums become a dense vector indexed by it, and the vectors are added in a tree of
``FAN`` vectors a node.  Second pass: the documents are aligned again and each link looks its pair's count up; the key
at its slot is verified.  One of two linked tokens is a suffix of the other, so the pairs number at most the summed
byte lengths of both vocabularies (twice for B's byte pieces): some hundred thousand, whatever the corpus.  That bound
is checked; hash and vector are all that the driver collects and the tasks are sent.

A blank after a non-blank character always begins a token of both tokenizers (of B, as no piece holds a word mark
after another character; checked when it is loaded).  So a slice's texts are cut there and only its distinct chunks
are tokenised, many in one call.

Defined cases: texts that are null or empty, or whose joined A or B bytes differ from a blank and the text (one with a
word mark of B's own, U+2581) have no tokens and count nothing; repeated rows count each; strings of special tokens
are plain text; a null doc_id is carried along; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import new_folder, sliced
from leafmill.llm.perfect_hash import PerfectHash

MARK = "▁"
SLICE_BYTES = 8 << 20
#: Characters that go to the tokenizers in one call.
CALL = 1 << 18
#: Vectors that are added in one step, and entries of a vector that travel as one row.
FAN, BLOCK = 16, 1 << 13
PAIRS = "pair long, n long"
VECTORS = "node long, block int, counts binary"
ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
CHUNKS = re.compile(r".*?\S(?= )|.+", re.DOTALL).findall


def byte_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Tokenizers:
    """A: byte-level ranks and their pre-token pattern.  B: pieces with a word mark, in front of the text as well."""

    def __init__(self, ranks_path: str, pattern: str, pieces_path: str):
        ranks = byte_ranks(ranks_path)
        self.a = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a word mark after another character")
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        digits = max(len(str(len(self.a_bytes))), len(str(size)))
        numbers = np.array([str(i) for i in range(max(len(self.a_bytes), size))], f"S{digits + 1}")
        self.digits = numbers.view(np.uint8).reshape(len(numbers), -1)

    def most_pairs(self) -> int:
        """Bound of the distinct linked pairs: each id with each suffix of its bytes that is a token of the other."""
        return int(2 * self.a_sizes.sum() + self.b_sizes.sum())

    def align(self, chunks: list[str]) -> Alignment:
        """All chunks, each of which begins with a blank that its string lacks."""
        parts, begin = [], 0
        alone = [not c or c[-1].isspace() or MARK in c for c in chunks]
        while begin < len(chunks):
            end, size = begin + 1, len(chunks[begin])
            while not alone[begin] and end < len(chunks) and not alone[end] and size < CALL:
                size += len(chunks[end])
                end += 1
            parts += self._call(chunks[begin:end])
            begin = end
        return Alignment(parts, self.digits)

    def _call(self, chunks: list[str]) -> list[tuple]:
        """(A ids, B ids, their ends, the chunks' ends) of chunks that are tokenised together; byte places from 0."""
        text = " ".join(chunks)
        whole = b" " + text.encode()
        a = self.a.encode_to_numpy(" " + text).astype(np.int64)
        b = np.array(self.b.encode(text) if text else [self.b.piece_to_id(MARK)], np.int64)
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        same = (b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == whole)
        if same and np.isin(ends, a_ends).all() and np.isin(ends, b_ends).all():
            return [(a, b, a_ends, b_ends, ends, False)]
        if len(chunks) == 1:
            return [(a[:0], b[:0], a_ends[:0], b_ends[:0], ends, True)]
        return [part for half in (chunks[:len(chunks) // 2], chunks[len(chunks) // 2:]) for part in self._call(half)]


class Alignment:
    """Tokens, groups and links of chunks, chunk by chunk.  ``bad`` marks chunks whose tokens don't make their bytes."""

    def __init__(self, parts: list[tuple], digits: np.ndarray):
        shifts = np.concatenate([[0], np.cumsum([p[4][-1] for p in parts])]).astype(np.int64)
        self.digits = digits
        self.a, self.b = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
        a_ends, b_ends, ends = (np.concatenate([p[k] + s for p, s in zip(parts, shifts, strict=False)] or [np.zeros(0, np.int64)]) for k in (2, 3, 4))
        self.bad = np.concatenate([np.full(len(p[4]), p[5]) for p in parts] or [np.zeros(0, bool)])
        common, self.a_at, self.b_at = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        # where each chunk's tokens and links begin (one entry more than chunks)
        self.a_bounds, self.b_bounds, self.bounds = (np.concatenate([[0], np.searchsorted(e, ends, "right")]) for e in (a_ends, b_ends, common))
        self.pairs = self.a[self.a_at] << 32 | self.b[self.b_at]

    def groups(self) -> list[str]:
        """Each chunk's groups as ``a1,a2|b1;a3|b2``."""
        n_a, n_b = len(self.a), len(self.b)
        group_a, group_b = (np.searchsorted(at, np.arange(n), "left") for at, n in ((self.a_at, n_a), (self.b_at, n_b)))
        # a token stands after those of its own side, and after the other side's of earlier groups (for B: of its group too)
        at_a = np.arange(n_a) + np.concatenate([[0], self.b_at + 1])[group_a]
        at_b = np.arange(n_b) + (self.a_at + 1)[group_b]
        cells = np.zeros((n_a + n_b, self.digits.shape[1] + 1), np.uint8)
        cells[at_a, :-1], cells[at_b, :-1] = self.digits[self.a], self.digits[self.b]
        cells[:, -1] = ord(",")
        cells[at_a[self.a_at], -1], cells[at_b[self.b_at], -1] = ord("|"), ord(";")
        ends = np.concatenate([[0], np.cumsum((cells != 0).sum(1))])
        text = cells[cells != 0].tobytes().decode("ascii")
        cuts = ends[self.a_bounds + self.b_bounds].tolist()
        return [text[s:max(s, e - 1)] for s, e in zip(cuts, cuts[1:], strict=False)]


class Slice:
    """The distinct chunks of a batch of texts, and each text's chunks by number."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        self.chunks = coded.dictionary.to_pylist()
        index, bounds = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        unsafe = np.array([not c or c[-1].isspace() for c in self.chunks], bool)
        odd = np.flatnonzero(np.bincount(np.repeat(np.arange(len(texts)), np.diff(bounds)), unsafe[index], len(texts)) if len(index) else [])
        own: dict[str, int] = {}
        parts, begin = [], 0
        for i in odd.tolist():  # texts with several blanks or other white space before one
            text = texts[i].as_py()
            cut = [c[1:] for c in CHUNKS(" " + text)] if text else []
            parts += [index[bounds[begin]:bounds[i]], np.array([len(self.chunks) + own.setdefault(c, len(own)) for c in cut], np.int64)]
            begin = i + 1
        parts.append(index[bounds[begin]:])
        sizes = np.diff(bounds)
        sizes[odd] = [len(p) for p in parts[1:-1:2]]
        self.index, self.bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        used = np.zeros(len(self.chunks) + len(own), bool)
        used[self.index] = True
        number = np.cumsum(used) - 1
        self.index = number[self.index]
        self.chunks = [c for c, u in zip(chain(self.chunks, own), used.tolist(), strict=True) if u]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of a number of each chunk over each text."""
        sums = np.concatenate([[0], np.cumsum(values[self.index])])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


_TOKENIZERS: dict[tuple[str, str, str], Tokenizers] = {}


def tokenizers(*key: str) -> Tokenizers:
    """The worker's tokenizers; they keep nothing between calls."""
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizers(*key)
    return _TOKENIZERS[key]


def _aligned(texts: pa.Array, own: Tokenizers) -> tuple[Slice, Alignment, np.ndarray]:
    """The slice, its alignment, and which texts have tokens."""
    cut = Slice(texts)
    aligned = own.align(cut.chunks)
    return cut, aligned, (np.diff(cut.bounds) > 0) & (cut.sums(aligned.bad.astype(np.int64)) == 0)


def _summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(pairs, return_inverse=True)
    return distinct, np.bincount(place, counts, len(distinct)).astype(np.int64)


def linked_pairs(docs: DataFrame, *files: str) -> DataFrame:
    """(pair, n): linked pairs, A's id in the upper half, summed within each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs, counts = tokenizers(*files), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in sliced(batches, most=SLICE_BYTES):
            cut, aligned, told = _aligned(batch.column("text"), own)
            times = np.bincount(cut.index[np.repeat(told, np.diff(cut.bounds))], minlength=len(cut.chunks))
            more = np.repeat(times, np.diff(aligned.bounds))
            pairs, counts = _summed(np.concatenate([pairs, aligned.pairs[more > 0]]), np.concatenate([counts, more[more > 0]]))
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(counts, pa.int64())], names=["pair", "n"])

    return docs.select("text").mapInArrow(rows, PAIRS)


def tree_sum(pairs: DataFrame, hashed: PerfectHash) -> np.ndarray:
    """Counts of all pairs by slot: a dense vector a task, added ``FAN`` at a time."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashed), np.int64)
        for batch in batches:
            slots = hashed.slots(batch.column("pair").to_numpy())
            if (slots < 0).any():
                raise ValueError("a pair is missing in the hash")
            np.add.at(total, slots, batch.column("n").to_numpy())
        parts = [total[k:k + BLOCK].tobytes() for k in range(0, len(total), BLOCK)] if total.any() else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()),
             pa.array(parts, pa.binary())], names=["node", "block", "counts"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, "<i8") for c in table["counts"].to_pylist())
        return pa.table({"node": table["node"][:1].cast(pa.int64()), "block": table["block"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    nodes = pairs.rdd.getNumPartitions()
    vectors = pairs.mapInArrow(dense, VECTORS)
    while nodes > 1:
        nodes = -(-nodes // FAN)
        vectors = vectors.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("block", "node").applyInArrow(added, VECTORS)
    blocks = sorted((r.block, r.counts) for r in vectors.collect())  # as long as the hash has keys
    return np.frombuffer(b"".join(c for _, c in blocks), "<i8")


def align(docs: DataFrame, *files: str) -> DataFrame:
    """One row per document: tokens of either side, groups, links, links whose count is the highest of their B id, the
    sum of counts over links, and the groups as text.  ``files``: A's ranks, its pre-token pattern, B's pieces."""
    spark = docs.sparkSession
    folder = new_folder(spark, "pairs")
    linked_pairs(docs, *files).write.parquet(folder)
    local = spark.read.parquet(folder)
    most = tokenizers(*files).most_pairs()
    keys = np.array([r.pair for r in local.select("pair").distinct().limit(most + 1).collect()], np.int64)
    if len(keys) > most:
        raise ValueError("more linked pairs than the vocabularies allow")
    hashed = PerfectHash(keys)
    counts = tree_sum(local, hashed)
    if len(counts) < len(hashed):
        raise ValueError("the summed vector is not whole")
    b_ids = (hashed.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    best = np.zeros(int(b_ids.max(initial=0)) + 1, np.int64)
    np.maximum.at(best, b_ids, counts)
    is_best = counts == best[b_ids]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(*files)
        for batch in sliced(batches, most=SLICE_BYTES):
            cut, aligned, told = _aligned(batch.column("text"), own)
            slots = hashed.slots(aligned.pairs)
            # a chunk that only stands in texts without tokens may hold pairs that no text counts
            known = slots >= 0
            n_a, n_b, n_links = (np.diff(x) for x in (aligned.a_bounds, aligned.b_bounds, aligned.bounds))
            per_link = [np.concatenate([[0], np.cumsum(np.where(known, x[slots] if len(x) else 0, 0))]) for x in (is_best, counts)]
            sums = [cut.sums(x) * told for x in (n_a, n_b, n_links, n_links, *(x[aligned.bounds[1:]] - x[aligned.bounds[:-1]] for x in per_link))]
            missing = cut.sums(np.bincount(np.repeat(np.arange(len(n_links)), n_links), ~known, len(n_links)).astype(np.int64)) * told
            if missing.any():
                raise ValueError("a linked pair was not counted")
            groups, bounds = aligned.groups(), cut.bounds.tolist()
            texts = [";".join([groups[k] for k in cut.index[s:e].tolist()]) if t else ""
                     for s, e, t in zip(bounds, bounds[1:], told.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(s.astype(np.int64)) for s in sums), pa.array(texts, pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, ALIGNED)
