"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items, each text scanned once.

Words are runs of ASCII letters and digits and of any other non-ASCII characters, A-Z lower-cased.  A window is
``WINDOW`` consecutive words of an item; an item with fewer, but at least one, is one window.  Windows and texts are
written as words between single blanks, so that a match always covers whole words, and every match, overlapping ones
too, marks its words as hit.

The benchmark is collected only up to ``max_bytes`` of text; a larger one is scanned in several passes over groups of
items, each within the bound, whose results merge row by row without a shuffle.

Defined cases: a null text has no words; a text without words has no hits; an item with a null id or text has no window; items with
the same window are all found; repeated rows are judged each; clashing extra columns are replaced; empty tables give no
rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import renamed, sliced

WINDOW = 10
MAX_BYTES = 32 << 20
#: A word in a text as it stands, with capitals.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes to lower case, all that is no part of a word to blanks.
PLAIN = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
ADDED = {"n_words": "bigint", "hit_words": "array<struct<first:bigint,last:bigint>>", "items": "array<bigint>"}
_AUTOMATA: dict = {}


def words(text: str) -> list[bytes]:
    return text.encode().translate(PLAIN).split()


def windows(text: str | None) -> set[str]:
    """An item's windows as the automaton stores them; bytes are kept as Latin-1 characters."""
    own = words(text or "")
    n = min(WINDOW, len(own))
    return {(b" " + b" ".join(own[i:i + n]) + b" ").decode("latin-1") for i in range(len(own) - n + 1)} if own else set()


def automaton(items: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """Each window with its length in words and the items that hold it."""
    owners: dict[str, list[int]] = {}
    for item_id, text in items:
        for window in windows(text):
            owners.setdefault(window, []).append(item_id)
    found = ahocorasick.Automaton()
    for window, ids in owners.items():
        found.add_word(window, (window.count(" ") - 1, len(window), ids))
    if owners:
        found.make_automaton()
    return found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges (both ends included) without overlaps, in order."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(r) for r in out]


def _scan(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """One pass.  ``docs`` may hold the added columns of a pass before; the result holds both."""
    spark, names = docs.sparkSession, [c for c in docs.columns if c not in ADDED]
    shared, key, again = spark.sparkContext.broadcast(items), uuid.uuid4().hex, "hit_words" in docs.columns
    schema = T.StructType([docs.schema[c] for c in names]
                          + [T.StructField(c, T.DataType.fromDDL(k)) for c, k in ADDED.items()])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _AUTOMATA:  # built once by each worker
            _AUTOMATA.clear()
            _AUTOMATA[key] = automaton(shared.value)
        found = _AUTOMATA[key]
        for batch in sliced(batches):
            counts, hits, owners = [], [], []
            old = batch.column("hit_words").to_pylist() if again else None
            old_items = batch.column("items").to_pylist() if again else None
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = words(text or "")
                ranges, ids = [], set()
                if own and len(found):
                    line = b" " + b" ".join(own) + b" "
                    matches = list(found.iter(line.decode("latin-1")))
                    if matches:
                        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                        for end, (n, length, item_ids) in matches:
                            first = int(np.searchsorted(blanks, end - length + 1))
                            ranges.append((first, first + n - 1))
                            ids.update(item_ids)
                if again:
                    ranges += [(r["first"], r["last"]) for r in old[row]]
                    ids.update(old_items[row])
                counts.append(len(own))
                hits.append([{"first": a, "last": b} for a, b in merged(ranges)])
                owners.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(hits, RANGES),
                 pa.array(owners, pa.list_(pa.int64()))], names=[*names, *ADDED])

    return docs.mapInArrow(rows, schema)


def scan(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_words (ranges of word numbers from 0, both ends included) and items (ids found)."""
    docs = docs.drop(*ADDED)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size * 2 // max_bytes)) if size > max_bytes else 1
    for k in range(passes):
        own = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        docs = _scan(docs, [tuple(r) for r in own.collect()])  # at most max_bytes, checked above
    return docs


def n_hit() -> Column:
    """Words inside any found window."""
    return F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def spans(scanned: DataFrame) -> DataFrame:
    """One row per hit range: doc_id and its place in the original text (characters from 0, end not included)."""
    hit = scanned.where(F.size("hit_words") > 0).select("doc_id", "text", "hit_words")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hit_words")),
                                            strict=True):
                places = [m.span() for m in WORD.finditer(text)]
                out += [(doc_id, places[r["first"]][0], places[r["last"]][1]) for r in ranges]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                             names=["doc_id", "start", "end"])

    return hit.mapInArrow(rows, "doc_id long, start long, end long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with their own columns."""
    rows, back = renamed(docs, set(ADDED))
    return scan(rows, benchmark).where(F.size("hit_words") == 0).drop(*ADDED).withColumnsRenamed(back)
