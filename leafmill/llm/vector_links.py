"""Near copies among vectors: a small-world graph per shard, every shard asked for every vector.

Equal vectors are one node.  Nodes are dealt to shards at random; each shard is one graph.  A block of queries meets a
shard in one task, which searches the graph, widens what the beam found along the graph as far as links go (a group of
near copies may be larger than any beam), and audits itself against all vectors of the shard.  A query's own node is no
link there.  Queries are drawn at random until ``TESTED`` links are known, at most a ``WIDEST``-th of them: where links
are rare, the missing ones are planted, each a query turned from a random node of the shard by just the angle of
``cosine``, which is the hardest link there is.  As long as less than ``AUDIT`` of the drawn or of the planted links
are found the beam is doubled; in the end all queries are compared with the whole shard, so the loop ends with a passed
audit.  Found pairs are verified in double precision and joined to components.

Defined cases: null or empty vectors, vectors of zeros, and those with null or non-finite components link with
nothing and are kept; vectors of different lengths never link; repeated rows are vectors of their own that link
with one another; other columns are ignored; an empty table gives no rows.

Every vector asks every shard, so with a fixed shard size the work grows with the square of the rows over that size;
``shard_rows`` therefore lets shards grow until memory (one shard and one slice of queries in a task) bounds them; wide
vectors make more shards.  Shards travel in pieces of ``PIECE`` bytes ahead of the queries of their block, which a task
reads as a stream, so no row and no batch is large and no block is held whole.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import hnsw
from leafmill.llm.common import checkpointed
from leafmill.llm.components import components

COSINE = 0.95
SHARDS, SHARD_ROWS, SHARD_BYTES, BLOCK_ROWS = 6, 100_000, 32 << 20, 8_192
#: Up to SPREAD blocks of BLOCK_ROWS queries, then blocks grow to SPREAD times that: each block moves every shard once.
SPREAD, PIECE = 8, 1 << 20
BEAM, AUDIT, AUDITED, TESTED = 32, 0.995, 64, 200
STEP = 128
SLACK = 1e-4
#: A beam of more than one WIDEST-th of the shard gives way to comparing all of it, which costs no more.
WIDEST = 16


def nodes(embeddings: DataFrame, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The different usable vectors: node (a number), embedding, rep (smallest vec_id), copies, dim, shard, block."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0))
    rows = checkpointed(usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn(
        "node", F.monotonically_increasing_id()))
    number, values = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(x)), F.lit(0))).first()
    parts = max(shards, -(-number // shard_rows), -(-4 * values // SHARD_BYTES))
    blocks = max(2, min(SPREAD, -(-number // block_rows)), -(-number // (SPREAD * block_rows)))
    return rows.select("node", "embedding", "rep", "copies", F.size(x).alias("dim"),
                       F.pmod(F.xxhash64("node"), F.lit(parts)).alias("shard"),
                       F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).alias("block"),
                       F.lit(parts).alias("parts"), F.lit(blocks).alias("blocks"))


def packed(graph: hnsw.Graph, exact: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """A shard in pieces: its vectors as given, the numbers of its nodes and its links.  Unit vectors are made anew."""
    out = io.BytesIO()
    kept = exact if exact.dtype == np.float32 else exact.astype("<f8")
    np.savez(out, exact=kept, numbers=numbers, **{f"layer{i}": x for i, x in enumerate(graph.layers)})
    whole = out.getbuffer()
    return [bytes(whole[k:k + PIECE]) for k in range(0, len(whole), PIECE)]


def unpacked(pieces: list[bytes]) -> tuple[hnsw.Graph, np.ndarray, np.ndarray]:
    """Graph, unit vectors in double precision and node numbers of a shard."""
    parts = np.load(io.BytesIO(b"".join(pieces)))
    exact = hnsw.unit(parts["exact"])
    layers = [parts[f"layer{i}"] for i in range(len(parts.files) - 2)]
    return hnsw.Graph(exact.astype(np.float32), layers), exact, parts["numbers"]


def graphs(points: DataFrame) -> DataFrame:
    """The pieces of each shard: its graph, its nodes' numbers and vectors."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable")
        rows = rows.iloc[np.random.default_rng(11).permutation(len(rows))]
        x = np.stack(rows["embedding"].to_numpy())
        pieces = packed(hnsw.build(hnsw.unit(x).astype(np.float32)), x, rows["node"].to_numpy("<i8"))
        return pd.DataFrame({**{c: rows[c].iat[0] for c in ("dim", "shard", "blocks")}, "no": range(len(pieces)), "piece": pieces})

    return checkpointed(points.select("node", "embedding", "dim", "shard", "blocks").groupBy("dim", "shard").applyInPandas(
        one, "dim int, shard long, blocks long, no int, piece binary"))


def planted(x: np.ndarray, number: int, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors that are turned from random rows of ``x`` by the angle of ``cosine``, in any direction."""
    rows = x[rng.choice(len(x), min(number, len(x)), replace=False)].astype(np.float64)
    aside = rng.normal(size=rows.shape)
    aside -= np.einsum("kd,kd->k", aside, rows)[:, None] * rows
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    turned = cosine * rows + np.sqrt(max(0.0, 1 - cosine * cosine)) * aside / np.maximum(length, 1e-300)
    return np.where(length > 1e-9, turned, rows).astype(np.float32)


def audit(x: np.ndarray, queries: np.ndarray, own: np.ndarray, cosine: float, rng: np.random.Generator) -> list[tuple]:
    """The drawn and the planted links of the shard: (queries, for each the rows linked with it but its own)."""
    known: list[tuple[int, np.ndarray]] = []
    order, tested = rng.permutation(len(queries)), 0
    for k in range(0, max(AUDITED, len(queries) // WIDEST), AUDITED):
        rows = order[k:k + AUDITED]
        for row, near in zip(rows, queries[rows] @ x.T >= cosine - SLACK, strict=True):
            ids = np.flatnonzero(near)
            if len(ids := ids[ids != own[row]]):
                known.append((row, ids))
                tested += len(ids)
        if tested >= TESTED:
            break
    extra = planted(x, max(0, TESTED - tested), cosine, rng)
    return [(queries[[row for row, _ in known]], [ids for _, ids in known]),
            (extra, [np.flatnonzero(near) for near in extra @ x.T >= cosine - SLACK])]


def linked(graph: hnsw.Graph, exact: np.ndarray, queries: np.ndarray, cosine: float, own: np.ndarray | None = None,
           seed: int = 0) -> list[np.ndarray]:
    """For each query the rows of the shard with at least ``cosine``; see the module's text.  ``own`` has the row that
    a query itself is, or -1."""
    x, wide = graph.vectors, queries.astype(np.float32)
    width, edges = min(BEAM, len(x)), hnsw.both_ways(graph.layers[-1])

    def search(asked: np.ndarray) -> list[np.ndarray]:
        found, step = [], max(1, min(STEP, 4_000_000 // (len(x) + 64 * width)))
        for k in range(0, len(asked), step):
            some = asked[k:k + step]
            ids, sims = graph.search(some, width)
            near = (sims >= cosine - SLACK) & (ids >= 0)
            start = np.zeros((len(some), len(x)), bool)
            start[np.nonzero(near)[0], ids[near]] = True
            found += map(np.flatnonzero, hnsw.reach(x, edges, some, start, cosine - SLACK))
        return found

    def passed(asked: np.ndarray, truth: list[np.ndarray]) -> bool:
        hits = sum(len(np.intersect1d(f, t)) for f, t in zip(search(asked), truth, strict=True))
        return hits >= AUDIT * sum(map(len, truth))

    tests = audit(x, wide, np.full(len(wide), -1) if own is None else own, cosine, np.random.default_rng([17, seed]))
    while width * WIDEST < len(x) and not all(passed(*test) for test in tests):
        width *= 2
    if width * WIDEST < len(x):
        found = search(wide)
    else:
        found = [ids for k in range(0, len(wide), STEP) for ids in map(
            np.flatnonzero, wide[k:k + STEP] @ x.T >= cosine - SLACK)]
    out = []
    for row, ids in enumerate(found):
        out.append(ids[np.einsum("kd,d->k", exact[ids], queries[row]) >= cosine])
    return out


def answers(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Pairs for rows that come by (dim, shard, block): the pieces of the shard, then the queries of the block."""
    at, pieces, shard, waiting = None, [], None, []

    def asked() -> Iterator[pa.RecordBatch]:
        nonlocal shard
        if not waiting or not pieces and shard is None:
            return
        if shard is None:
            graph, exact, numbers = unpacked(pieces)
            pieces.clear()
            shard = graph, exact, numbers, np.argsort(numbers)
        graph, exact, numbers, order = shard
        own = np.concatenate([n for n, _ in waiting])
        queries = hnsw.unit(np.concatenate([x for _, x in waiting]))
        waiting.clear()
        place = order[np.minimum(np.searchsorted(numbers, own, sorter=order), len(order) - 1)]
        near = linked(graph, exact, queries, cosine, np.where(numbers[place] == own, place, -1), int(at[2]))
        a, b = np.repeat(own, list(map(len, near))), numbers[np.concatenate([*near, np.zeros(0, np.int64)]).astype(int)]
        other = a != b
        yield pa.RecordBatch.from_arrays([np.minimum(a, b)[other], np.maximum(a, b)[other]], ["a", "b"])

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "block")], 1).astype(np.int64)
        query = batch.column("node").is_valid().to_numpy(zero_copy_only=False)
        turns = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (query[1:] != query[:-1])) + 1
        for begin, end in zip([0, *turns], [*turns, batch.num_rows], strict=True):
            if begin == end:
                continue
            if at is None or (keys[begin] != at).any():
                yield from asked()
                at, shard = keys[begin], None
                pieces.clear()
                waiting.clear()
            if not query[begin]:
                pieces += batch.column("piece").slice(begin, end - begin).to_pylist()
                continue
            while begin < end:
                size = min(end - begin, BLOCK_ROWS - sum(len(n) for n, _ in waiting))
                x = batch.column("embedding").slice(begin, size).flatten().to_numpy(zero_copy_only=False)
                waiting.append((batch.column("node").slice(begin, size).to_numpy(), x.reshape(size, -1)))
                begin += size
                if sum(len(n) for n, _ in waiting) == BLOCK_ROWS:
                    yield from asked()
    yield from asked()


def links(points: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, each once."""
    def each(number: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1))

    kind = points.schema["embedding"].dataType
    asked = points.select("dim", each("parts").alias("shard"), "block", F.lit(None).cast("int").alias("no"),
                          F.lit(None).cast("binary").alias("piece"), "node", "embedding")
    served = graphs(points).select("dim", "shard", each("blocks").alias("block"), "no", "piece",
                                   F.lit(None).cast("long").alias("node"), F.lit(None).cast(kind).alias("embedding"))
    key = ["dim", "shard", "block"]
    rows = served.unionByName(asked).repartition(*key).sortWithinPartitions(*key, F.asc_nulls_last("no"), "node")
    return rows.mapInArrow(lambda batches: answers(batches, cosine), "a long, b long").distinct()


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, **sizes: int) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    points = nodes(embeddings, **sizes)
    known = points.select("node", "rep", "copies", "embedding")
    pairs = checkpointed(links(points, cosine))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(known.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(
        F.sum("copies").alias("others"))
    joined = components(pairs).join(known.select("node", "rep"), "node")
    smallest = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    told = known.join(others, "node", "left").join(joined.select("node", "component").join(smallest, "component").select(
        "node", "component_id"), "node", "left").select(
        "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.join(told, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
