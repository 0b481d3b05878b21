"""Near-duplicate classes by order min-hash and banded alignment.

Texts with the same words are one node.  A sketch keeps several least occurrence-labelled shingles of five words in
the order of the text, so equal sketches speak for equal passages in equal order; nodes that share one are a bucket.
Two nodes are linked if the alignment of their shingles covers at least 0.8 of all of them (common over a + b - common,
the Jaccard similarity of shingles in order).  Classes are the components of the links.

No bucket is expanded into all its pairs.  First each member is aligned with one member picked by a hash, another one
in each bucket, and what that links is joined.  Only buckets whose members then still belong to several components go
on; nodes that such buckets connect are a cluster, whose most central member (in the most and largest buckets) is its hub.
Every node is aligned with its hub, which links what is near it.  For the rest it is enough to look at differences: with
D(a) the shingles that a and the hub do not share, a pair of similarity 0.8 of which one node is not near the hub has a
common shingle in D(a) and D(b) (its symmetric difference is |D(a)| + |D(b)| less twice the common part, and D of the one
alone exceeds what is allowed).  Copies of one text differ from it at their own places, so these sets are small and rare
where whole texts have nearly everything in common.  Pairs across components that share a shingle so early in the order
of rarity that the similarity can still be reached are aligned.  Nodes farther from the hub than their own length are
compared by all their shingles in the same way; those from 0.6 of it on in both ways, so no pair falls between.  Nodes with
the hub's shingles in another order, thus near but not aligned, are compared with the near ones by all their shingles.
Nothing is capped and nothing depends on a size; a pair of similarity 0.8 meets in a bucket with a probability of 0.99999.

Defined cases: null texts and texts without words are never linked; fewer than five words are one shingle; equal
texts are linked whatever their length; the class is named by its smallest doc_id (null first); rows with the same
doc_id are told apart by their text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import shingles
from leafmill.llm.common import checkpointed, sliced
from leafmill.llm.components import components

TENTHS = 8
#: Shingles in a sketch and sketches of a text.
KEPT, SKETCHES = 3, 16
#: Parts into which the nodes of one hub are dealt.
SALTS = 32
#: How a node's marks are meant: those that differ from the hub's, or all.
DIFFERENT, ALL = 0, 1


def _groups(lines: list[bytes]) -> Iterator[range]:
    """Consecutive lines of about a block together."""
    begin = size = 0
    for i, line in enumerate(lines):
        size += len(line) + 1
        if size >= shingles.BLOCK_BYTES:
            yield range(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(lines):
        yield range(begin, len(lines))


def _long_lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.view(np.int64).ravel()))


def facts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, a hash of its text, the digest of its words (null without words), its sketches."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lines = [shingles.plain(t or "") for t in batch.column("text").to_pylist()]
            found = np.zeros((len(lines), SKETCHES), np.uint64)
            for group in _groups(lines):
                found[group.start:group.stop] = shingles.sketches(
                    *shingles.shingle_numbers(lines[group.start:group.stop]), KEPT, SKETCHES, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"),
                 pa.array([shingles.digest(x) if x else None for x in lines], pa.binary()), _long_lists(found)],
                names=["doc_id", "text_hash", "digest", "sketch"])

    return rows.mapInArrow(one, "doc_id long, text_hash long, digest binary, sketch array<long>")


def sequences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, seq) for ``wanted`` (node, doc_id, text_hash): the shingle numbers of the node's text, packed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["text_hash"] == wanted["text_hash"])
    texts = rows.join(wanted, same).select(wanted["node"], rows["text"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lines = [shingles.plain(t) for t in batch.column("text").to_pylist()]
            out: list[bytes] = []
            for group in _groups(lines):
                numbers, bounds = shingles.shingle_numbers(lines[group.start:group.stop])
                out += [numbers[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "seq"])

    return texts.mapInArrow(one, "node long, seq binary").dropDuplicates(["node"])


def marked(seqs: DataFrame) -> DataFrame:
    """(node, marks): the occurrence-labelled shingles of each node, all different."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "seq"):
            own = [np.frombuffer(s, np.uint32) for s in batch.column("seq").to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int64)
            marks = shingles.labelled(np.concatenate([np.zeros(0, np.uint32), *own]), bounds).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(
                pa.array(bounds.astype(np.int32)), pa.array(marks))], names=["node", "marks"])

    return seqs.mapInArrow(one, "node long, marks array<long>")


def buckets(sketched: DataFrame) -> DataFrame:
    """(bucket, node, size, leader) of all buckets with several nodes; the leader is picked by a hash of both."""
    rows = sketched.select("node", F.posexplode("sketch").alias("nth", "key")).select(
        "node", F.xxhash64("nth", "key").alias("bucket"))
    pick = F.min(F.struct(F.xxhash64("node", "bucket"), "node"))["node"]
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), pick.alias("leader")).where("size > 1")
    return rows.join(sizes, "bucket")


def verified(pairs: DataFrame, seqs: DataFrame, tenths: int = TENTHS) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the similarity."""
    lengths = pairs.join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("left")), "a").join(
        seqs.select(F.col("node").alias("b"), F.col("seq").alias("right")), "b").where(
        F.least(F.octet_length("left"), F.octet_length("right")) * 10
        >= F.greatest(F.octet_length("left"), F.octet_length("right")) * tenths)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("left"), batch.column("right"), strict=True)
            good = [shingles.similar(*(np.frombuffer(x.as_buffer(), np.uint32) for x in pair), tenths) for pair in both]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return lengths.select("a", "b", "left", "right").mapInArrow(one, "a long, b long")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their component as label."""
    named = members.join(components(found), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    spread = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return named.join(spread.select("bucket"), "bucket", "left_semi")


def clusters(spread: DataFrame) -> DataFrame:
    """(node, hub): the nodes that open buckets connect, and the most central one of them."""
    joined = components(spread.select("node", "leader"), "node", "leader")
    weighed = spread.groupBy("node").agg(F.sum("size").alias("weight")).join(joined, "node")
    hubs = weighed.groupBy("component").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    return weighed.join(hubs, "component").select("node", "hub")


def against_hubs(members: DataFrame, seqs: DataFrame, tenths: int = TENTHS) -> DataFrame:
    """For (node, hub): whether they are linked, whether their shingles alone reach the similarity (near), the number of
    the node's shingles, and its rows of marks (kind, marks).  A hub's nodes are dealt over parts."""
    hubs = seqs.select(F.col("node").alias("hub"), F.col("seq").alias("hub_seq")).join(
        members.select("hub").distinct(), "hub").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = members.join(seqs, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(
        hubs, ["hub", "salt"]).select("node", "hub", "seq", "hub_seq")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(sliced([whole], "seq"), "hub_seq"):
                out: dict[str, list] = {c: [] for c in ("node", "hub", "linked", "near", "n", "kinds")}
                for node, hub, seq, hub_seq in zip(*(batch.column(c) for c in ("node", "hub", "seq", "hub_seq")), strict=True):
                    a, h = (np.frombuffer(x.as_buffer(), np.uint32) for x in (seq, hub_seq))
                    own, other = (shingles.labelled(x, np.array([0, len(x)])).view(np.int64) for x in (a, h))
                    differ = np.setxor1d(own, other, assume_unique=True)
                    near = (10 + tenths) * len(differ) <= (10 - tenths) * (len(a) + len(h))
                    kinds = [{"kind": DIFFERENT, "marks": differ}] if len(differ) <= len(a) else []
                    if 10 * len(differ) > 6 * len(a):
                        kinds.append({"kind": ALL, "marks": own})
                    found = (node.as_py(), hub.as_py(), near and shingles.similar(a, h, tenths), near, len(a), kinds)
                    for column, value in zip(out.values(), found, strict=True):
                        column.append(value)
                kinds = pa.list_(pa.struct([("kind", pa.int32()), ("marks", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["node"], pa.int64()), pa.array(out["hub"], pa.int64()), pa.array(out["linked"], pa.bool_()),
                     pa.array(out["near"], pa.bool_()), pa.array(out["n"], pa.int64()), pa.array(out["kinds"], kinds)],
                    names=list(out))

    return rows.mapInArrow(one, "node long, hub long, linked boolean, near boolean, n long, kinds array<struct<kind:int,marks:array<long>>>")


def rare(told: DataFrame) -> DataFrame:
    """(hub, kind, mark, node, label, near, n, d, place) of the rarest marks of each node, with d marks in all: so many
    that it surely shares one with any node of the similarity.  Marks that only one node has come first and need no row.

    What two similar nodes share of their marks is at least (d + d' - (n + n') / 9) / 2; as d' is at least d - (n + n') / 9
    and n' at most 5 / 4 n, that is at least d - n / 4."""
    rows = told.select("hub", "node", "label", "near", "n", F.inline("kinds")).select(
        "hub", "kind", "node", "label", (F.col("near") & (F.col("kind") == DIFFERENT)).alias("near"), "n",
        F.size("marks").alias("d"), F.explode("marks").alias("mark"))
    held = rows.groupBy("hub", "kind", "mark").agg(F.count("*").alias("held")).where("held > 1")
    own = Window.partitionBy("node", "kind")
    place = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("held", "mark"))
    return rows.join(held, ["hub", "kind", "mark"]).withColumn("place", place).drop("held").where(
        F.col("place") <= F.floor(F.col("n") / 4) + 1)


def sharing(marks: DataFrame, tenths: int = TENTHS) -> DataFrame:
    """Pairs across components that share a mark so early that what follows it in both can still reach the similarity.
    At the first mark that two nodes share, no more than the rest of either can be common."""
    side = lambda k: marks.select("hub", "kind", "mark", *[
        F.col(c).alias(c + k) for c in ("node", "label", "near", "n", "d", "place")])
    most = F.least(F.col("dx") - F.col("placex"), F.col("dy") - F.col("placey")) + 1
    least = (F.col("dx") + F.col("dy")) * (10 + tenths) - (F.col("nx") + F.col("ny")) * (10 - tenths)
    fits = (F.col("labelx") < F.col("labely")) & ~(F.col("nearx") & F.col("neary")) & (most * 2 * (10 + tenths) >= least)
    return side("x").join(side("y"), ["hub", "kind", "mark"]).where(fits).select(*_ordered("nodex", "nodey")).distinct()


def turned(told: DataFrame, seqs: DataFrame) -> DataFrame:
    """Pairs of nodes near a hub of which one is not aligned with it: by all their marks."""
    hubs = told.where("near and not linked").select("hub").distinct()
    some = told.where("near").join(hubs, "hub", "left_semi")
    every = F.array(F.struct(F.lit(ALL).alias("kind"), F.col("marks")))
    return sharing(rare(some.drop("kinds").join(marked(seqs), "node").withColumn("kinds", every)))


def links(sketched: DataFrame, seqs_of) -> DataFrame:
    """Verified links (a, b) that span the components; ``seqs_of`` gives the sequences of a (node) frame."""
    members = checkpointed(buckets(sketched))
    seqs = checkpointed(seqs_of(members.select("node").distinct()))
    found = checkpointed(verified(members.where("node <> leader").select(*_ordered("node", "leader")).distinct(), seqs))
    spread = checkpointed(_open(members, found))
    if not spread.take(1):
        return found
    told = checkpointed(against_hubs(clusters(spread), seqs))
    found = checkpointed(found.unionByName(told.where("linked and node <> hub").select(*_ordered("node", "hub")).distinct()))
    told = told.join(components(found), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    across = sharing(checkpointed(rare(told)))
    if told.where("near and not linked").take(1):
        across = across.unionByName(turned(told, seqs)).distinct()
    return found.unionByName(checkpointed(verified(checkpointed(across), seqs)))


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, class_id (smallest doc_id of its class), kept."""
    rows = checkpointed(facts(docs))
    first = F.min(F.struct("doc_id", "text_hash"))
    nodes = checkpointed(rows.where("digest is not null").groupBy("digest").agg(
        first.alias("first"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()))
    named = nodes.select("node", "first.doc_id", "first.text_hash")
    found = links(nodes.select("node", "sketch"), lambda some: sequences(docs, named.join(some, "node", "left_semi")))
    joined = components(found).join(nodes.select("node", "first"), "node")
    tops = joined.groupBy("component").agg(F.min("first").alias("top"))
    top = joined.join(tops, "component").select("node", "top")
    told = nodes.select("node", "digest", "first").join(top, "node", "left").select(
        "digest", F.coalesce("top", "first").alias("top"))
    out = rows.select("doc_id", "text_hash", "digest").join(told, "digest", "left")
    own = F.struct("doc_id", "text_hash")
    return out.select("doc_id", "text_hash", F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(
        F.col("top.doc_id")).alias("class_id"), F.coalesce(own == F.col("top"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns; a row that is repeated stays once.

    Join and removal of repeated rows deal and order the texts by the same plain columns, so these are shuffled and
    sorted once."""
    keys = ["__id", "__null", "__hash"]

    def keyed(rows: DataFrame, text_hash: Column) -> DataFrame:
        number = F.col("doc_id").cast("long")
        return rows.withColumns({"__id": F.coalesce(number, F.lit(0)), "__null": number.isNull(), "__hash": text_hash})

    kept = keyed(classes(docs).where("kept"), F.col("text_hash")).select(*keys)
    return keyed(docs, F.xxhash64("text")).join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
