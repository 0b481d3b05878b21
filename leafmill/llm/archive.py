"""Content-addressed web archive.

``write_archive`` keeps every payload's bytes once, under their SHA-256, and the exact header block of every record
apart.  ``read_archive`` checks each payload against its digest and rebuilds the original records by a join;
``export_warc`` writes them as WARC/1.1 files and ``read_warc`` reads such files.

Of the records with one payload of at least ``min_revisit`` bytes the one with the largest page_id is the response
and the others revisit it; smaller payloads are always responses.

Defined cases: a null html is an empty payload; a null url leaves its header out; line breaks in a url are percent
encoded; rows that share page_id and payload are all records, all responses if theirs is the largest page_id; a null
page_id is smaller than any other and written as an empty header value; other columns are ignored; an empty table
gives an empty archive.  Different payloads under one digest stop the job.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _text(value) -> Column:
    return F.coalesce(F.col(value).cast("string"), F.lit(""))


def _record_id(page_id: str) -> Column:
    code = F.md5(F.concat_ws("/", _text(page_id), F.col("digest")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(code, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
                    F.lit(">"))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, date: str = DATE) -> None:
    """Write ``folder``/payloads (digest, payload) and ``folder``/headers (digest, head)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("digest"))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(
        f"{folder}/payloads")
    facts = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"),
                        F.octet_length("payload").cast("long").alias("bytes"))
    same = (F.min("sha1") == F.max("sha1")) & (F.min("bytes") == F.max("bytes"))
    owners = facts.groupBy("digest").agg(F.max("page_id").alias("owner"), same.alias("same"))
    checked = F.when(F.col("same"), F.col("owner")).otherwise(
        F.raise_error(F.lit("different payloads share a digest")).cast("long"))
    records = facts.join(owners.select("digest", checked.alias("owner")), "digest")
    revisit = (F.col("bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    link = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id("page_id")), _field("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), _field("WARC-Target-URI", link)).otherwise(""),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, F.concat(_field("WARC-Refers-To", _record_id("owner")), _field("WARC-Profile", F.lit(PROFILE)),
                                 _field("Refers-To-Page", _text("owner")))).otherwise(""),
        _field("Page", _text("page_id")), _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", (F.when(revisit, 0).otherwise(F.col("bytes")) + len(HTTP)).cast("string")),
        F.lit("\r\n" + HTTP))
    records.select("digest", head.alias("head")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def header(name: str) -> Column:
    """A field of the record's header block, empty if it isn't there."""
    return F.regexp_extract(F.substring_index("head", "\r\n\r\n", 1), rf"\r\n{name}: ([^\r\n]*)", 1)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: what its header says, the payload (a revisit's comes from the store as well) and the exact
    bytes of the original record.  Every record is rebuilt; one whose length or payload digest differs from what its own
    header says fails the query."""
    store = spark.read.parquet(f"{folder}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("binary"))
    rows = spark.read.parquet(f"{folder}/headers").join(store.select("digest", sound.alias("payload")), "digest")
    number = lambda name: F.nullif(header(name), F.lit("")).cast("long")
    block = F.when(header("WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    rows = rows.withColumn("record", F.concat(F.col("head").cast("binary"), block, F.lit("\r\n\r\n").cast("binary")))
    fits = (F.octet_length("record") == F.octet_length("head") + number("Content-Length") - len(HTTP) + 4) & (
        header("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.sha1("payload")))
    whole = F.when(fits, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("a record differs from its header: page "), header("Page"))).cast("binary"))
    return rows.select(
        number("Page").alias("page_id"), header("WARC-Target-URI").alias("url"), header("WARC-Type").alias("record_type"),
        number("Refers-To-Page").alias("refers_to"), "digest", whole.alias("payload"), "record")


def export_warc(records: DataFrame, folder: str) -> None:
    """Write the records as WARC files; the two line breaks after each record are the writer's separator."""
    text = F.decode("record", "UTF-8")
    records.select(F.substring(text, F.lit(1), F.char_length(text) - 4).alias("value")).write.option(
        "lineSep", "\r\n\r\n").text(folder)


def parse_warc(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Header block and content of each record of a file, by Content-Length."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        head = data[at:cut].decode("utf-8")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        size = int(fields["Content-Length"])
        yield head, data[cut + 4:cut + 4 + size]
        at = cut + 8 + size


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records (head, content) of WARC files, plain or compressed; a task holds one file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                data = data.as_py()
                found = list(parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                for k in range(0, len(found), 500):
                    heads, blocks = zip(*found[k:k + 500], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(blocks)], names=["head", "content"])

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(rows, "head string, content binary")
