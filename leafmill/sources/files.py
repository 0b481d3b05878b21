"""File catalogue, stored objects, page text and web pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import catalog as C
from leafmill.functions import text as T
from leafmill.operators import checks

MB = 1024 * 1024


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing of all files below a path: path, length, modificationTime.  Contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")


def file_type(path: Column) -> dict[str, Column]:
    """file_type (image, pdf, unknown), is_valid and the message for unsupported ones."""
    ext = checks.extension(path)
    kind = F.when(ext.isin(C.IMAGE_EXTENSIONS), "image").when(ext.isin(C.DOCUMENT_EXTENSIONS), "pdf").otherwise("unknown")
    return {"extension": ext, "file_type": kind, "is_valid": kind != "unknown",
            "error_message": F.when(kind == "unknown", F.concat(F.lit("Unsupported file type: "), ext))}


def accepted(path: Column) -> Column:
    """Is the file of a kind that a converter in front of the recogniser can take."""
    return checks.extension(path).isin(C.WIDE_EXTENSIONS)


def file_metadata(path: Column, size: Column) -> dict[str, Column]:
    """filename, size in MB to 2 digits, upper-case type."""
    return {"filename": checks.base_name(path), "file_size_mb": F.bround(size / MB, 2),
            "file_type": F.upper(F.replace(checks.extension(path), F.lit("."), F.lit("")))}


def recognise(pages: DataFrame, batch_fn: Callable, image_col: str, keys: str, partitions: int | None = None) -> DataFrame:
    """Run a caller's recogniser over page rows in Arrow batches.

    ``batch_fn`` takes a pandas Series of page contents and returns texts; ``keys`` is the DDL
    of the key columns to keep.  A batch that raises becomes rows whose text starts with
    ``Error``: one bad page batch never fails the job.  Put ``partitions`` above the number of
    slots so that slow pages spread.
    """
    names = [part.split()[0] for part in keys.split(",")]

    def run(batches):
        import time
        for pdf in batches:
            start = time.time()
            try:
                texts = list(batch_fn(pdf[image_col]))
            except Exception as exc:  # reported as rows
                texts = [f"Error processing image: {exc}"] * len(pdf)
            out = pdf[names].copy()
            out["text"] = texts
            out["seconds"] = (time.time() - start) / max(len(pdf), 1)
            yield out

    src = pages.repartition(partitions) if partitions else pages
    rows = src.select(*names, image_col).mapInPandas(run, f"{keys}, text string, seconds double")
    return with_outcome(rows)


def with_outcome(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """success and error_message from the text a recogniser returned."""
    failed = F.col(text_col).startswith("Error") | F.col(text_col).startswith("CUDA")
    return pages.withColumn("success", ~failed).withColumn("error_message", F.when(failed, F.col(text_col)))


def assemble(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page_number", text_col: str = "text",
             seconds_col: str = "seconds") -> DataFrame:
    """Document text from its pages, each behind a page marker; page times summed.

    A document is one row whatever its number of pages, so its pages meet in one task.  Work that
    can do with one page at a time should stay on the page rows.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("n"), F.col(text_col).alias("t"))))
    marked = F.transform(ordered, lambda p: F.concat(
        F.lit("\n--- Page "), p["n"].cast("string"), F.lit(" ---\n"), p["t"]))
    return pages.groupBy(id_col).agg(
        F.array_join(marked, "\n\n").alias("text"), F.count("*").alias("n_pages"),
        F.sum(seconds_col).alias("seconds"))


_HIDDEN = r"(?is)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(script|style)\b[^>]*>.*?</\1\s*>|<!doctype[^>]*>"


def html_text(html: Column) -> Column:
    """Visible text of a page, one stripped text node per line.  Comments, scripts and styles are left out."""
    body = F.regexp_replace(F.regexp_replace(html, _HIDDEN, ""), r"<[^>]*>", "\u0001")
    return F.array_join(T.non_blank(F.split(T.html_unescape(body), "\u0001")), "\n")


def list_objects(objects: DataFrame, prefix: str, max_keys: int = 1000) -> DataFrame:
    """First objects by key below a prefix (a top-n, no full sort)."""
    return objects.filter(F.col("key").startswith(prefix)).orderBy("key").limit(max_keys)


def object_key(tenant: Column, day: Column, filename: Column) -> Column:
    """``tenant/yyyy/MM/dd/<8 hex of the name's sha256>_<name>``."""
    return F.concat_ws("/", tenant, F.date_format(day, "yyyy/MM/dd"),
                       F.concat(F.substring(F.sha2(filename, 256), 1, 8), F.lit("_"), filename))


def upload_record(content: Column, doc_id: Column, filename: Column) -> dict[str, Column]:
    """Stored-file record; the id comes from the first 1024 characters and the document id, not from a clock."""
    return {
        "file_id": F.substring(F.sha2(F.concat(F.substring(content, 1, 1024), doc_id.cast("string")), 256), 1, 16),
        "filename": checks.safe_name(filename, "unnamed"),
        "size_bytes": F.octet_length(content).cast("bigint"), "content_hash": F.sha2(content, 256)}


def storage_statistics(files: DataFrame) -> DataFrame:
    """Files and bytes per storage area."""
    return files.groupBy("area").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes")).withColumn(
        "size_mb", F.bround(F.col("size_bytes") / MB, 2))


LOG_SCHEMA = ("timestamp string, level string, logger string, message string, module string, function string, "
              "line int, request_id string, user_id string, tenant_id string, action string, resource_type string, "
              "resource_id string, outcome string, details map<string,string>")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines log and audit records; a fixed schema, so no inference pass."""
    return spark.read.schema(LOG_SCHEMA).json(path)


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Recognised text: parquet, json, or one document per text file."""
    if fmt == "text":
        return spark.read.text(path, wholetext=True).select(
            F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return spark.read.format(fmt).load(path)


