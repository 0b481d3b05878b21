"""Marked-up text to pages and page elements.

All element extractors are column expressions, so a query that asks only for
watermarks scans the text once and never touches the other patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import catalog as C
from leafmill.functions import text as T
from leafmill.functions.regex import java
from leafmill.operators import tables


def page_array(text: Column) -> Column:
    """Pages of one document as ``array<struct<page_number, marker_no, text>>``.

    Blank pieces are dropped and the rest renumbered from 1; ``marker_no`` keeps
    the number printed on the marker in front of the piece (NULL before the first).
    """
    pieces = F.split(text, java(C.PAGE_MARK))
    marks = F.regexp_extract_all(text, F.lit(java(C.PAGE_MARK)), F.lit(1))
    tagged = F.transform(pieces, lambda p, i: F.struct(
        F.get(marks, i - 1).cast("string").alias("marker_no"), T.strip(p).alias("text")))
    kept = F.filter(tagged, lambda p: p["text"] != "")
    return F.transform(kept, lambda p, i: F.struct(
        (i + 1).cast("int").alias("page_number"),
        p["marker_no"].try_cast("int").alias("marker_no"),
        p["text"].alias("text")))


def split_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per page: id, page_number, marker_no, text."""
    return T.unnest(docs, [id_col], page_array(F.col(text_col))).select(id_col, "_item.*")


# --- element extractors (arrays of strings) -----------------------------------------


def _all_behind(text: Column, sign: str, pattern: str, **flags) -> Column:
    """``find_all`` of a pattern whose matches hold ``sign``, run only on text that does."""
    return F.when(~text.contains(sign), F.array().cast("array<string>")).otherwise(T.find_all(text, pattern, **flags))


def equations(text: Column) -> Column:
    """Display, inline, equation and align bodies, in that pattern order."""
    patterns = {C.DISPLAY_EQUATION: "$$", C.INLINE_EQUATION: "$", C.EQUATION_BLOCK: "\\begin{equation", C.ALIGN_BLOCK: "\\begin{align"}
    return T.non_blank(F.concat(*[_all_behind(text, sign, p, dotall=True) for p, sign in patterns.items()]))


def environment_equations(text: Column) -> Column:
    """Variant with one alternation in document order: dollar maths is consumed but
    contributes nothing, only equation/align bodies are returned."""
    pattern = C.ANY_EQUATION
    bodies = F.zip_with(T.find_all(text, pattern, 1, dotall=True), T.find_all(text, pattern, 2, dotall=True),
                        lambda a, b: F.concat(a, b))
    return T.non_blank(bodies)


def images(text: Column, across_lines: bool = True) -> Column:
    return T.non_blank(_all_behind(text, "<img>", C.IMAGE, dotall=across_lines))


def watermarks(text: Column) -> Column:
    return T.non_blank(_all_behind(text, "<watermark>", C.WATERMARK))


def page_marks(text: Column) -> Column:
    return T.non_blank(_all_behind(text, "<page_number>", C.PRINTED_NUMBER))


def checkboxes(text: Column) -> Column:
    """All ticked boxes, then all empty ones; a label ends at a newline or the next box."""
    def boxes(mark: str, state: bool) -> Column:
        return F.transform(_all_behind(text, mark, mark + r"\s*([^\n☐☑]*)"),
                           lambda label: F.struct(F.lit(state).alias("checked"), T.strip(label).alias("label")))

    return F.concat(boxes(C.CHECKED, True), boxes(C.UNCHECKED, False))


ELEMENTS = {
    "latex_equations": equations,
    "image_descriptions": images,
    "watermarks": watermarks,
    "page_numbers_extracted": page_marks,
    "checkboxes": checkboxes,
}


def table_columns(found: Column) -> dict[str, Column]:
    """Source and CSV of the tables found in a page."""
    return {"tables_html": found["html"],
            "tables_csv": F.transform(found, lambda t: tables.csv_text(t["own"]))}


def page_record(text: Column, environments_only: bool = False) -> dict[str, Column]:
    """All element columns of a page text but its tables, by output name."""
    cols = {name: make(text) for name, make in ELEMENTS.items()}
    if environments_only:
        cols["latex_equations"] = environment_equations(text)
        cols["image_descriptions"] = images(text, across_lines=False)
        cols.pop("checkboxes")
    return cols


def parse_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                environments_only: bool = False) -> DataFrame:
    """Full page record, one row per page."""
    pages = split_pages(docs, id_col, text_col).withColumn("_found", tables.text_tables(F.col("text")))
    return pages.select(
        id_col, "page_number", "marker_no", F.col("text").alias("raw_text"),
        *[c.alias(n) for n, c in table_columns(F.col("_found")).items()],
        *[c.alias(n) for n, c in page_record(F.col("text"), environments_only).items()])


def with_tables(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``_pages`` (``page_array``) and ``_found``, the tables of each page."""
    paged = docs.withColumn("_pages", page_array(text))
    return paged.withColumn("_found", tables.found_tables(F.transform("_pages", lambda p: p["text"])))


def parsed_array() -> Column:
    """Page records of a document inside its row (no shuffle), from the columns of ``with_tables``."""
    def record(page: Column, found: Column) -> Column:
        body = page["text"]
        return F.struct(
            page["page_number"].alias("page_number"), body.alias("raw_text"),
            *[c.alias(n) for n, c in table_columns(found).items()], *[ELEMENTS[n](body).alias(n) for n in ELEMENTS])

    return F.transform("_pages", lambda p, i: T.let(F.get(F.col("_found"), i), lambda found: record(p, found)))


def parse_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with ``pages`` as a nested array, the same records as ``parse_pages``."""
    return with_tables(docs.select(id_col, text_col), F.col(text_col)).select(id_col, parsed_array().alias("pages"))


def element_flags(text: Column) -> dict[str, Column]:
    """Does the text show a table, an equation, an image."""
    return {
        "has_table": text.rlike(C.TABLE_SIGN),
        "has_equation": text.rlike(java(C.EQUATION_SIGN)),
        "has_image": text.rlike(java(C.IMAGE_SIGN)),
    }


def content_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Elements per document, summed over its pages within the row."""
    def count(make) -> Column:
        return F.aggregate("_pages", F.lit(0).cast("bigint"), lambda acc, p: acc + F.size(make(p["text"])))

    return with_tables(docs.select(id_col, text_col), F.col(text_col)).select(
        id_col, F.size("_pages").cast("bigint").alias("n_pages"),
        F.aggregate("_found", F.lit(0).cast("bigint"), lambda acc, t: acc + F.size(t)).alias("n_tables"),
        count(equations).alias("n_equations"), count(images).alias("n_images"), count(watermarks).alias("n_watermarks"))


def text_statistics(text: Column) -> dict[str, Column]:
    """Characters, white-space separated words, newline separated lines."""
    pieces = F.split(text, java(r"\s+"))
    return {
        "n_chars": F.length(text).cast("bigint"),
        "n_words": F.size(F.filter(pieces, lambda w: w != "")).cast("bigint"),
        "n_lines": F.size(F.split(text, "\n")).cast("bigint"),
    }
