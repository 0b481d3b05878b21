"""Parsed pages to JSON, XML, CSV, HTML and text listings.

Columns here take the ``pages`` array of ``operators.pages.parse_documents``; a document
is rendered inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import catalog as C


def _flat(pages: Column, name: str) -> Column:
    return F.flatten(F.transform(pages, lambda p: p[name]))


def _or(items: Column, joined: Column, message: str) -> Column:
    return F.when(F.size(items) == 0, message).otherwise(joined)


def as_json(pages: Column) -> Column:
    """Compact JSON of all page records."""
    return F.to_json(F.struct(pages.alias("pages")), {"ignoreNullFields": "false"})


def _numbered(items: Column, value_name: str = "_VALUE") -> Column:
    """Elements with an id attribute; NULL when empty, so the section is left out."""
    return F.when(F.size(items) > 0, F.transform(items, lambda x, i: F.struct(
        (i + 1).alias("_id"), x.alias(value_name))))


def as_xml(pages: Column) -> Column:
    """XML document: one Page element per page, empty sections left out."""
    def page(p: Column) -> Column:
        tables = F.when(F.size(p["tables_html"]) > 0, F.struct(F.transform(
            p["tables_html"], lambda h, i: F.struct((i + 1).alias("_id"), h.alias("HTMLContent"),
                                                    F.get(p["tables_csv"], i).alias("CSVContent"))).alias("Table")))

        def section(name: str, element: str) -> Column:
            return F.when(F.size(p[name]) > 0, F.struct(_numbered(p[name]).alias(element)))

        boxes = F.when(F.size(p["checkboxes"]) > 0, F.struct(F.transform(p["checkboxes"], lambda b, i: F.struct(
            (i + 1).alias("_id"), b["checked"].alias("_checked"), b["label"].alias("_VALUE"))).alias("Checkbox")))
        return F.struct(
            p["page_number"].alias("_number"), p["raw_text"].alias("RawText"), tables.alias("Tables"),
            section("latex_equations", "Equation").alias("Equations"),
            section("image_descriptions", "Description").alias("Images"),
            section("watermarks", "Watermark").alias("Watermarks"),
            section("page_numbers_extracted", "PageNumber").alias("PageNumbers"), boxes.alias("Checkboxes"))

    return F.to_xml(F.struct(F.transform(pages, page).alias("Page")),
                    {"rowTag": "DocumentOCR", "attributePrefix": "_", "valueTag": "_VALUE"})


def as_csv(pages: Column) -> Column:
    """All tables of the document as numbered CSV blocks."""
    tables = _flat(pages, "tables_csv")
    blocks = F.transform(tables, lambda t, i: F.concat(
        F.lit("--- Table "), (i + 1).cast("string"), F.lit(" ---\n"), t))
    return _or(tables, F.array_join(blocks, "\n\n"), C.NO_CSV)


def as_html(pages: Column) -> Column:
    """Preview page: a block per page, newlines as line breaks."""
    blocks = F.transform(pages, lambda p: F.concat(
        F.lit(C.PREVIEW_BLOCK), p["page_number"].cast("string"), F.lit(C.PREVIEW_BODY),
        F.replace(p["raw_text"], F.lit("\n"), F.lit("<br>")), F.lit("</div>\n</div>")))
    return F.array_join(F.concat(F.array(F.lit(C.PREVIEW_HEAD)), blocks, F.array(F.lit("</div>"))), "\n")


def tables_html(pages: Column) -> Column:
    tables = _flat(pages, "tables_html")
    return _or(tables, F.array_join(tables, "\n"), C.NO_TABLES)


def _listing(pages: Column, name: str, line) -> Column:
    return F.flatten(F.transform(pages, lambda p: F.transform(p[name], lambda x, i: line(p["page_number"], x, i + 1))))


def equation_listing(pages: Column) -> Column:
    lines = _listing(pages, "latex_equations", lambda n, x, i: F.concat(
        F.lit("--- Page "), n.cast("string"), F.lit(", Equation "), i.cast("string"), F.lit(" ---\n"), x))
    return _or(lines, F.array_join(lines, "\n\n"), C.NO_EQUATIONS)


def _labelled(pages: Column, name: str, label: str, message: str) -> Column:
    lines = _listing(pages, name, lambda n, x, i: F.concat(
        F.lit("Page "), n.cast("string"), F.lit(f", {label} "), i.cast("string"), F.lit(": "), x))
    return _or(lines, F.array_join(lines, "\n"), message)


def image_listing(pages: Column) -> Column:
    return _labelled(pages, "image_descriptions", "Image", C.NO_IMAGES)


def watermark_listing(pages: Column) -> Column:
    return _labelled(pages, "watermarks", "Watermark", C.NO_WATERMARKS)


def page_number_listing(pages: Column) -> Column:
    lines = _listing(pages, "page_numbers_extracted", lambda n, x, i: F.concat(
        F.lit("Page "), n.cast("string"), F.lit(": "), x))
    return _or(lines, F.array_join(lines, "\n"), C.NO_PAGE_NUMBERS)


def _item_values(item: Column) -> Column:
    return F.array(*[F.coalesce(item[c], F.lit("")) for c in ("description", "quantity", "rate", "amount")])


def items_csv(items: Column) -> Column:
    """Line items as CSV text (values as found, not quoted)."""
    lines = F.transform(items, lambda i: F.array_join(_item_values(i), ","))
    return _or(items, F.array_join(F.concat(F.array(F.lit(",".join(C.ITEM_HEADER))), lines), "\n"), C.NO_ITEMS)


def items_html(items: Column) -> Column:
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in C.ITEM_HEADER) + "</tr>"
    rows = F.transform(items, lambda i: F.concat(F.lit("<tr><td>"), F.array_join(_item_values(i), "</td><td>"),
                                                 F.lit("</td></tr>")))
    return _or(items, F.concat(F.lit(f"<table>{head}"), F.array_join(rows, ""), F.lit("</table>")),
               "<p>No tables found in document.</p>")


RENDERERS = {"json": as_json, "xml": as_xml, "csv": as_csv, "html": as_html}


def render(parsed: DataFrame, fmt: str, id_col: str = "doc_id") -> DataFrame:
    """Documents in one output format."""
    return parsed.select(id_col, RENDERERS[fmt](F.col("pages")).alias("output"))


def envelope(records: DataFrame, filename: Column, size: Column, n_pages: Column, id_col: str = "doc_id") -> DataFrame:
    """Response document: file metadata around the structured result."""
    from leafmill.operators import checks
    document = F.struct(
        filename.alias("filename"), F.bround(size / (1024 * 1024), 3).alias("file_size_mb"),
        F.upper(F.replace(checks.extension(filename), F.lit("."), F.lit(""))).alias("file_type"),
        n_pages.alias("total_pages"))
    result = F.struct("document_type", "confidence", "language",
                      F.map_from_entries("extracted_fields").alias("extracted_fields"), "line_items", "entities")
    return records.select(id_col, F.to_json(F.struct(
        F.lit("2.0").alias("api_version"), F.lit("completed").alias("status"), document.alias("document"),
        result.alias("result")), {"ignoreNullFields": "false"}).alias("response"))


def record_xml(records: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Structured record as XML, values escaped."""
    fields = F.transform("extracted_fields", lambda f: F.struct(f["field"].alias("_name"), f["value"].alias("_VALUE")))
    body = F.struct("document_type", "language", "confidence", F.struct(fields.alias("field")).alias("extracted_fields"))
    return records.select(id_col, F.to_xml(body, {
        "rowTag": "document", "attributePrefix": "_", "valueTag": "_VALUE"}).alias("xml"))
