"""HTML tables in text: tables, cells, CSV, line items.

Ordinary tables are cut out with native regexes.  Text whose tables are nested or
badly closed goes through one Arrow function over the standard HTML tokenizer;
other rows send it NULL, so their text is not shipped to Python.  Row, cell and CSV functions take a
table's ``own`` form (for an ordinary table that is its source).
Cell text is kept as written: no number inference, no spans (``table_grid`` has both).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from leafmill.functions import catalog as C
from leafmill.functions import text as T
from leafmill.functions.regex import java
from leafmill.operators.table_tokenizer import tables_in

def _up_to(end: str) -> str:
    """Pattern for ``.*?`` in front of ``<end>`` that looks for the end only behind a ``<``."""
    return rf"[^<]*+(?:<(?!{end})[^<]*+)*+"


_TABLE = rf"(?i)<table\b[^>]*+>{_up_to(r'/table\s*+>')}</table\s*+>"
_ROW = rf"(?i)<tr\b[^>]*+>({_up_to(r'/tr\s*+>')})</tr\s*+>"
_CELL = rf"(?i)<t[hd]\b[^>]*+>({_up_to(r'/t[hd]\s*+>')})</t[hd]\s*+>"
#: A table's source, and its own level with all rows and cells closed (see ``found_tables``).
TABLES = "array<struct<html:string,own:string>>"


def flat_tables(text: Column) -> Column:
    """``TABLES`` of a text without nested or odd tables: the source is its own level."""
    return F.transform(F.regexp_extract_all(text, F.lit(_TABLE), F.lit(0)),
                       lambda t: F.struct(t.alias("html"), t.alias("own")))


def needs_tokenizer(text: Column) -> Column:
    """Nested or unclosed tables (more opening tags than flat tables), or table tags that may sit in comments or
    scripts."""
    opens, flat = (F.regexp_count(text, F.lit(p)) for p in (r"(?i)<table\b", _TABLE))
    return text.rlike(r"(?i)<table\b") & ((opens != flat) | text.rlike(r"(?i)<(?:!--|script|style)"))


def _tokenized_tables(texts: Column) -> Column:
    """Arrow function over arrays of texts: ``TABLES`` of each (``table_tokenizer.tables_in``)."""

    @pandas_udf(f"array<{TABLES}>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda texts: None if texts is None else [None if t is None else tables_in(t) for t in texts])

    # the optimizer must not move the call into a lambda of a later projection, where it cannot run
    return run.asNondeterministic()(texts)


def found_tables(texts: Column) -> Column:
    """For an array of texts, every table of each, outer and inner ones both, as ``array<TABLES>``.

    This is the one table list that records, counts, cells and renderers share.  Only arrays with a text
    that needs the tokenizer leave the JVM.
    """
    hard = F.exists(texts, needs_tokenizer)
    return F.coalesce(_tokenized_tables(F.when(hard, texts)), F.transform(texts, flat_tables))


def text_tables(text: Column) -> Column:
    """``TABLES`` of one text."""
    return F.get(found_tables(F.array(text)), F.lit(0))


def html_tables(text: Column) -> Column:
    """Source of every table of a text, outer and inner ones both."""
    return text_tables(text)["html"]


def cell_text(cell: Column) -> Column:
    """Text of one cell: the pieces between tags, each stripped, joined without a gap."""
    bare = F.when(cell.contains("<"), F.regexp_replace(cell, java(r"\s*<[^>]*>\s*"), "")).otherwise(cell)
    return T.strip(T.html_unescape(bare))


def rows_of(table: Column) -> Column:
    """``array<array<string>>`` of the cell texts, header row included."""
    return F.transform(F.regexp_extract_all(table, F.lit(_ROW), F.lit(1)),
                       lambda r: F.transform(F.regexp_extract_all(r, F.lit(_CELL), F.lit(1)), cell_text))


def has_header(table: Column) -> Column:
    """Does the first row hold header cells."""
    return F.coalesce(F.regexp_extract(table, _ROW, 1).rlike(r"(?i)<th\b"), F.lit(False))


def csv_text(table: Column) -> Column:
    """CSV of one table; without header cells the columns are named 0, 1, …
    Short rows are filled up with empty values."""
    def build(rows: Column, width: Column) -> Column:
        lines = F.transform(rows, lambda r: F.array_join(F.transform(
            F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))), T.quote_csv), ","))
        numbers = F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: i.cast("string")), ",")
        body = F.when(has_header(table), lines).otherwise(F.concat(F.array(numbers), lines))
        return F.when(width > 0, F.concat(F.array_join(body, "\n"), F.lit("\n"))).otherwise("")

    return T.let(rows_of(table), lambda rows: T.let(
        F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)), lambda width: build(rows, width)))


def table_rows(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per table: keys, table_index (from 1), html, own."""
    return T.unnest(pages, keys, text_tables(F.col(text_col))).select(
        *keys, (F.col("_pos") + 1).alias("table_index"), "_item.html", "_item.own")


def cells(table_df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell of ``table_rows``: keys, row, col (from 0), is_header, text."""
    rows = T.unnest(table_df, keys, F.regexp_extract_all("own", F.lit(_ROW), F.lit(1)), "row")
    whole = F.regexp_extract_all("_item", F.lit(_CELL), F.lit(0))
    found = T.unnest(rows, [*keys, "row"], whole, "col")
    return found.select(*keys, "row", "col", F.col("_item").rlike(r"(?i)^<th\b").alias("is_header"),
                        cell_text(F.regexp_extract("_item", _CELL, 1)).alias("text"))


def table_line_items(table: Column) -> Column:
    """Line items of one table as ``array<struct<description, quantity, rate, amount, sku, category>>``.

    The first row names the columns; rows with another number of cells, and rows
    without a description, give nothing; unknown columns are ignored.
    """
    def role(head: Column) -> Column:
        return F.coalesce(*[F.when(head.isin(names), F.lit(r)) for r, names in C.LINE_ITEM_HEADERS.items()], F.lit(""))

    def columns(rows: Column) -> Column:
        """Cell number (from 1) of each known role; the last one if a role is named twice."""
        roles = F.transform(F.get(rows, F.lit(0)), lambda h: role(F.lower(h)))
        places = {r: F.array_max(F.transform(roles, lambda x, i: F.when(x == r, i + 1))) for r in C.LINE_ITEM_HEADERS}
        return F.struct(F.size(roles).alias("width"), *[c.alias(r) for r, c in places.items()])

    def item(row: Column, at: Column) -> Column:
        def cell(r: str) -> Column:
            return F.when(at[r].isNotNull(), F.get(row, at[r] - 1))

        return T.let(F.split(cell("description"), "\n"), lambda lines: T.let(
            F.get(lines, F.lit(1)), lambda extra: T.let(
                F.nullif(F.regexp_extract(extra, C.SKU_PATTERN, 1), F.lit("")), lambda sku: F.struct(
                    T.strip(F.get(lines, F.lit(0))).alias("description"), cell("quantity").alias("quantity"),
                    cell("rate").alias("rate"), cell("amount").alias("amount"), sku.alias("sku"),
                    F.nullif(T.strip(F.btrim(T.strip(F.replace(extra, sku, F.lit(""))), F.lit(","))), F.lit("")
                             ).alias("category")))))

    def items(rows: Column, at: Column) -> Column:
        body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
        matching = F.filter(body, lambda r: F.size(r) == at["width"])
        return F.filter(F.transform(matching, lambda r: item(r, at)),
                        lambda x: x["description"].isNotNull() & (x["description"] != ""))

    return T.let(rows_of(table), lambda rows: T.let(columns(rows), lambda at: items(rows, at)))


def line_items(table_arr: Column) -> Column:
    """Line items of all tables (own form) of a document, in table order."""
    return F.flatten(F.transform(table_arr, table_line_items))


def line_item_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line item of each document."""
    found = docs.select(id_col, text_tables(F.col(text_col)).alias("t"))
    return T.unnest(found, [id_col], line_items(F.col("t.own")), "item_index").select(id_col, "item_index", "_item.*")
