"""Tables as grids: row and column spans filled in, column types told from the cells, typed CSV.

A fold runs over a table's rows and carries the open row spans.  Within a row each cell goes to the first free place:
the places that spans from above hold come first, then the cell as often as its column span says.  Spans that are
still open after the last row give further rows.  The leading rows that hold only header cells are the header.

Types form a lattice, integer < decimal < text; a column has the least type that holds for all its cells below the
header.  Commas between digits are thousands marks.  An integer column with an empty cell is a decimal one (it has no
integer for it), an empty column too; numbers are written without marks, a plus sign and useless zeros.

``tables.rows_of`` and ``tables.csv_text`` stay the plain forms: no spans, no types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.tables import _CELL, _ROW, cell_text

#: Largest spans, as HTML sets them.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_INTEGER = r"^[+-]?\d[\d,]*$"
_DECIMAL = r"^[+-]?(\d[\d,]*\.?\d*|\.\d+)$"
_SPOTS = "array<struct<at: int, text: string, left: int>>"


def _span(tag: Column, name: str, most: int) -> Column:
    """Value of a span attribute of a cell's opening tag, 1 without one."""
    digits = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']?\s*(\d+)", 1)
    return F.when(F.length(tag) == len("<td>"), 1).otherwise(T.let(digits, lambda d: F.when(d == "", 1).otherwise(
        F.least(F.coalesce(d.try_cast("int"), F.lit(most)), F.lit(most)))))


def _spanned_cells(table: Column) -> Column:
    """``array<array<struct<text, cols, rows, head>>>`` of a table's own level."""
    def cell(c: Column) -> Column:
        return T.let(F.substring_index(c, ">", 1), lambda tag: T.let(F.concat(tag, F.lit(">")), lambda tag: F.struct(
            cell_text(F.regexp_extract(c, _CELL, 1)).alias("text"), _span(tag, "colspan", MOST_COLUMNS).alias("cols"),
            _span(tag, "rowspan", MOST_ROWS).alias("rows"), tag.rlike(r"(?i)^<th\b").alias("head"))))

    return F.transform(F.regexp_extract_all(table, F.lit(_ROW), F.lit(1)),
                       lambda r: F.transform(F.regexp_extract_all(r, F.lit(_CELL), F.lit(0)), cell))


def _spot(at: Column, text: Column, left: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), text.alias("text"), left.cast("int").alias("left"))


def _filled_row(cells: Column, opened: Column) -> Column:
    """One row's places with their column; ``left`` tells how many further rows a place reaches into."""
    def below(spans: Column) -> Column:
        return F.transform(spans, lambda o: _spot(o["at"], o["text"], o["left"] - 1))

    def put(state: Column, cell: Column) -> Column:
        begin = F.size(state["line"])
        due = F.filter(state["open"], lambda o, j: o["at"] <= begin + j)  # spans from above up to the first free place
        own = F.transform(F.array_repeat(cell, cell["cols"]), lambda c, k: _spot(begin + F.size(due) + k, c["text"], c["rows"] - 1))
        return F.struct(F.concat(state["line"], below(due), own).cast(_SPOTS).alias("line"),
                        F.slice(state["open"], F.size(due) + 1, F.size(state["open"])).cast(_SPOTS).alias("open"))

    start = F.struct(F.array().cast(_SPOTS).alias("line"), opened.cast(_SPOTS).alias("open"))
    return F.aggregate(cells, start, put, lambda s: F.concat(s["line"], below(s["open"])))


def _texts(spots: Column) -> Column:
    return F.transform(spots, lambda s: s["text"])


def _folded(rows: Column) -> Column:
    """``array<array<string>>``: rows of cells with their spans filled in."""
    def step(state: Column, cells: Column) -> Column:
        return T.let(_filled_row(cells, state["open"]), lambda spots: F.struct(
            F.concat(state["out"], F.array(_texts(spots))).alias("out"), F.filter(spots, lambda s: s["left"] > 0).cast(_SPOTS).alias("open")))

    def rest(state: Column) -> Column:
        further = F.coalesce(F.array_max(F.transform(state["open"], lambda o: o["left"])), F.lit(0))
        rows = F.transform(F.sequence(F.lit(1), further), lambda k: _texts(F.filter(state["open"], lambda o: o["left"] >= k)))
        return F.when(further > 0, F.concat(state["out"], rows)).otherwise(state["out"])

    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast(_SPOTS).alias("open"))
    return F.aggregate(rows, start, step, rest)


def grid(table: Column) -> Column:
    """``struct<header: array<array<string>>, body: array<array<string>>>`` of one table (own form); the header's spans
    end with it."""
    def build(rows: Column) -> Column:
        first = F.array_position(F.transform(rows, lambda r: (F.size(r) > 0) & F.forall(r, lambda c: c["head"])), F.lit(False))
        n_head = F.when(first == 0, F.size(rows)).otherwise((first - 1).cast("int"))
        return T.let(n_head, lambda n: F.struct(
            _folded(F.slice(rows, F.lit(1), n)).alias("header"),
            _folded(F.slice(rows, n + 1, F.size(rows))).alias("body")))

    return T.let(_spanned_cells(table), build)


def width(cells: Column) -> Column:
    """Columns of a grid."""
    return F.coalesce(F.array_max(F.transform(F.concat(cells["header"], cells["body"]), F.size)), F.lit(0))


def types(cells: Column) -> Column:
    """Type of each column of a grid: integer, decimal or text."""
    def type_of(c: Column) -> Column:
        own = F.transform(cells["body"], lambda r: F.coalesce(F.get(r, c), F.lit("")))
        filled = F.filter(own, lambda v: v != "")
        return T.let(filled, lambda f: F.when(F.exists(f, lambda v: ~v.rlike(_DECIMAL)), "text").when(
            F.exists(f, lambda v: ~v.rlike(_INTEGER)) | (F.size(f) < F.size(cells["body"])) | (F.size(f) == 0), "decimal").otherwise("integer"))

    return T.let(width(cells), lambda w: F.when(w > 0, F.transform(F.sequence(F.lit(0), w - 1), type_of)).otherwise(
        F.array().cast("array<string>")))


def typed_value(value: Column, kind: Column) -> Column:
    """A cell as its column's type writes it."""
    plain = F.regexp_replace(F.regexp_replace(value, "[,+]", ""), r"^(-?)0+(?=\d)", "$1")
    pointed = F.regexp_replace(F.when(plain.contains("."), plain).otherwise(F.concat(plain, F.lit(".0"))), r"^(-?)\.", "$10.")
    number = F.regexp_replace(F.regexp_replace(pointed, r"\.$", ".0"), r"(\.\d+?)0+$", "$1")
    return F.when((kind == "text") | (value == ""), value).when(kind == "integer", plain).otherwise(number)


def typed_csv(table: Column) -> Column:
    """CSV of one table (own form) with spans filled in and typed columns; a table without header cells names its
    columns 0, 1, …; short rows are filled up with empty values."""
    def line(row: Column, kinds: Column, header: bool) -> Column:
        def cell(kind: Column, c: Column) -> Column:
            value = F.coalesce(F.get(row, c), F.lit(""))
            return T.quote_csv(value if header else typed_value(value, kind))
        return F.array_join(F.transform(kinds, cell), ",")

    def build(cells: Column, kinds: Column) -> Column:
        numbers = F.array(F.array_join(F.transform(kinds, lambda _, i: i.cast("string")), ","))
        head = F.transform(cells["header"], lambda r: line(r, kinds, True))
        body = F.transform(cells["body"], lambda r: line(r, kinds, False))
        lines = F.concat(F.when(F.size(head) > 0, head).otherwise(numbers), body)
        return F.when(F.size(kinds) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")

    return T.let(grid(table), lambda cells: T.let(types(cells), lambda kinds: build(cells, kinds)))


def grid_cells(table_df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per place of the grids of ``tables.table_rows``: keys, row, col (from 0), is_header, type, text."""
    told = table_df.select(*keys, grid(F.col("own")).alias("g")).withColumn("kinds", types(F.col("g")))
    lined = F.concat(F.transform("g.header", lambda r: F.struct(r.alias("r"), F.lit(True).alias("head"))),
                     F.transform("g.body", lambda r: F.struct(r.alias("r"), F.lit(False).alias("head"))))
    rows = told.select(*keys, "kinds", F.posexplode(lined).alias("row", "line"))
    return rows.select(*keys, "row", F.col("line.head").alias("is_header"), "kinds", F.posexplode("line.r").alias("col", "text")).select(
        *keys, "row", "col", "is_header", F.get("kinds", F.col("col")).alias("type"), "text")
