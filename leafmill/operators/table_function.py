"""``extract_tables(text)`` as an SQL table function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from leafmill.operators.table_tokenizer import tables_in

_ROW = re.compile(r"<tr>(.*?)</tr>", re.DOTALL)
_CELL = re.compile(r"<(t[hd])\b[^>]*>(.*?)</t[hd]>", re.DOTALL)
_TAG = re.compile(r"\s*<[^>]*>\s*")
_PLAIN_TABLE = re.compile(r"<table>.*?</table>", re.DOTALL)
#: Text whose tables are spelled out plainly (closed rows of closed cells without tags or references inside) and whose
#: other tags have no attributes and no raw content: patterns find in it what the tokenizer finds.
_PLAIN = re.compile(r"(?:[^<]++|<table>\s*+(?:<tr>(?:<td>[^<&]*+</td>|<th>[^<&]*+</th>)*+</tr>\s*+)*+</table>|"
                    r"</?+(?!(?:table|tr|td|th|script|style|title|textarea|xmp|iframe|noembed|noframes|noscript|plaintext)\b)"
                    r"[a-z][a-z0-9_]*+>)*+")


def _own_tables(text: str) -> list[str]:
    """Own form of every table of a text; only text that is not plain needs the tokenizer."""
    if _PLAIN.fullmatch(text):
        return _PLAIN_TABLE.findall(text)
    return [table["own"] for table in tables_in(text)]


@udtf(returnType="table_index int, row int, col int, is_header boolean, text string", useArrow=True)
class ExtractTables:
    """One row per cell of every table of a text, inner tables included; tables from 1, rows and columns from 0."""

    def eval(self, text: str | None) -> Iterator[tuple[int, int, int, bool, str]]:
        for number, table in enumerate(_own_tables(text or ""), 1):
            for r, row in enumerate(_ROW.findall(table)):
                for c, (tag, cell) in enumerate(_CELL.findall(row)):
                    yield number, r, c, tag == "th", unescape(_TAG.sub("", cell)).strip()


def register(spark: SparkSession) -> None:
    """Make it known to SQL: ``select d.id, t.* from docs d, lateral extract_tables(d.text) t``."""
    spark.udtf.register("extract_tables", ExtractTables)
