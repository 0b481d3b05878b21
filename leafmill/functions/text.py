"""Text column helpers built on native Spark expressions."""

from __future__ import annotations

import json
import re
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from leafmill.functions.regex import WHITESPACE, WORD, java, needed_literals


def strip(col: Column) -> Column:
    """Remove white space (all Unicode kinds) at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def unnest(df: DataFrame, keep: list[str], items: Column, pos: str = "_pos") -> DataFrame:
    """One row per array item: kept columns, ``pos`` (from 0), ``_item``.

    The outer form plus a test on the position: a plain explode makes the optimizer derive a
    non-empty filter below it, which evaluates the whole array expression a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(pos, "_item"))
    return rows.filter(F.col(pos).isNotNull())


def bound(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with further columns that are evaluated once per row, whatever reads or filters them later.

    Each is the one item of an outer explode, below which the optimizer moves no test on it; a plain projection would
    be copied into every filter that reads the column, with all that it is made of.
    """
    for name, value in values.items():
        df = df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))
    return df


def find_all(col: Column, pattern: str, group: int = 1, **flags) -> Column:
    """All non-overlapping matches of one group, as an array."""
    return F.regexp_extract_all(col, F.lit(java(pattern, **flags)), F.lit(group))


def matches(col: Column, pattern: str, **flags) -> Column:
    return col.rlike(java(pattern, **flags))


def strings(items) -> Column:
    """Constant array of strings (folded to one literal; a single call to the JVM per list)."""
    return F.split(F.lit("\x01".join(items)), "\x01")


def constant(value, ddl: str) -> Column:
    """Constant of any nested type, handed over as JSON and folded to one literal."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``, however often that refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def message(template: str, **values: object) -> Column:
    """A fixed text with its ``{places}`` filled by columns or plain values."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [F.lit(p) if i % 2 == 0 else values[p] if isinstance(values[p], Column) else F.lit(str(values[p])) for i, p in enumerate(pieces)]
    return F.concat(*parts)


def first_match(col: Column, pattern: str, group: int = 1, **flags) -> Column:
    """Group of the first match; NULL without a match (an empty group is a match)."""
    spelled = java(pattern, **flags)
    return F.when(col.rlike(spelled), F.regexp_extract(col, spelled, group))


def literal_hits(col: Column, literals: list[str]) -> Column:
    """Which of many literals occur as substrings: an Arrow function that reads each text once,
    whatever the number of literals (one native substring test per literal reads it every time
    and measured several times slower beyond a dozen literals).

    The function carries all it needs, so executors do not have to import this package.
    """
    finder = literal_finder(literals)

    @pandas_udf("array<string>")
    def hits(texts: pd.Series) -> pd.Series:
        found = finder()
        return texts.map(lambda t: [] if t is None else list(found(t)))

    return hits(col)


def literal_finder(literals: list[str]):
    """Maker of a function from a text to the set of the literals in it, to be called by a worker."""
    wanted = tuple(dict.fromkeys(literals))

    def make():
        try:
            import ahocorasick
        except ImportError:
            return lambda text: {w for w in wanted if w in text}
        machine = ahocorasick.Automaton()
        for word in wanted:
            machine.add_word(word, word)
        machine.make_automaton()
        return lambda text: {word for _, word in machine.iter(text)}

    return make


def folding():
    """``fold_labels`` for a Python text, with a character for each of its characters, so that places stay the same."""
    letters = str.maketrans("ſıİK", "siik")

    def fold(text: str) -> str:
        if not text.isascii() and any(c in text for c in "ſıİK"):
            text = text.translate(letters)
        return text.lower()

    return fold


def gate(hits: Column, pattern: str) -> Column | None:
    """Can the pattern match at all, judged by the literals known to occur (None: always try)."""
    literals = needed_literals(pattern)
    return F.arrays_overlap(hits, strings(literals)) if literals else None


def gated_match(col: Column, hits: Column, pattern: str, **flags) -> Column:
    """``rlike`` behind ``gate``."""
    test, possible = matches(col, pattern, **flags), gate(hits, pattern)
    return test if possible is None else possible & test


RULES = "array<struct<re:string,needs:array<string>>>"


def rule_list(patterns: list[str], **flags) -> list[dict]:
    """Patterns as data for ``constant(…, RULES)``: spelled regex and needed literals.

    Large rule sets are kept as one literal inside the plan and run by higher-order functions.
    That keeps plans small; a regex of such a rule is compiled when used, which the literal gate
    limits to the few rules that can match a row.
    """
    return [{"re": java(p, **flags), "needs": needed_literals(p)} for p in patterns]


def rule_hits(text: Column, hits: Column, rules: Column) -> Column:
    """Rules of a ``rule_list`` that match, in order."""
    return F.filter(rules, lambda r: ((F.size(r["needs"]) == 0) | F.arrays_overlap(hits, r["needs"]))
                    & F.rlike(text, r["re"]))


def rule_value(text: Column, hits: Column, rules: Column) -> Column:
    """First group of the first rule that matches, NULL without one."""
    return let(F.get(rule_hits(text, hits, rules), F.lit(0)),
               lambda r: F.call_function("regexp_extract", text, r["re"], F.lit(1)))


def words(col: Column) -> Column:
    """Runs of word characters (no empty items)."""
    return F.filter(F.split(col, f"[^{WORD}]+"), lambda w: w != "")


def non_blank(arr: Column) -> Column:
    """Strip every item and drop the empty ones."""
    return F.filter(F.transform(arr, strip), lambda x: x != "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def count_chars(col: Column, chars: str) -> Column:
    """How many characters of ``col`` are in ``chars``."""
    return total([F.length(col) - F.length(F.replace(col, F.lit(c), F.lit(""))) for c in chars])


def fold_labels(col: Column) -> Column:
    """Lower case plus the letters that equal ASCII letters under case-insensitive matching."""
    return F.lower(F.when(col.rlike("[ſıİK]"), F.translate(col, "ſıİK", "siik")).otherwise(col))


def quote_csv(col: Column) -> Column:
    """Minimal CSV quoting."""
    return F.when(any_of([col.contains(c) for c in '",\r\n']), F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))
                  ).otherwise(col)


#: A character reference: decimal, hexadecimal, or a name; the names of old may lack the semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"


def _numbered_character(number: Column) -> Column:
    """Character of a numeric reference by the HTML standard: bytes 128 to 159 mean their Windows characters,
    impossible numbers the replacement character, and control or non-characters nothing."""
    windows = bytes(range(128, 160)).decode("cp1252", "replace")
    windows = "".join(chr(128 + i) if c == "\ufffd" else c for i, c in enumerate(windows))
    plane = F.pmod(number, F.lit(65536))
    nothing = (number.between(1, 8) | number.between(14, 31) | (number == 11) | (number == 127)
               | number.between(0xFDD0, 0xFDEF) | (plane >= 0xFFFE))
    encoded = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd").when(
        number.between(128, 159), F.substring(F.lit(windows), (number - 127).cast("int"), F.lit(1))).when(
        nothing, "").otherwise(encoded)


def html_unescape(col: Column) -> Column:
    """Decode all character references in one pass, so that what a reference yields is not decoded again."""
    names = constant({name: char for name, char in html5.items()}, "map<string,string>")
    old = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"

    def named(name: Column) -> Column:
        start = F.regexp_extract(name, old, 0)
        return F.coalesce(F.try_element_at(names, name), F.concat(
            F.try_element_at(names, start), F.substring(name, F.length(start) + 1, F.length(name))), F.concat(F.lit("&"), name))

    def decoded(ref: Column) -> Column:
        decimal = F.regexp_extract(ref, "^&#([0-9]+)", 1).try_cast("bigint")
        digits = F.ltrim(F.regexp_extract(ref, "^&#[xX]([0-9a-fA-F]+)", 1), F.lit("0"))
        hexadecimal = F.when(F.length(digits) <= 8, F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("bigint"))
        return F.when(ref.rlike("^&#[xX]"), _numbered_character(hexadecimal)).when(
            ref.startswith("&#"), _numbered_character(decimal)).otherwise(named(F.substring(ref, F.lit(2), F.length(ref))))

    refs = F.regexp_extract_all(col, F.lit(REFERENCE), F.lit(0))
    whole = let(refs, lambda found: F.array_join(F.transform(F.split(col, REFERENCE), lambda piece, i: F.concat(
        piece, F.coalesce(decoded(F.get(found, i)), F.lit("")))), ""))
    return F.when(col.contains("&"), whole).otherwise(col)
