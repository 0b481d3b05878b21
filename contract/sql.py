"""Pieces of oracle SQL (DuckDB dialect)."""

from __future__ import annotations

from leafmill.functions import catalog as C
from leafmill.functions.regex import WHITESPACE, re2


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {q(WHITESPACE)})"


def pattern(p: str, **flags) -> str:
    return q(re2(p, **flags))


def find_all(expr: str, p: str, group: int = 1, **flags) -> str:
    return f"regexp_extract_all({expr}, {pattern(p, **flags)}, {group})"


def matches(expr: str, p: str, **flags) -> str:
    return f"regexp_matches({expr}, {pattern(p, **flags)})"


def first(expr: str, p: str, group: int = 1, **flags) -> str:
    """Group of the first match, NULL without one."""
    return f"(case when {matches(expr, p, **flags)} then regexp_extract({expr}, {pattern(p, **flags)}, {group}) end)"


def non_blank(expr: str) -> str:
    return f"list_filter(list_transform({expr}, lambda x: {strip('x')}), lambda x: x <> '')"


# letters and digits beyond ASCII become '_', which makes the ASCII-only \b right

def ascii_words(expr: str) -> str:
    return f"regexp_replace({expr}, '[^\\x00-\\x7F\\p{{M}}\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}]', '_', 'g')"


PAGES_CTE = f"""
    pieces as (select doc_id, generate_subscripts(p, 1) as i, unnest(p) as raw
               from (select doc_id, string_split_regex(text, {q(re2(chr(92) + 'n--- Page ' + chr(92) + 'd+ ---' + chr(92) + 'n'))}) as p from src)),
    pages_of as (select doc_id, row_number() over (partition by doc_id order by i) as page_number, {strip('raw')} as text
                 from pieces where {strip('raw')} <> '')"""


def type_scores_sql(src: str) -> str:
    """CTEs ``low`` and ``scored`` with one score column per document type."""
    cols = []
    for name, (weight, keywords, patterns) in C.DOCUMENT_RULES.items():
        hits = [f"contains(t, {q(k)})::int" for k in keywords] + [f"2 * {matches('t', p)}::int" for p in patterns]
        cols.append(f"(({' + '.join(hits)})::double * {weight}::double / {float(len(keywords) + 2 * len(patterns))}::double) as {name}")
    return f"low as (select doc_id, lower(text) as t from {src}), scored as (select doc_id, t, {', '.join(cols)} from low)"


def best_type_sql() -> str:
    names = list(C.DOCUMENT_RULES)
    arms = " ".join(f"when {n} = top then '{n}'" for n in names)
    return (f"best as (select *, case when top < {C.MIN_TYPE_SCORE} then 'unknown' {arms} end as document_type, "
            f"case when top < {C.MIN_TYPE_SCORE} then 0.0::double else least(top * 2.0::double, 1.0::double) end as confidence "
            f"from (select *, greatest({', '.join(names)}) as top from scored))")
