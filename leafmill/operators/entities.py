"""Entities, context fields, question answering, summaries and key points by pattern."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import catalog as C
from leafmill.functions import text as T
from leafmill.functions.regex import STEADY, alternatives, needed_literals


def _needed(pattern: str) -> list[str]:
    """Substrings of which every match of an entity pattern holds one, from the pattern's last alternatives or its one
    fixed character; those that contain another one are left out."""
    arms = [a.replace("\\", "") for a in alternatives(pattern)[3:-1].split("|")] if alternatives(pattern) else []
    fixed = arms or [c for c in "@$" if c in pattern and "|" not in pattern]
    return [x for x in fixed if not any(y != x and y in x for y in fixed)]


#: Beginnings of patterns, and the same with one character or class in front of all that may follow.
_LEADS = {r"\b[A-Z]": r"[A-Z](?<!\w[A-Z])", r"\d{1,2}": r"\d\d?", r"\d{4}": r"\d\d{3}",
          r"\+?\d{1,3}": r"[+\d](?:(?<=\+)\d{1,3}|(?<=\d)\d{0,2})"}


def _linear(pattern: str) -> tuple[str | None, str]:
    """Spellings for ``re`` whose time does not grow with the runs of a text: the pattern at a place (None: not needed),
    and anywhere but inside a run.  Chains of capitalised words are taken whole, their company word is a group."""
    if pattern == C.ENTITY_PATTERNS["organization"][0]:
        ends = alternatives(pattern)
        return None, rf"[A-Z][a-z]+(?:\s+(?!{ends})[A-Z][a-z]+)*+(\s+{ends})?+"
    run = STEADY.get(pattern, "").removeprefix(r"(?:\G|")
    if not run:  # a first character by itself is what a search can skip to
        for lead, quick in _LEADS.items():
            if pattern.startswith(lead):
                return None, quick + pattern.removeprefix(lead)
        return None, pattern
    behind = run[:run.index("))") + 1]
    return run[len(behind) + 1:], behind + run[len(behind) + 1:]


def _always_tried(pattern: str) -> bool:
    """Does a pattern say nothing about its matches before it is run; without a text its matches are unknown, not none."""
    _, group, tail = pattern.rpartition(alternatives(pattern) or "\0")
    return not _needed(pattern) and not (group and tail.startswith(r"\s+\d")) and pattern.count("?") <= 2


def entity_array(text: Column, types: list[str] | None = None) -> Column:
    """Entities in emission order (type by type, pattern by pattern) as ``array<struct<type, pattern_no, value>>``; the
    same value may occur under several patterns.

    One Arrow call; a pattern runs where a literal it needs occurs, in a spelling whose time does not grow with runs."""
    kinds = {k: ps for k, ps in C.ENTITY_PATTERNS.items() if types is None or k in types}
    spelled = [(k, no, *_linear(p), _needed(p)) for k, ps in kinds.items() for no, p in enumerate(ps)]
    labels, parts = frozenset(C.PERSON_LABELS), tuple(C.PERSON_STOP_PARTS)
    unknown = any(_always_tried(p) for ps in kinds.values() for p in ps)
    street = alternatives(C.ENTITY_PATTERNS["address"][0])

    @F.arrow_udf("array<struct<type:string,pattern_no:int,value:string>>")
    def find(texts: pa.Array) -> pa.Array:
        tests = [(k, no, re.compile(there).match if there else None, re.compile(p), needs) for k, no, there, p, needs in spelled]
        # an address: a number with the whole chain of capitalised words behind it, cut after the last street word
        chains = re.compile(r"\d(?<!\d\d)\d*+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)++").findall
        cut = re.compile(rf"\d+\s+[A-Z][a-z]+(?=\s).*(?<=\s){street}", re.S).match

        def found(text: str, there, anywhere: re.Pattern) -> list[str]:
            """All matches; one that begins inside a run counts only right behind the match before."""
            if there is None:
                return anywhere.findall(text)
            out, at = [], 0
            while match := there(text, at) or anywhere.search(text, at):
                out.append(match.group())
                at = match.end()
            return out

        def kept(value: str) -> bool:
            low = value.lower()
            return low not in labels and not any(p in low for p in parts)

        names, numbers, values, ends, missing = [], [], [], [0], []
        for text in texts.to_pylist():
            missing.append(text is None and unknown)
            for kind, no, there, anywhere, needs in tests if text is not None else ():
                if needs and not any(w in text for w in needs):
                    continue
                if kind == "address":
                    some = [m.group() for c in chains(text) if (m := cut(c))]
                elif anywhere.groups:
                    some = [m.group() for m in anywhere.finditer(text) if m.group(1)]
                else:
                    some = found(text, there, anywhere)
                if kind == "person":
                    some = [v for v in some if kept(v)]
                names += [kind] * len(some)
                numbers += [no] * len(some)
                values += some
            ends.append(len(values))
        rows = pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(values, pa.string())], ["type", "pattern_no", "value"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=pa.array(missing, pa.bool_()))

    # the optimizer must not move the call into a lambda of a later projection, where it cannot run
    return find.asNondeterministic()(text)


def _count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda e: e["type"] == kind))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None,
             types: list[str] | None = None) -> DataFrame:
    """One row per entity: id, ord, type, pattern_no, value, confidence; ``limit`` keeps the
    first n of each document by emission order."""
    found = entity_array(F.col(text_col), types)
    if limit is not None:
        found = F.slice(found, 1, limit)
    rows = T.unnest(docs, [id_col], found, "ord")
    return rows.select(id_col, "ord", "_item.type", "_item.pattern_no", "_item.value",
                       F.lit(C.ENTITY_CONFIDENCE).alias("confidence"))


def top_entities(entity_rows: DataFrame, k: int) -> DataFrame:
    """Most frequent values over the corpus, ties by type and value."""
    counts = entity_rows.groupBy("type", "value").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "type", "value").limit(k)


_TRIGGERS = list(dict.fromkeys(t for triggers, _ in C.CONTEXT_RULES.values() for t in triggers))


_CONTEXT_LITERALS = _TRIGGERS + [w for _, fields in C.CONTEXT_RULES.values() for p in fields.values()
                                 for w in needed_literals(p)]


def _context_hits(text: Column, hits: Column) -> Column:
    """``array<struct<context, field, value>>`` of the fields found."""
    catalogue = T.constant(
        [{"context": context, "triggers": triggers, "field": field, "rules": T.rule_list([pattern], ignore_case=True)}
         for context, (triggers, fields) in C.CONTEXT_RULES.items() for field, pattern in fields.items()],
        f"array<struct<context:string,triggers:array<string>,field:string,rules:{T.RULES}>>")
    open_rules = F.filter(catalogue, lambda c: F.arrays_overlap(hits, c["triggers"]))
    return F.filter(F.transform(open_rules, lambda c: F.struct(
        c["context"], c["field"], T.strip(T.rule_value(text, hits, c["rules"])).alias("value"))),
        lambda h: h["value"].isNotNull())


def _with_triggers(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, text_col, T.literal_hits(T.fold_labels(F.col(text_col)), _CONTEXT_LITERALS).alias("_triggers"))


def context_fields(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fields looked for only where a trigger word of their context occurs."""
    base = _with_triggers(docs, id_col, text_col)
    rows = T.unnest(base, [id_col], _context_hits(F.col(text_col), F.col("_triggers")))
    return rows.select(id_col, "_item.*", F.lit(C.CONTEXT_CONFIDENCE).alias("confidence"))


def answer(text: Column, question: str) -> Column:
    """``struct<field, value>`` for the first question word of the question whose pattern
    matches, else NULL.  The question is known on the driver, so only its words are compiled."""
    asked = question.lower()
    tries = []
    for word, pattern in C.QUESTION_PATTERNS.items():
        if word in asked:
            value = T.first_match(text, pattern, ignore_case=True)
            tries.append(F.when(value.isNotNull(), F.struct(F.lit(word).alias("field"), T.strip(value).alias("value"))))
    return F.coalesce(*tries) if tries else F.lit(None).cast("struct<field:string,value:string>")


def answer_questions(docs: DataFrame, questions: list[str], id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per document and answered question.  Questions are literals: no join."""
    found = F.array(*[F.struct(F.lit(i).alias("question_no"), F.lit(q).alias("question"),
                               answer(F.col(text_col), q).alias("a")) for i, q in enumerate(questions)])
    rows = T.unnest(docs, [id_col], F.filter(found, lambda x: x["a"].isNotNull()))
    return rows.select(id_col, "_item.question_no", "_item.question", "_item.a.field", "_item.a.value",
                       F.lit(C.QUESTION_CONFIDENCE).alias("confidence"))


def semantic_fields(docs: DataFrame, questions: list[str], id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Context fields, overridden by answers that carry the same field name (last question wins)."""
    base = _with_triggers(docs, id_col, text_col)
    text = F.col(text_col)
    answers = F.filter(F.array(*[answer(text, q) for q in questions]), lambda a: a.isNotNull())
    both = base.select(id_col, _context_hits(text, F.col("_triggers")).alias("c"), answers.alias("a"))
    answered = F.transform("a", lambda x: x["field"])
    kept = F.transform(
        F.filter("c", lambda h: ~F.array_contains(answered, h["field"])),
        lambda h: F.struct(h["field"], h["value"], F.lit(C.CONTEXT_CONFIDENCE).alias("confidence"),
                           h["context"].alias("context")))
    last = F.filter("a", lambda x, i: ~F.exists(
        F.slice("a", i + 2, F.greatest(F.size("a") - i - 1, F.lit(0))), lambda y: y["field"] == x["field"]))
    asked = F.transform(last, lambda x: F.struct(
        x["field"], x["value"], F.lit(C.QUESTION_CONFIDENCE).alias("confidence"), F.lit("query").alias("context")))
    return T.unnest(both, [id_col], F.concat(kept, asked)).select(id_col, "_item.*")


def described_fields(docs: DataFrame, schema: dict[str, dict], id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Values of named fields, found by reading each field's description as a question."""
    text = F.col(text_col)
    found = [F.struct(F.lit(name).alias("field"), answer(text, spec["description"])["value"].alias("value"))
             for name, spec in schema.items() if spec.get("description")]
    rows = T.unnest(docs, [id_col], F.filter(F.array(*found), lambda x: x["value"].isNotNull()))
    return rows.select(id_col, "_item.*", F.lit(C.QUESTION_CONFIDENCE).alias("confidence"))


def summary(text: Column, found: Column) -> Column:
    """One sentence of entity counts, or the word count when there are none of the four kinds."""
    parts = []
    for kind, label in C.SUMMARY_PARTS:
        n = _count_of(found, kind)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {label}"))))
    listed = F.concat_ws(", ", *parts)
    return F.when(listed != "", F.concat(F.lit("Document contains: "), listed, F.lit("."))).otherwise(
        F.concat(F.lit("Document with "), _word_count(text).cast("string"), F.lit(" words.")))


def _word_count(text: Column) -> Column:
    from leafmill.operators.pages import text_statistics
    return text_statistics(text)["n_words"]


def summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Summary sentence over all entities of a document (before any limit)."""
    kinds = [k for k, _ in C.SUMMARY_PARTS]
    found = docs.select(id_col, text_col, entity_array(F.col(text_col), kinds).alias("_found"))
    return found.select(id_col, summary(F.col(text_col), F.col("_found")).alias("summary"))


def key_points(text: Column) -> Column:
    """First 5 bullets, then the first 2 hits of each "important" pattern, at most 10.
    A bullet consumes the newline behind it, so of directly adjacent bullets every second counts."""
    parts = [F.slice(T.find_all(text, C.BULLET_PATTERN), 1, 5)]
    parts += [F.slice(T.find_all(text, p, ignore_case=True), 1, 2) for p in C.IMPORTANT_PATTERNS]
    return F.slice(F.concat(*parts), 1, 10)
