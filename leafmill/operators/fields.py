"""Label-value fields, type-conditional fields and the structured record."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import catalog as C
from leafmill.functions import text as T
from leafmill.functions.regex import WHITESPACE, folded, needed_literals
from leafmill.operators import classify, entities, language, pages, tables

# --- labelled fields -------------------------------------------------------------------


def field_names(enabled: list[str] | None = None, extra: list[str] = ()) -> list[str]:
    """Chosen predefined fields plus extra ones (stripped, empty ones dropped, each once)."""
    names = list(C.LABEL_FIELDS if enabled is None else enabled)
    return list(dict.fromkeys(names + [f.strip() for f in extra if f.strip()]))


def _spellings(name: str) -> list[str]:
    return list(dict.fromkeys([name, name.replace(" ", "")]))


def label_confidence(name: str) -> float:
    """Fixed per field name: 0.85 plus a 0-14 hundredths offset from the md5 of the name."""
    return min(1.0, 0.85 + int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % 15 / 100)


def label_literals(names: list[str]) -> list[str]:
    """Lower-case label spellings to look for."""
    return list(dict.fromkeys(w for n in names for sp in _spellings(n) for w in needed_literals(re.escape(sp).replace(r"\ ", " "))))


def label_array(text: Column, hits: Column, names: list[str]) -> Column:
    """``array<struct<field, value, confidence, found>>``: the text behind each label
    (``label[\\s:]+rest of line``, any case, with and without the blanks inside the label);
    '' when missing.  ``hits`` holds the labels that occur at all."""
    def rules(name: str) -> list[dict]:
        return T.rule_list([re.escape(sp).replace(r"\ ", " ") + r"[\s:]+([^\n]+)" for sp in _spellings(name)],
                           ignore_case=True)

    catalogue = T.constant([{"field": n, "rules": rules(n), "full": label_confidence(n)} for n in names],
                           f"array<struct<field:string,rules:{T.RULES},full:double>>")
    values = F.transform(catalogue, lambda c: F.struct(
        c["field"], F.coalesce(T.strip(T.rule_value(text, hits, c["rules"])), F.lit("")).alias("value"), c["full"]))
    return F.transform(values, lambda x: F.struct(
        x["field"], x["value"], F.when(x["value"] != "", x["full"]).otherwise(0.0).alias("confidence"),
        (x["value"] != "").alias("found")))


def with_label_fields(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      enabled: list[str] | None = None, extra: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Documents with ``fields`` = array<struct<field, value, confidence, found>>."""
    names = field_names(enabled, extra)
    scanned = docs.select(id_col, *keep, F.col(text_col).alias("_text"),
                          T.literal_hits(T.fold_labels(F.col(text_col)), label_literals(names)).alias("_hits"))
    return scanned.select(id_col, *keep, label_array(F.col("_text"), F.col("_hits"), names).alias("fields"))


def label_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", enabled: list[str] | None = None,
               extra: list[str] = (), min_confidence: float | None = None) -> DataFrame:
    """One row per document and field; ``min_confidence`` drops rows below it."""
    wide = with_label_fields(docs, id_col, text_col, enabled, extra)
    rows = T.unnest(wide, [id_col], F.col("fields")).select(id_col, "_item.*")
    return rows if min_confidence is None else rows.filter(F.col("confidence") >= min_confidence)


def label_statistics(wide: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and success rate per document, computed inside its row."""
    found = F.size(F.filter("fields", lambda f: f["found"]))
    total = F.size("fields")
    rate = F.when(total > 0, F.bround(found / total * 100, 1)).otherwise(0.0)
    return wide.select(id_col, total.cast("bigint").alias("total_fields"), found.cast("bigint").alias("fields_found"),
                       (total - found).cast("bigint").alias("fields_empty"), rate.alias("success_rate"))


def value_map(fields: Column) -> Column:
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(f["field"], f["value"])))


def confidence_map(fields: Column) -> Column:
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(f["field"], f["confidence"])))


def fill_rates(rows: DataFrame) -> DataFrame:
    """Share of documents in which each field was found."""
    return rows.groupBy("field").agg(F.count("*").alias("n_docs"), F.count_if("found").alias("n_found"))


def fill_rates_by_type(rows: DataFrame, type_col: str = "document_type") -> DataFrame:
    """Fill rates per type and field, per type, and over all, in one pass (``level`` 0, 1 and 3: which of type and
    field are summed over)."""
    return rows.rollup(type_col, "field").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_values"), F.count_if("found").alias("n_found"),
        F.bround(F.count_if("found") / F.count("*") * 100, 1).alias("fill_rate"))


# --- structured fields -------------------------------------------------------------------


def clean(value: Column) -> Column:
    """Strip blanks, then asterisks, then blanks."""
    return T.strip(F.btrim(T.strip(value), F.lit("*")))


FIELDS = "array<struct<field:string,value:string>>"


def _field_rules(fields: dict[str, list[str]]) -> list[tuple[str, list[tuple]]]:
    return [(n, [(folded(p), folded(p, dotted=True), tuple(needed_literals(p))) for p in ps]) for n, ps in fields.items()]


def structured_array(text: Column, doc_type: Column) -> Column:
    """Common fields plus the fields of the document's type, as ``array<struct<field, value>>``.

    One Arrow call: a field's rules run, each where a literal it needs occurs, until one matches.  They search the text in
    lower case; the value is cut out of the text itself."""
    common = _field_rules(C.COMMON_FIELDS)
    by_type = {kind: _field_rules(fields) for kind, fields in C.TYPE_FIELDS.items()}
    folding, blanks = T.folding, WHITESPACE

    @F.arrow_udf(FIELDS)
    def find(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        fold = folding()

        def ready(rules: list) -> list:
            return [(n, [(re.compile(p, re.M).search, re.compile(dotted, re.M).search, needs) for p, dotted, needs in ps]) for n, ps in rules]

        def first(low: str, kept: str, rules: list) -> tuple[int, int]:
            for search, search_dotted, needs in rules:
                if not needs or any(w in low for w in needs):
                    if match := search(low) if kept is low else search_dotted(kept):
                        return match.span(1)
            return 0, 0

        shared, own = ready(common), {kind: ready(rules) for kind, rules in by_type.items()}
        names, values, ends = [], [], [0]
        for text, kind in zip(texts.to_pylist(), kinds.to_pylist(), strict=True):
            if text is not None:
                low = fold(text)
                kept = "İ".join(map(fold, text.split("İ"))) if not text.isascii() and "İ" in text else low
                for name, rules in shared:  # an empty match is no value; a common field that is only blank stays as ''
                    begin, end = first(low, kept, rules)
                    if begin < end:
                        names.append(name)
                        values.append(text[begin:end].strip(blanks))
                for name, rules in own.get(kind, ()):
                    begin, end = first(low, kept, rules)
                    if value := text[begin:end].strip(blanks).strip("*").strip(blanks):
                        names.append(name)
                        values.append(value)
            ends.append(len(names))
        rows = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["field", "value"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    # the optimizer must not move the call into a lambda of a later projection, where it cannot run
    return find.asNondeterministic()(text, doc_type)


def _with_type(typed: DataFrame) -> DataFrame:
    """``typed`` with its document type evaluated: a call that is handed the whole verdict is not planned."""
    return T.bound(typed, document_type=F.col("document_type"))


def structured_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Document type and one row per structured field."""
    src = docs.select(id_col, F.col(text_col).alias("_t"))
    typed = _with_type(classify.classify(src, id_col, "_t", ["_t"]).select(id_col, "_t", "document_type"))
    found = typed.select(id_col, "document_type", structured_array(F.col("_t"), F.col("document_type")).alias("fs"))
    return T.unnest(found, [id_col, "document_type"], F.col("fs")).select(id_col, "document_type", "_item.*")


def nested(fields: Column) -> Column:
    """Fields as a map whose values are one-entry maps for nested fields, plain otherwise:
    ``map<field, map<key, value>>`` with key '' for a plain value."""
    def key(name: Column) -> Column:
        out = F.lit("")
        for field, inner in C.NESTED_FIELDS.items():
            out = F.when(name == field, inner).otherwise(out)
        return out

    return F.map_from_entries(F.transform(fields, lambda f: F.struct(
        f["field"], F.create_map(key(f["field"]), f["value"]))))


def structured_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       keep: list[str] = (), entity_limit: int | None = None) -> DataFrame:
    """The full record of each document: type, confidence, language, fields, line items, entities, pages.

    One pass over the text without a join or shuffle; outputs that are not selected
    later are pruned together with the scans behind them.  A record holds every entity of its document;
    ``entity_limit`` keeps the first n by emission order.
    """
    found = entities.entity_array(F.col("_t"))
    if entity_limit is not None:
        found = F.slice(found, 1, entity_limit)
    src = docs.select(id_col, *keep, F.col(text_col).alias("_t"))
    typed = _with_type(classify.classify(src, id_col, "_t", [*keep, "_t"]).select(
        id_col, *keep, "_t", "document_type", F.bround("confidence", 2).alias("confidence")))
    spoken = language.detect(typed, id_col, "_t", [*keep, "_t", "document_type", "confidence"])
    text = F.col("_t")
    spoken = pages.with_tables(spoken, text).withColumn("_all", tables.text_tables(text))
    return spoken.select(
        id_col, *keep, "document_type", "confidence", "language",
        structured_array(text, F.col("document_type")).alias("extracted_fields"),
        F.col("_all.html").alias("tables_html"),
        F.transform(found, lambda e: F.struct(
            e["type"], e["value"], F.lit(C.ENTITY_CONFIDENCE).alias("confidence"))).alias("entities"),
        pages.parsed_array().alias("pages"), tables.line_items(F.col("_all.own")).alias("line_items"))


# --- money ------------------------------------------------------------------------------


def money(value: Column) -> Column:
    """``$1,234.56`` to DECIMAL(18,2); NULL when it is not an amount."""
    return F.regexp_replace(value, "[$€£¥,\\s]", "").try_cast("decimal(18,2)")


def reconcile(records: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sum of line amounts against the stated total, inside each record."""
    zero = F.lit(0).cast("decimal(38,2)")
    amounts = F.transform("line_items", lambda i: F.coalesce(money(i["amount"]), F.lit(0).cast("decimal(18,2)")))
    stated = F.get(F.filter("extracted_fields", lambda f: f["field"] == "total"), F.lit(0))["value"]
    return records.select(
        id_col, F.size("line_items").cast("bigint").alias("n_items"),
        F.aggregate(amounts, zero, lambda a, x: (a + x).cast("decimal(38,2)")).alias("items_total"),
        money(stated).alias("stated_total")).withColumn(
        "difference", F.abs(F.col("items_total") - F.col("stated_total")))
