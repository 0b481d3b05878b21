"""Extraction and validation driven by a JSON-schema dictionary.

The schema is compiled on the driver into a list of rules per field, tried in ladder
order.  A rule's regex runs only where the words it needs occur in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import catalog as C
from leafmill.functions import text as T
from leafmill.functions.regex import java, needed_literals

RESULT = "struct<field:string,value:string,confidence:double,valid:boolean,errors:array<string>>"


def ladder(name: str, spec: dict) -> list[tuple[str, float, int]]:
    """Ordered (pattern, confidence, group) attempts for one field."""
    kind = C.SCHEMA_TYPES.get(spec.get("type", "string"), C.OTHER_SCHEMA_TYPE)
    rungs = []
    if spec.get("pattern"):
        rungs.append((spec["pattern"], C.CUSTOM_WEIGHT, 1 if "(" in spec["pattern"].replace("(?:", "") else 0))
    spellings = [name.replace("_", " "), name.replace("_", ""), name] + spec.get("description", "").split()[:3]
    for spelling in spellings:
        for place, weight in ((C.SAME_LINE, C.SAME_LINE_WEIGHT), (C.NEXT_LINE, C.NEXT_LINE_WEIGHT)):
            rungs.append((place.replace("{spelling}", spelling).replace("{kind}", kind), weight, 1))
    rungs.append((f"({kind})", C.BARE_WEIGHT, 1))
    # a rung repeated later can only fail again, but it repeats its error: duplicates are kept
    return rungs


def cast_value(raw: Column, spec: dict) -> Column:
    """Text form of the converted value, NULL when it does not fit the type."""
    kind = spec.get("type", "string")
    if kind == "integer":
        return F.regexp_replace(raw, r"[^\p{Nd}-]", "").try_cast("decimal(38,0)").cast("string")
    if kind == "number":
        return F.regexp_replace(raw, r"[^\p{Nd}.-]", "").try_cast("double").cast("string")
    if kind == "boolean":
        low = F.lower(raw)
        return F.when(low.isin("true", "yes", "1"), "true").when(low.isin("false", "no", "0"), "false")
    if kind == "array":
        listed = F.from_json(raw, "array<string>")
        return F.to_json(F.coalesce(listed, F.transform(F.split(raw, ","), T.strip)))
    fits = F.length(raw) >= spec.get("minLength", 0)
    if "maxLength" in spec:
        fits = fits & (F.length(raw) <= spec["maxLength"])
    return F.when(fits, raw)


def _falsy(value: Column, kind: str) -> Column:
    if kind in ("integer", "number"):
        return value.try_cast("double") == 0
    if kind == "boolean":
        return value == "false"
    return value.isin("", "[]")


def _listed(value: Column, kind: str, allowed: list) -> Column:
    """Is the value in the list, compared by the field's type.  Numbers and truth values equal one another as 1 and 0
    do; a value of another type is never equal."""
    numbers = [float(x) for x in allowed if isinstance(x, (bool, int, float))]
    if kind in ("integer", "number"):
        return value.try_cast("double").isin(numbers)
    if kind == "boolean":
        return F.when(value == "true", F.lit(1.0)).otherwise(0.0).isin(numbers)
    return value.isin([x for x in allowed if isinstance(x, str)])


def _python_list(items: list) -> str:
    return "[" + ", ".join(repr(i) for i in items) + "]"


FLAGS = {"ignore_case": True, "multiline": True}


ATTEMPTS = "array<struct<raw:string,v:string,w:double>>"


def _attempts(text: Column, hits: Column, spec: dict, rungs: list) -> Column:
    """What the rungs that match find, up to the first that fits the type: ``ATTEMPTS`` in ladder order, v NULL where
    the text does not fit.  Rungs behind the first fitting one cannot change a verdict and are not run.

    Every regex is a literal of the plan, so that it is compiled once a task, not once a row."""
    def found(k: Column) -> Column:
        raw = F.lit(None).cast("string")
        for i, (p, _, group) in enumerate(rungs):
            matched = F.when(T.gated_match(text, hits, p, **FLAGS), T.strip(F.regexp_extract(text, java(p, **FLAGS), group)))
            raw = matched if i == 0 else F.when(k == i, matched).otherwise(raw)
        return raw

    def step(state: Column, k: Column) -> Column:
        raws = F.filter(F.array(found(k)), lambda r: r.isNotNull())
        tried = F.transform(raws, lambda r: F.struct(
            r.alias("raw"), cast_value(r, spec).alias("v"), F.get(weights, k).alias("w")))
        fits = F.coalesce(F.get(state, F.size(state) - 1)["v"].isNotNull(), F.lit(False))
        return F.when(fits, state).otherwise(F.concat(state, tried)).cast(ATTEMPTS)

    weights = T.constant([float(w) for _, w, _ in rungs], "array<double>")
    numbers = F.sequence(F.lit(0), F.lit(len(rungs) - 1))
    return F.aggregate(numbers, F.array().cast(ATTEMPTS), step)


def _misfits(attempts: Column, kind: str) -> Column:
    """Errors of the attempts in front of the first that fits."""
    fitting = F.array_position(F.transform(attempts, lambda a: a["v"].isNotNull()), F.lit(True))
    before = F.when(fitting > 0, F.slice(attempts, F.lit(1), (fitting - 1).cast("int"))).otherwise(attempts)
    return F.transform(before, lambda a: T.message(C.TYPE_MISFIT, value=a["raw"], kind=kind))


def _judge(name: str, spec: dict, required: bool, picked: Column, misfits: Column) -> Column:
    """``RESULT`` struct from the picked value.  Values that were found but did not fit leave an
    error even when a later rung succeeds, and any error makes the field invalid."""
    kind = spec.get("type", "string")
    value = picked["v"]
    falsy = F.coalesce(_falsy(value, kind), F.lit(True))
    checks = []
    if spec.get("enum"):
        outside = F.coalesce(~falsy & ~_listed(value, kind, spec["enum"]), F.lit(False))
        checks.append(F.when(outside, T.message(
            C.NOT_ALLOWED, value=value, allowed=_python_list(spec["enum"]))))
        value = F.when(~outside, value)
        falsy = falsy | outside
    if kind in ("integer", "number"):
        number = value.try_cast("double")
        if "minimum" in spec:
            checks.append(F.when(~falsy & (number < spec["minimum"]), T.message(C.BELOW_MINIMUM, low=spec["minimum"])))
        if "maximum" in spec:
            checks.append(F.when(~falsy & (number > spec["maximum"]), T.message(C.ABOVE_MAXIMUM, high=spec["maximum"])))
    errors = F.concat(misfits, F.array_compact(F.array(*checks))) if checks else misfits
    valid = (F.size(errors) == 0) & value.isNotNull()
    if required:
        errors = F.when(falsy, F.array_append(errors, T.message(C.REQUIRED_MISSING, name=name))).otherwise(errors)
        valid = valid & ~falsy
    return F.struct(F.lit(name).alias("field"), value.alias("value"),
                    F.coalesce(picked["w"], F.lit(0.0)).alias("confidence"), valid.alias("valid"),
                    errors.alias("errors")).cast(RESULT)


def extract_wide(docs: DataFrame, schema: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with ``results`` as an array of ``RESULT`` structs.

    Separate projections, so that each regex is evaluated once: literals that occur, attempts,
    picked values, verdicts.  No shuffle.
    """
    properties, required = schema.get("properties", {}), schema.get("required", [])
    rungs = {n: ladder(n, s) for n, s in properties.items()}
    literals = [w for attempts in rungs.values() for p, _, _ in attempts for w in needed_literals(p)]
    text, hits = F.col("_text"), F.col("_hits")
    scanned = docs.select(id_col, F.col(text_col).alias("_text"),
                          T.literal_hits(T.fold_labels(F.col(text_col)), literals).alias("_hits"))
    tried = scanned.select(id_col, *[
        _attempts(text, hits, s, rungs[n]).alias(f"_try_{k}") for k, (n, s) in enumerate(properties.items())])
    picked = tried.select("*", *[
        F.get(F.filter(f"_try_{k}", lambda a: a["v"].isNotNull()), F.lit(0)).alias(f"_pick_{k}")
        for k in range(len(properties))])
    return picked.select(id_col, F.array(*[
        _judge(n, s, n in required, F.col(f"_pick_{k}"), _misfits(F.col(f"_try_{k}"), s.get("type", "string")))
        for k, (n, s) in enumerate(properties.items())]).alias("results"))


def extract(docs: DataFrame, schema: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and schema field: field, value, confidence, valid, errors."""
    wide = extract_wide(docs, schema, id_col, text_col)
    return T.unnest(wide, [id_col], F.col("results")).select(id_col, "_item.*")


def found_values(results: Column) -> Column:
    """Map of the fields that have a value."""
    return F.map_from_entries(F.transform(F.filter(results, lambda r: r["value"].isNotNull()),
                                          lambda r: F.struct(r["field"], r["value"])))


def validation_report(wide: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Totals and the errors per field of each document, computed inside its row."""
    total = F.size("results")
    valid = F.size(F.filter("results", lambda r: r["valid"]))
    rate = F.when(total > 0, F.bround(valid / total * 100, 2)).otherwise(0.0)
    return wide.select(
        id_col, total.cast("bigint").alias("total_fields"), valid.cast("bigint").alias("valid_fields"),
        (total - valid).cast("bigint").alias("invalid_fields"), rate.alias("success_rate"),
        F.transform(F.filter("results", lambda r: F.size(r["errors"]) > 0),
                    lambda r: F.struct(r["field"], r["errors"])).alias("errors"))


def error_counts(rows: DataFrame) -> DataFrame:
    """Fields and errors over the corpus."""
    return rows.select("field", F.explode("errors").alias("error")).groupBy("field", "error").agg(
        F.count("*").alias("n"))


# --- checks on values that already are columns -------------------------------------------


def check_values(value: Column, spec: dict) -> Column:
    """Constraint messages (length, range, enum) for a column, as an array of strings."""
    checks = []
    if spec.get("type", "string") in ("integer", "number"):
        number = value.try_cast("double")
        live = F.coalesce(number != 0, F.lit(False))
        checks += [F.when(live & (number < spec["minimum"]), T.message(C.BELOW_MINIMUM, low=spec["minimum"]))
                   ] if "minimum" in spec else []
        checks += [F.when(live & (number > spec["maximum"]), T.message(C.ABOVE_MAXIMUM, high=spec["maximum"]))
                   ] if "maximum" in spec else []
    else:
        live = value != ""
        checks += [F.when(live & (F.length(value) < spec["minLength"]),
                          T.message(C.TOO_SHORT, low=spec["minLength"]))] if "minLength" in spec else []
        checks += [F.when(live & (F.length(value) > spec["maxLength"]),
                          T.message(C.TOO_LONG, high=spec["maxLength"]))] if "maxLength" in spec else []
    if spec.get("enum"):
        checks.append(F.when(live & ~_listed(value, spec.get("type", "string"), spec["enum"]), T.message(
            C.NOT_ALLOWED, value=value, allowed=_python_list(spec["enum"]))))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def missing_required(values: Column, names: list[str]) -> Column:
    """Names whose value in a map column is missing or empty."""
    return F.filter(T.strings(names),
                    lambda n: F.coalesce(F.try_element_at(values, n), F.lit("")) == "")


