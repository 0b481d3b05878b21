"""Rule-scored document types."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import catalog as C
from leafmill.functions import text as T
from leafmill.functions.regex import STEADY_PYTHON, needed_literals

ROUND_SCORES = 3


def _literals(rules: dict) -> list[str]:
    """Keywords plus the literals that patterns cannot match without."""
    found = [w for _, keywords, patterns in rules.values()
             for w in [*keywords, *(w for p in patterns for w in needed_literals(p))]]
    return list(dict.fromkeys(found))


def type_points(lower: Column, rules: dict = C.DOCUMENT_RULES) -> Column:
    """One Arrow call that reads each lower-cased text once, as ``struct<points, hits>``: points per type (keyword +1 as
    a substring, pattern +2 once) and the literals that occur.  A pattern runs only where a literal it needs does.

    Without a text a pattern that needs no literal is neither there nor not, so its type has no points."""
    kinds = [([*keywords], [(STEADY_PYTHON.get(p, p), tuple(needed_literals(p))) for p in patterns])
             for _, keywords, patterns in rules.values()]
    nothing = [None if any(not needs for _, needs in patterns) else 0 for _, patterns in kinds]
    finder = T.literal_finder(_literals(rules))

    @F.arrow_udf("struct<points:array<int>,hits:array<string>>")
    def scan(texts: pa.Array) -> pa.Array:
        found = finder()
        owners: dict[str, list[int]] = {}
        tests = []
        for i, (keywords, patterns) in enumerate(kinds):
            for word in keywords:
                owners.setdefault(word, []).append(i)
            tests += [(i, re.compile(p).search, needs) for p, needs in patterns]
        points, words, ends = [], [], [0]
        for text in texts.to_pylist():
            if text is None:
                points += nothing
            else:
                hits, own = found(text), [0] * len(kinds)
                for word in hits:
                    for i in owners.get(word, ()):
                        own[i] += 1
                for i, search, needs in tests:
                    if (not needs or not hits.isdisjoint(needs)) and search(text):
                        own[i] += 2
                points += own
                words += hits
            ends.append(len(words))
        counts = pa.ListArray.from_arrays(pa.array(range(0, len(points) + 1, len(kinds)), pa.int32()), pa.array(points, pa.int32()))
        hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()))
        return pa.StructArray.from_arrays([counts, hits], ["points", "hits"])

    # the optimizer must not copy the call, or what is made of it, into a later projection
    return scan.asNondeterministic()(lower)


def type_scores(points: Column, rules: dict = C.DOCUMENT_RULES) -> dict[str, Column]:
    """Score per type: its points times the weight, over the largest possible sum."""
    return {name: F.get(points, F.lit(i)).cast("double") * F.lit(weight) / F.lit(float(len(keywords) + 2 * len(patterns)))
            for i, (name, (weight, keywords, patterns)) in enumerate(rules.items())}


def best_type(scores: Column, names: list[str]) -> Column:
    """Highest score; on a tie the type listed first."""
    ranked = F.array(*[F.struct(scores[n].alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("name"))
                       for i, n in enumerate(names)])
    return F.array_max(ranked)


def found_keywords(hits: Column, doc_type: Column, rules: dict = C.DOCUMENT_RULES) -> Column:
    """Keywords of the winning type that occur, in catalogue order."""
    out = F.array().cast("array<string>")
    for name, (_, keywords, _) in rules.items():
        out = F.when(doc_type == name, F.array_intersect(T.strings(keywords), hits)).otherwise(out)
    return out


def verdict(scanned: Column, rules: dict = C.DOCUMENT_RULES) -> Column:
    """Result of one text's ``type_points`` as a struct, bound step by step: whatever reads or filters it later,
    scores are computed once per evaluation."""
    names, hits = list(rules), scanned["hits"]
    scores = type_scores(scanned["points"], rules)

    def judged(s: Column, best: Column) -> Column:
        known = best["score"] >= C.MIN_TYPE_SCORE
        doc_type = F.when(known, best["name"]).otherwise(C.UNKNOWN)
        return T.let(doc_type, lambda t: F.struct(
            t.alias("document_type"),
            F.when(known, F.least(best["score"] * 2.0, F.lit(1.0))).otherwise(0.0).alias("confidence"),
            route(t).alias("suggested_schema"),
            F.create_map(*[x for n in names for x in (F.lit(n), s[n])]).alias("all_scores"),
            found_keywords(hits, t, rules).alias("keywords_found")))

    return T.let(F.struct(*[c.alias(n) for n, c in scores.items()]),
                 lambda s: T.let(best_type(s, names), lambda best: judged(s, best)))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (),
             rules: dict = C.DOCUMENT_RULES) -> DataFrame:
    """document_type, confidence, suggested_schema, all_scores (map) and keywords_found per document.

    One narrow pass; the text never leaves its partition.  A best score under 0.1 is
    ``unknown`` with confidence 0 and no keywords.
    """
    lowered = docs.select(id_col, *keep, F.lower(text_col).alias("_lower"))
    scanned = lowered.select(id_col, *keep, type_points(F.col("_lower"), rules).alias("_points"))
    judged = scanned.select(id_col, *keep, verdict(F.col("_points"), rules).alias("_v"))
    return judged.select(id_col, *keep, "_v.*")


def route(doc_type: Column) -> Column:
    """Schema to use for a type."""
    out = F.lit(C.DEFAULT_ROUTE)
    for name, schema in C.TYPE_ROUTES.items():
        out = F.when(doc_type == name, F.lit(schema)).otherwise(out)
    return out


def response(classified: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Display form: confidence to 2 digits, scores to 3."""
    return classified.select(
        id_col, "document_type", F.bround("confidence", 2).alias("confidence"),
        F.transform_values("all_scores", lambda _, v: F.bround(v, ROUND_SCORES)).alias("all_scores"),
        "keywords_found")


def type_distribution(classified: DataFrame) -> DataFrame:
    """Documents and mean confidence per type (partial aggregation before the shuffle)."""
    return classified.groupBy("document_type").agg(
        F.count("*").alias("n_docs"), F.avg("confidence").alias("avg_confidence"))


def supported_types(spark) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(C.DOCUMENT_RULES)], "ordinal int, document_type string")
