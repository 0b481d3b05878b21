"""Script and language detection, localised labels.

Each text is read by one Arrow call, a fixed small number of times: one token split, one pass per character family.
Code points beyond the Latin blocks are cut out once and every other script is counted on that remainder.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import catalog as C
from leafmill.functions import text as T
from leafmill.functions.regex import WHITESPACE

_WHOLE_WORD = re.compile(r"^\\b([^\W\d_]+)\\b$")
_PLAIN_WORD = re.compile(r"^\w+$")  # no combining marks, so a token equals a bounded word
# characters that single-letter patterns look for, the small form first
_CASE_FORMS = {"ñ": "ñÑ", "¿": "¿", "¡": "¡", "œ": "œŒ", "ç": "çÇ", "ß": "ßẞ", "ü": "üÜ", "ö": "öÖ",
               "ä": "äÄ", "ã": "ãÃ", "õ": "õÕ"}


_SPECIAL = {"ij": "ij", r"\bqu['e]": "qu", r"\bc'est\b": "cest"}
#: Text without these characters has no letter but ASCII ones that a case-insensitive pattern takes for an ASCII letter.
_ODD = "ſıİK"


def _bounded(word: str) -> str:
    """Pattern for a literal between two word boundaries, right for words that start or end with a combining mark (not
    a word character) too."""
    head = r"(?<!\w)" if re.match(r"\w", word[0]) else r"(?<=\w)"
    tail = r"(?!\w)" if re.match(r"\w", word[-1]) else r"(?=\w)"
    return head + word + tail


def features(text: Column) -> Column:
    """Everything the scores need, by one Arrow call, as ``struct<blank, scripts, sums>``: characters per script (spaces,
    digits and punctuation count as Latin) and, per language, common words present (+1 each) and pattern hits (+0.5 each,
    unbounded).  Without a text there are none of them."""
    ranges = {name: f"[{chr(low)}-{chr(high)}]+" for name, (low, high) in C.SCRIPT_RANGES.items()}
    rules = [([w for w in words if _PLAIN_WORD.match(w)], [w for w in words if not _PLAIN_WORD.match(w)], patterns)
             for _, words, patterns in C.LANGUAGE_RULES.values()]
    counted = [m.group(1) for _, _, ps in rules for p in ps if (m := _WHOLE_WORD.match(p))]
    forms, special, blanks, odd_letters = _CASE_FORMS, _SPECIAL, WHITESPACE, _ODD
    bounded = {w: _bounded(w) for _, marked, _ in rules for w in marked}
    marked_block = f"[{ranges['devanagari'][1:-2]}{ranges['thai'][1:-2]}]"
    whole = {p: m.group(1) for _, _, ps in rules for p in ps if (m := _WHOLE_WORD.match(p))}

    @F.arrow_udf("struct<blank:boolean,scripts:array<int>,sums:array<double>>")
    def scan(texts: pa.Array) -> pa.Array:
        scripts = [(name == "latin", re.compile(block)) for name, block in ranges.items()]
        latin = re.compile(ranges["latin"])
        word = re.compile(r"\w").match
        gaps = bytes(b if b > 127 or word(chr(b)) else 32 for b in range(256))
        by_case = re.compile(rf"(?<!\w)({'|'.join(counted)})(?!\w)", re.I).findall
        quote, cest = re.compile(r"\bqu'").findall, re.compile(r"\bc'est\b").findall
        marks = {w: re.compile(p).search for w, p in bounded.items()}
        has_marks = re.compile(marked_block).search
        plain: dict[bytes, list[int]] = {}
        for i, (words, _, _) in enumerate(rules):
            for w in words:
                plain.setdefault(w.encode(), []).append(i)
        owners: dict[bytes, list[int]] = {}
        letters, beyond, others = [], [], []
        for i, (_, _, patterns) in enumerate(rules):
            for p in patterns:
                if p in whole:
                    owners.setdefault(whole[p].encode(), []).append(i)
                elif p in forms:
                    letters.append((i, forms[p]))
                elif p in special:
                    others.append((i, special[p], re.compile(p, re.I).findall))
                else:
                    beyond.append((i, re.compile(p, re.I).findall))

        def scanned(body: str) -> tuple[list[int], list[float]]:
            lower, simple = body.lower(), body.isascii()
            rest = "" if simple else latin.sub("", body)
            odd = not simple and any(c in body for c in odd_letters)
            # words by bytes, which is several times faster than a split by a pattern
            spaced, known = lower, set() if simple else {c for c in set(lower) if c > "\x7f"}
            for c in known:
                if not word(c):
                    spaced = spaced.replace(c, " ")
            tokens = spaced.encode().translate(gaps).split()
            sums = [0.0] * len(rules)
            present = set(tokens)
            for w in plain.keys() & present:
                for i in plain[w]:
                    sums[i] += 1
            if rest and has_marks(rest):
                for i, (_, marked, _) in enumerate(rules):
                    sums[i] += sum(marks[w](lower) is not None for w in marked)
            if odd:
                listed = [w.lower() for w in by_case(body)]
                for w, of in owners.items():
                    n = listed.count(w.decode())
                    for i in of:
                        sums[i] += n * 0.5
            else:
                for w in owners.keys() & present:
                    n = tokens.count(w)
                    for i in owners[w]:
                        sums[i] += n * 0.5
            for i, name, found in others:
                if odd:
                    n = len(found(body))
                elif name == "ij":
                    n = lower.count("ij")
                elif name == "qu":
                    n = sum(t.startswith(b"que") for t in tokens) if "que" in lower else 0
                    n += len(quote(lower)) if "qu'" in lower else 0
                else:
                    n = len(cest(lower)) if "c'est" in lower else 0
                sums[i] += n * 0.5
            for i, chars in letters:
                if chars[0] in known:
                    sums[i] += sum(map(body.count, chars)) * 0.5
            if rest:
                for i, found in beyond:
                    sums[i] += len(found(rest)) * 0.5
            n_latin = len(body) - len(rest)
            return [n_latin if is_latin else sum(map(len, block.findall(rest))) if rest else 0 for is_latin, block in scripts], sums

        blank, counts, totals = [], [], []
        for body in texts.to_pylist():
            if body is None:
                blank.append(None)
                counts += [None] * len(scripts)
                totals += [None] * len(rules)
            else:
                blank.append(body.strip(blanks) == "")
                own_counts, own_sums = scanned(body)
                counts += own_counts
                totals += own_sums
        n = len(blank)
        return pa.StructArray.from_arrays([
            pa.array(blank, pa.bool_()),
            pa.ListArray.from_arrays(pa.array(range(0, n * len(scripts) + 1, len(scripts)), pa.int32()), pa.array(counts, pa.int32())),
            pa.ListArray.from_arrays(pa.array(range(0, n * len(rules) + 1, len(rules)), pa.int32()), pa.array(totals, pa.float64())),
        ], ["blank", "scripts", "sums"])

    # the optimizer must not move the call into a lambda of a later projection, where it cannot run
    return scan.asNondeterministic()(text)


def script_counts(f: Column) -> dict[str, Column]:
    """Characters per script of a text's features."""
    return {name: F.get(f["scripts"], F.lit(i)) for i, name in enumerate(C.SCRIPT_RANGES)}


def _ranked(values: dict[str, Column]) -> Column:
    return F.array(*[F.struct(c.alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("name"))
                     for i, (n, c) in enumerate(values.items())])


def language_scores(f: Column, script: Column) -> dict[str, Column]:
    """Sums of the features times 1.5 when the script agrees, over words + 5 x patterns."""
    return {lang: F.get(f["sums"], F.lit(i)) * F.when(script == own, 1.5).otherwise(1.0) / F.lit(float(len(words) + 5 * len(patterns)))
            for i, (lang, (own, words, patterns)) in enumerate(C.LANGUAGE_RULES.items())}


def detection(text: Column) -> Column:
    """Result of one text as a struct.  Bound step by step, so that whatever reads or filters the
    result later, each scan of the text runs once per evaluation."""
    none = F.array().cast("array<string>")

    def verdict(f: Column, script: Column, ranked: Column) -> Column:
        top = F.get(ranked, F.lit(0))
        known = ~f["blank"] & (top["score"] > 0)
        later = F.filter(F.slice(ranked, 2, 3), lambda s: s["score"] > C.SECONDARY_SCORE)
        return F.struct(
            script.alias("script"), F.when(known, top["name"]).otherwise(C.UNKNOWN).alias("language"),
            F.when(known, F.least(top["score"] * 2.0, F.lit(1.0))).otherwise(0.0).alias("language_confidence"),
            F.when(f["blank"], F.create_map().cast("map<string,double>")).otherwise(
                F.map_from_entries(F.transform(ranked, lambda s: F.struct(s["name"], s["score"])))
            ).alias("language_scores"),
            F.when(known, F.transform(later, lambda s: s["name"])).otherwise(none).alias("secondary_languages"),
            (known & (F.size(later) > 0)).alias("is_multilingual"))

    def scored(f: Column) -> Column:
        script = F.when(f["blank"], C.UNKNOWN).otherwise(F.array_max(_ranked(script_counts(f)))["name"])
        return T.let(script, lambda s: T.let(
            F.reverse(F.array_sort(_ranked(language_scores(f, s)))), lambda r: verdict(f, s, r)))

    return T.let(features(text), scored)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """script, language, language_confidence, language_scores (map), secondary_languages, is_multilingual.

    Blank text is ``unknown`` in language and script with no scores; text without any
    score keeps its script.
    """
    return docs.select(id_col, *keep, detection(F.col(text_col)).alias("_d")).select(id_col, *keep, "_d.*")


def supported_languages(spark) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(C.SUPPORTED_LANGUAGES)], "ordinal int, language string")


def local_label(field: Column, lang: Column) -> Column:
    """Label of a field in a language, NULL when there is none."""
    pairs = [x for f, by_lang in C.LOCAL_LABELS.items() for l, label in by_lang.items()
             for x in (F.lit(f"{f}/{l}"), F.lit(label))]
    return F.try_element_at(F.create_map(*pairs), F.concat(field, F.lit("/"), lang))


def local_fields(docs: DataFrame, fields: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled values in the detected language of each document; only hits become rows."""
    found = detect(docs.select(id_col, F.col(text_col).alias("_body")), id_col, "_body", ["_body"])
    hits = []
    for field in fields:
        value = F.lit(None).cast("string")
        for lang, label in C.LOCAL_LABELS.get(field, {}).items():
            value = F.when(F.col("language") == lang, T.first_match(
                F.col("_body"), label + r"\s*:?\s*(.+?)(?:\n|$)", ignore_case=True)).otherwise(value)
        hits.append(F.struct(F.lit(field).alias("field"), T.strip(value).alias("value")))
    rows = T.unnest(found, [id_col, "language", "language_confidence"],
                    F.filter(F.array(*hits), lambda h: h["value"].isNotNull()))
    return rows.select(id_col, "language", "language_confidence", "_item.*")


def agreement(detected: DataFrame, declared_col: str = "lang") -> DataFrame:
    """Documents per declared and detected language."""
    return detected.groupBy(declared_col, "language").agg(F.count("*").alias("n_docs"))
