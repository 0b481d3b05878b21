"""Queries over the free text of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import sql as S
from fixtures import render_docs as R
from leafmill.functions import catalog as C
from leafmill.functions import text as T
from leafmill.operators import classify, entities, fields, language, pages

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def docs(spark, sf):
    return R.table(spark, sf, "documents").select("doc_id", "text")


# --- types ---------------------------------------------------------------------------

_TYPED = f"with src as (select doc_id, text from documents), {S.type_scores_sql('src')}, {S.best_type_sql()}"
_NAMES = list(C.DOCUMENT_RULES)


@register("classify_documents", f"{_TYPED} select doc_id, document_type, round(confidence, 6) as confidence, "
          "case when document_type in ('invoice','receipt','contract','bank_statement','tax_document','medical') "
          "then document_type else 'general' end as suggested_schema from best")
def _(spark, sf):
    return classify.classify(docs(spark, sf)).select(
        "doc_id", "document_type", F.round("confidence", 6).alias("confidence"), "suggested_schema")


@register("classify_scores", f"{_TYPED}, long as (unpivot (select doc_id, {', '.join(_NAMES)} from best) on {', '.join(_NAMES)} "
          "into name document_type value score) select doc_id, document_type, round(score, 6) as score from long where score > 0")
def _(spark, sf):
    rows = classify.classify(docs(spark, sf)).select("doc_id", F.explode_outer("all_scores").alias("document_type", "score"))
    return rows.filter("score > 0").select("doc_id", "document_type", F.round("score", 6).alias("score"))


@register("type_distribution", f"{_TYPED} select document_type, count(*) as n_docs, round(avg(confidence), 6) as avg_confidence "
          "from best group by document_type")
def _(spark, sf):
    return classify.type_distribution(classify.classify(docs(spark, sf))).withColumn("avg_confidence", F.round("avg_confidence", 6))


def _listed(names: list[str], column: str) -> str:
    return f"(values {', '.join(f'({i}, {S.q(n)})' for i, n in enumerate(names))}) d(ordinal, {column})"


@register("supported_types", f"{_TYPED}, n as (select document_type, count(*) as n from best group by 1) "
          f"select ordinal::int as ordinal, document_type, coalesce(n, 0)::bigint as n_docs from {_listed(_NAMES, 'document_type')} left join n using (document_type)")
def _(spark, sf):
    found = classify.type_distribution(classify.classify(docs(spark, sf)))
    return classify.supported_types(spark).join(found, "document_type", "left").select(
        "ordinal", "document_type", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"))


@register("supported_languages", "with n as (select lang as language, count(*) as n from documents group by 1) "
          f"select ordinal::int as ordinal, language, coalesce(n, 0)::bigint as n_docs from {_listed(C.SUPPORTED_LANGUAGES, 'language')} left join n using (language)")
def _(spark, sf):
    declared = R.table(spark, sf, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n_docs"))
    return language.supported_languages(spark).join(declared, "language", "left").select(
        "ordinal", "language", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"))


# --- languages -------------------------------------------------------------------------

_RANGES = {n: f"[\\x{{{a:X}}}-\\x{{{b:X}}}]" for n, (a, b) in C.SCRIPT_RANGES.items()}
_SCRIPT_COLS = ", ".join(f"length(text) - length(regexp_replace(text, {S.q(r)}, '', 'g')) as n_{n}" for n, r in _RANGES.items())
_SCRIPT_CASE = ("case when " + S.strip("text") + " = '' then 'unknown' " + " ".join(
    f"when n_{n} = greatest({', '.join('n_' + m for m in _RANGES)}) then '{n}'" for n in _RANGES) + " end")


def _word_hit(word: str) -> str:
    if word.isalpha() and all(ch.isalnum() for ch in word):
        return f"list_contains(tokens, {S.q(word)})::int"
    # a trailing mark is no word character: the boundary behind it needs a word character next
    w = r"\p{L}\p{N}_"
    head = f"(?:^|[^{w}])" if word[0].isalnum() else f"[{w}]"
    tail = f"(?:$|[^{w}])" if word[-1].isalnum() else f"[{w}]"
    return f"regexp_matches(low, {S.q(head + word + tail)})::int"


def _pattern_hits(p: str) -> str:
    if p.startswith(r"\b") and p.endswith(r"\b") and p[2:-2].isalpha():
        return f"len(list_filter(tokens, lambda x: x = {S.q(p[2:-2])}))"
    source = "plain" if p.startswith(r"\b") else "text"
    return f"len(regexp_extract_all({source}, {S.q('(?i)' + p)}))"


def _language_cols() -> str:
    cols = []
    for lang, (script, common, pats) in C.LANGUAGE_RULES.items():
        score = f"(({' + '.join(map(_word_hit, common))})::double" + "".join(f" + {_pattern_hits(p)} * 0.5::double" for p in pats) + ")"
        cols.append(f"case when script = '{script}' then {score} * 1.5::double else {score} end / {float(len(common) + 5 * len(pats))}::double as {lang}")
    return ", ".join(cols)


_LANGS = list(C.LANGUAGE_RULES)
_DETECT = f"""with base as (select doc_id, lang as declared, text, lower(text) as low, {S.ascii_words('text')} as plain,
      string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+') as tokens, {_SCRIPT_COLS} from documents),
    scripted as (select *, {_SCRIPT_CASE} as script from base),
    scored as (select doc_id, declared, text, script, {_language_cols()} from scripted),
    topped as (select *, greatest({', '.join(_LANGS)}) as top from scored),
    detected as materialized (select *, case when top <= 0 or script = 'unknown' then 'unknown' {' '.join(f"when {n} = top then '{n}'" for n in _LANGS)} end as language,
      case when top <= 0 or script = 'unknown' then 0.0::double else least(top * 2.0::double, 1.0::double) end as confidence from topped)"""
_LONG = f"""{_DETECT}, long as (unpivot (select doc_id, {', '.join(_LANGS)} from detected) on {', '.join(_LANGS)} into name language value score),
    ranked as (select *, row_number() over (partition by doc_id order by score desc, list_position({_LANGS}, language)) as rn from long)"""


@register("language_detect", f"{_DETECT} select doc_id, script, language, round(confidence, 6) as confidence from detected")
def _(spark, sf):
    return language.detect(docs(spark, sf)).select(
        "doc_id", "script", "language", F.round("language_confidence", 6).alias("confidence"))


@register("language_scores", f"{_LONG} select doc_id, language, round(score, 6) as score from ranked")
def _(spark, sf):
    found = language.detect(docs(spark, sf)).select("doc_id", F.explode_outer("language_scores").alias("language", "score"))
    return found.filter("language is not null").withColumn("score", F.round("score", 6))


@register("language_secondary", f"{_LONG} select doc_id, language from ranked where rn between 2 and 4 and score > 0.1")
def _(spark, sf):
    found = language.detect(docs(spark, sf))
    return T.unnest(found, ["doc_id"], F.col("secondary_languages")).select("doc_id", F.col("_item").alias("language"))


@register("language_agreement", f"{_DETECT} select declared as lang, language, count(*) as n_docs from detected group by all")
def _(spark, sf):
    found = language.detect(R.table(spark, sf, "documents").select("doc_id", "text", "lang"), keep=["lang"])
    return language.agreement(found)


@register("language_scripts", f"""with base as (select doc_id, text, {_SCRIPT_COLS} from documents), long as (
    unpivot (select doc_id, {', '.join('n_' + n for n in _RANGES)} from base) on {', '.join('n_' + n for n in _RANGES)} into name script value n)
    select doc_id, substr(script, 3) as script, n from long where n > 0""")
def _(spark, sf):
    scanned = docs(spark, sf).select("doc_id", language.features(F.col("text")).alias("f"))
    counts = language.script_counts(F.col("f"))
    return T.unnest(scanned, ["doc_id"], F.array(*[F.struct(F.lit(n).alias("script"), c.cast("bigint").alias("n"))
                                                   for n, c in counts.items()])).select("doc_id", "_item.*").filter("n > 0")


@register("language_labels", "select l.lang, f.field, m.label, count(*) as n_docs from documents l cross join (values ('invoice_number'), ('date'), ('total'), ('tax')) f(field) "
          "join (values " + ", ".join(f"({S.q(f)}, {S.q(l)}, {S.q(t)})" for f, by in C.LOCAL_LABELS.items() for l, t in by.items())
          + ") m(field, lang, label) on m.field = f.field and m.lang = l.lang group by all")
def _(spark, sf):
    rows = R.table(spark, sf, "documents").select("lang", F.explode(F.array(*[F.lit(f) for f in C.LOCAL_LABELS])).alias("field"))
    labelled = rows.withColumn("label", language.local_label(F.col("field"), F.col("lang"))).filter("label is not null")
    return labelled.groupBy("lang", "field", "label").agg(F.count("*").alias("n_docs"))


_LOCAL_TEXT = ("text || chr(10) || case lang when 'en' then 'Invoice Number' when 'es' then 'Número de factura' "
               "when 'fr' then 'Numéro de facture' else 'Rechnungsnummer' end || ': N-' || doc_id || chr(10)")
_LOCAL_FIELDS = " union all ".join(
    f"select doc_id, language, '{f}' as field, {S.strip(S.first('text', t + chr(92) + 's*:?' + chr(92) + 's*(.+?)(?:' + chr(92) + 'n|$)', ignore_case=True))} as value "
    f"from detected where language = '{l}'" for f in ("invoice_number", "date") for l, t in C.LOCAL_LABELS[f].items())


@register("language_fields", _DETECT.replace("from documents)", f"from (select doc_id, lang, {_LOCAL_TEXT} as text from documents))")
          + f" select * from ({_LOCAL_FIELDS}) where value is not null")
def _(spark, sf):
    found = language.local_fields(R.localised(spark, sf).select("doc_id", "text"), ["invoice_number", "date"])
    return found.select("doc_id", "language", "field", "value")


# --- entities ----------------------------------------------------------------------------

_EXCLUDED = "(" + ", ".join(map(S.q, C.PERSON_LABELS)) + ")"
_STOPS = " and ".join(f"not contains(lower(value), '{w}')" for w in C.PERSON_STOP_PARTS)


def _entity_rows(table: str) -> str:
    parts, order = [], 0
    for kind, patterns in C.ENTITY_PATTERNS.items():
        for no, p in enumerate(patterns):
            text = "plain" if p.startswith(r"\b") else "text"
            parts.append(f"select doc_id, '{kind}' as type, {no} as pattern_no, {order} as k, generate_subscripts(v, 1) as pos, unnest(v) as value "
                         f"from (select doc_id, {S.find_all(text, p, 0)} as v from base)")
            order += 1
    return (f"with base as (select doc_id, text, {S.ascii_words('text')} as plain from {table}), found as ({' union all '.join(parts)}), "
            f"kept as (select * from found where type <> 'person' or (lower(value) not in {_EXCLUDED} and {_STOPS})), "
            "numbered as (select *, (row_number() over (partition by doc_id order by k, pos) - 1)::int as ord from kept)")


@register("entities_all", f"{_entity_rows('documents')} select doc_id, ord, type, pattern_no::int as pattern_no, value, 0.8::double as confidence from numbered")
def _(spark, sf):
    return entities.entities(docs(spark, sf))


@register("entities_top20", f"{_entity_rows('documents')} select doc_id, ord, type, value from numbered where ord < 20")
def _(spark, sf):
    return entities.entities(docs(spark, sf), limit=C.ENTITY_LIMIT).select("doc_id", "ord", "type", "value")


@register("entities_persons", f"{_entity_rows('documents')} select value, count(*) as n from numbered where type = 'person' group by value")
def _(spark, sf):
    return entities.entities(docs(spark, sf), types=["person"]).groupBy("value").agg(F.count("*").alias("n"))


@register("entities_frequent", f"{_entity_rows('documents')} select type, value, count(*) as n from numbered group by type, value "
          "order by n desc, type, value limit 25")
def _(spark, sf):
    return entities.top_entities(entities.entities(docs(spark, sf)), 25)


@register("entity_summaries", f"""{_entity_rows('documents')}, counts as (select doc_id, count(*) filter (type = 'organization') as o,
    count(*) filter (type = 'person') as p, count(*) filter (type = 'money') as m, count(*) filter (type = 'date') as d from numbered group by doc_id),
    parts as (select b.doc_id, b.text, concat_ws(', ', case when o > 0 then o || ' organization(s)' end, case when p > 0 then p || ' person(s)' end,
      case when m > 0 then m || ' monetary value(s)' end, case when d > 0 then d || ' date(s)' end) as s from base b left join counts using (doc_id))
    select doc_id, case when s <> '' then 'Document contains: ' || s || '.' else 'Document with ' ||
      len(list_filter(string_split_regex(text, {S.pattern(chr(92) + 's+')}), lambda x: x <> '')) || ' words.' end as summary from parts""")
def _(spark, sf):
    return entities.summaries(docs(spark, sf))


def _context_sql(table: str) -> str:
    arms = []
    for context, (triggers, found) in C.CONTEXT_RULES.items():
        gate = " or ".join(f"contains(low, {S.q(t)})" for t in triggers)
        for field, p in found.items():
            arms.append(f"select doc_id, '{context}' as context, '{field}' as field, {S.strip(S.first('text', p, ignore_case=True))} as value "
                        f"from base where {gate}")
    return f"with base as (select doc_id, text, lower(text) as low from {table}) select * from ({' union all '.join(arms)}) where value is not null"


@register("context_fields", _context_sql("documents"))
def _(spark, sf):
    return entities.context_fields(docs(spark, sf)).drop("confidence")


QUESTIONS = ["What is the total amount?", "Which date was it issued?", "Give the phone or the email", "Who is it from, what name?",
             "Tell the number"]


def _answer_case(question: str, part: str) -> str:
    words = [(w, p) for w, p in C.QUESTION_PATTERNS.items() if w in question.lower()]
    arms = " ".join(f"when {S.matches('text', p, ignore_case=True)} then " + (
        f"'{w}'" if part == "field" else S.strip(f"regexp_extract(text, {S.pattern(p, ignore_case=True)}, 1)")) for w, p in words)
    return f"case {arms} end"


_ANSWERS = " union all ".join(
    f"select doc_id, {i}::int as question_no, {_answer_case(x, 'field')} as field, {_answer_case(x, 'value')} as value from documents"
    for i, x in enumerate(QUESTIONS))


@register("question_answers", f"select * from ({_ANSWERS}) where field is not null")
def _(spark, sf):
    return entities.answer_questions(docs(spark, sf), QUESTIONS).select("doc_id", "question_no", "field", "value")


_CONTEXT_ORDERED = _context_sql("documents")


@register("semantic_fields", f"""with ctx as ({_CONTEXT_ORDERED}), ans as (select * from ({_ANSWERS}) where field is not null
      qualify row_number() over (partition by doc_id, field order by question_no desc) = 1)
    select doc_id, field, value, 0.75::double as confidence, 'query' as context from ans union all
    select doc_id, field, value, 0.85::double, context from ctx where not exists (select 1 from ans where ans.doc_id = ctx.doc_id and ans.field = ctx.field)""")
def _(spark, sf):
    return entities.semantic_fields(docs(spark, sf), QUESTIONS)


DESCRIBED = {"mail": {"description": "the email of the writer"}, "sender": {"description": "name of the sender"}, "empty": {"type": "string"}}


@register("described_fields", "select * from (" + " union all ".join(
    f"select doc_id, '{n}' as field, {_answer_case(s['description'], 'value')} as value from documents" for n, s in DESCRIBED.items() if "description" in s)
    + ") where value is not null")
def _(spark, sf):
    return entities.described_fields(docs(spark, sf), DESCRIBED).drop("confidence")


_KEY_POINTS = " || ".join([f"list_slice({S.find_all('text', C.BULLET_PATTERN.replace(chr(92) + '•', '•'))}, 1, 5)"] + [
    f"list_slice({S.find_all('text', p, ignore_case=True)}, 1, 2)" for p in C.IMPORTANT_PATTERNS])


@register("key_points", f"with base as (select doc_id, list_slice({_KEY_POINTS}, 1, 10) as v from documents) "
          "select doc_id, (generate_subscripts(v, 1) - 1)::int as pos, unnest(v) as point from base")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode_outer(entities.key_points(F.col("text"))).alias("pos", "point")).filter("pos is not null")


@register("text_statistics", f"""select doc_id, length(text) as n_chars,
    len(list_filter(string_split_regex(text, {S.pattern(chr(92) + 's+')}), lambda x: x <> ''))::bigint as n_words,
    len(string_split(text, chr(10)))::bigint as n_lines from documents""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in pages.text_statistics(F.col("text")).items()])


# --- labelled fields on free text ------------------------------------------------------------


def _label_sql(names: list[str], table: str) -> str:
    import re
    arms = []
    for n in names:
        tries = [re.escape(s).replace(r"\ ", " ") + r"[\s:]+([^\n]+)" for s in dict.fromkeys([n, n.replace(" ", "")])]
        cases = " ".join(f"when {S.matches('text', p, ignore_case=True)} then {S.strip(f'regexp_extract(text, {S.pattern(p, ignore_case=True)}, 1)')}" for p in tries)
        arms.append(f"select doc_id, {S.q(n)} as field, case {cases} else '' end as value from {table}")
    return " union all ".join(arms)


_CONFIDENCE = "0.85::double + (('0x' || substr(md5(field), 1, 8))::bigint % 15)::double / 100.0::double"


@register("label_fields", f"select doc_id, field, value, value <> '' as found, round(case when value <> '' then least(1.0::double, {_CONFIDENCE}) "
          f"else 0.0::double end, 6) as confidence from ({_label_sql(C.LABEL_FIELDS, 'documents')})")
def _(spark, sf):
    return fields.label_rows(docs(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@register("label_fill_rates", f"select field, count(*) as n_docs, count(*) filter (value <> '') as n_found from ({_label_sql(C.LABEL_FIELDS, 'documents')}) group by field")
def _(spark, sf):
    return fields.fill_rates(fields.label_rows(docs(spark, sf)))


# --- the first query: type and language per document ----------------------------------------------


@register("type_by_language", f"""with t as ({_TYPED} select doc_id, document_type, confidence as c1 from best),
    l as ({_DETECT} select doc_id, language, confidence as c2 from detected)
    select document_type, language, count(*) as n_docs, round(avg(c2), 6) as avg_confidence from t join l using (doc_id) group by all""")
def _(spark, sf):
    typed = classify.classify(docs(spark, sf), keep=["text"]).select("doc_id", "text", "document_type")
    both = language.detect(typed, keep=["document_type"])
    return both.groupBy("document_type", "language").agg(
        F.count("*").alias("n_docs"), F.round(F.avg("language_confidence"), 6).alias("avg_confidence"))
