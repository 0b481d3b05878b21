"""Queries that compare whole records, responses, documents and folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import markup_queries as M
from contract import service_queries, text_queries
from contract import sql as S
from fixtures import render_docs as R
from leafmill.functions import catalog as C
from leafmill.operators import classify, fields, schema
from leafmill.plans import render
from leafmill.sources import files

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


# --- records and responses -----------------------------------------------------------------------

_TYPES = list(C.DOCUMENT_RULES)


@register("response_scores", f"""with src as (select c_custkey as doc_id, 'Bank Statement' || chr(10) || 'Account # ' || lpad(c_custkey::varchar, 8, '0') || chr(10) || 'Statement Period: January' || chr(10)
    || 'Opening Balance: $1.00' || chr(10) || 'Closing Balance: $1.00' || chr(10) || 'Deposits: $10.00' as text from customer), {S.type_scores_sql('src')}, {S.best_type_sql()},
    long as (unpivot (select doc_id, document_type, confidence, {', '.join(_TYPES)} from best) on {', '.join(_TYPES)} into name type value score)
    select doc_id, document_type, round_even(confidence, 2)::double as confidence, type, round_even(score, 3)::double as score from long""")
def _(spark, sf):
    shown = classify.response(classify.classify(R.statements(spark, sf)))
    return shown.select("doc_id", "document_type", "confidence", F.explode("all_scores").alias("type", "score"))


@register("record_heads", f"""select doc_id, a.document_type, round_even(a.confidence, 2)::double as confidence, b.language
    from ({text_queries.ORACLES['classify_documents']}) a join ({text_queries.ORACLES['language_detect']}) b using (doc_id)""")
def _(spark, sf):
    return fields.structured_records(M.docs(spark, sf)).select("doc_id", "document_type", "confidence", "language")


@register("record_entities", text_queries.ORACLES["entities_top20"])
def _(spark, sf):
    records = fields.structured_records(M.docs(spark, sf), entity_limit=C.ENTITY_LIMIT)
    found = records.select("doc_id", F.posexplode("entities").alias("ord", "e"))
    return found.select("doc_id", "ord", "e.type", "e.value")


@register("record_pages_and_tables", f"""with {M.TEXT}, {M._CSV} select p.doc_id, 'invoice' as document_type, page_1 || '|' || page_2 as texts, table_html as tables_html, c.text as csv,
    'x = ' || p.doc_id || '|y = ' || cust as equations from paged p join csv c on c.doc_id = p.doc_id""")
def _(spark, sf):
    record = fields.structured_records(M.inv(spark, sf))
    flat = lambda name: F.array_join(F.flatten(F.transform("pages", lambda p: p[name])), "|")
    return record.select("doc_id", "document_type", F.array_join(F.transform("pages", lambda p: p["raw_text"]), "|").alias("texts"),
                         F.array_join("tables_html", "|").alias("tables_html"), flat("tables_csv").alias("csv"), flat("latex_equations").alias("equations"))


@register("schema_value_rows", f"""{M._SCHEMA} select doc_id, field, case when field not in ('total_amount', 'tax_amount') then value end as text_value,
    case when field in ('total_amount', 'tax_amount') then value::double end as number_value from long where value is not null""")
def _(spark, sf):
    wide = schema.extract_wide(M.inv(spark, sf), C.INVOICE_SCHEMA)
    rows = wide.select("doc_id", F.explode(schema.found_values(F.col("results"))).alias("field", "value"))
    number = F.col("field").isin("total_amount", "tax_amount")
    return rows.select("doc_id", "field", F.when(~number, F.col("value")).alias("text_value"),
                       F.when(number, F.col("value")).try_cast("double").alias("number_value"))


# --- the rendered document ---------------------------------------------------------------------------

_BOXES = "case when st = 'F' then [{'checked': true, 'label': 'Approved'}, {'checked': false, 'label': 'Pending'}] else [{'checked': true, 'label': 'Pending'}, {'checked': false, 'label': 'Approved'}] end"


@register("render_json_whole", f"""with {M.TEXT}, {M._CSV} select p.doc_id, to_json({{'pages': [
      {{'page_number': 1, 'raw_text': page_1, 'tables_html': [table_html], 'tables_csv': [c.text], 'latex_equations': []::varchar[], 'image_descriptions': []::varchar[],
        'watermarks': [st], 'page_numbers_extracted': ['1/2'], 'checkboxes': {_BOXES}}},
      {{'page_number': 2, 'raw_text': page_2, 'tables_html': []::varchar[], 'tables_csv': []::varchar[], 'latex_equations': ['x = ' || p.doc_id, 'y = ' || cust],
        'image_descriptions': ['Stamp of ' || seg], 'watermarks': []::varchar[], 'page_numbers_extracted': ['2/2'], 'checkboxes': list_filter({_BOXES}, lambda b: false)}}]}})::varchar as output
    from paged p join csv c on c.doc_id = p.doc_id""")
def _(spark, sf):
    return render.render(M.parsed(spark, sf), "json").select("doc_id", "output")


# --- folders -------------------------------------------------------------------------------------------

BUCKETS = 64


@register("listed_folder", f"""select (page_id % {BUCKETS})::bigint as bucket, 1::bigint as n_files, sum(strlen(coalesce(html, '')) + 1)::bigint as size_bytes, '.txt' as extension from pages group by 1""")
def _(spark, sf):
    path = service_queries.scratch(spark)
    rows = R.table(spark, sf, "pages").select((F.col("page_id") % BUCKETS).alias("bucket"), F.coalesce("html", F.lit("")).alias("value"))
    rows.repartition(BUCKETS, "bucket").write.partitionBy("bucket").text(path)
    found = files.scan_files(spark, path).select(F.regexp_extract("path", r"bucket=(\d+)/part-[^/]*$", 1).alias("bucket"), "length",
                                                 F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("extension"))
    return found.where("bucket <> ''").groupBy(F.col("bucket").cast("bigint").alias("bucket"), "extension").agg(
        F.count("*").alias("n_files"), F.sum("length").alias("size_bytes"))


@register("texts_of_folder", f"""select (doc_id % {BUCKETS})::bigint as bucket, md5(string_agg(text || chr(10), '' order by doc_id)) as text_hash, sum(length(text) + 1)::bigint as n_chars from documents group by 1""")
def _(spark, sf):
    path = service_queries.scratch(spark)
    rows = M.docs(spark, sf).select((F.col("doc_id") % BUCKETS).alias("bucket"), "doc_id", F.col("text").alias("value"))
    ordered = rows.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "doc_id").drop("doc_id")
    ordered.write.partitionBy("bucket").text(path)
    return files.read_texts(spark, f"{path}/*", "text").select(
        F.regexp_extract("doc_id", r"bucket=(\d+)", 1).cast("bigint").alias("bucket"), F.md5("text").alias("text_hash"),
        F.length("text").cast("bigint").alias("n_chars"))
