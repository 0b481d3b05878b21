"""Queries over rendered documents, checked against the tables they were rendered from."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import sql as S
from fixtures import render_docs as R
from leafmill.functions import catalog as C
from leafmill.functions import text as T
from leafmill.operators import checks, classify, entities, fields, language, pages, schema, tables
from leafmill.plans import render, workflow
from leafmill.sources import files

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def _money(expr: str) -> str:
    return f"format('{{:,.2f}}', {expr}::double)"


# every rendered value of an invoice, from the base tables
INV = f"""rows_of as (select l_orderkey, p_name, l_quantity::int::varchar as qty,
      {_money('p_retailprice')} as rate, {_money('l_extendedprice')} as amt, l_extendedprice::decimal(18,2) as price,
      '<tr><td>' || p_name || '</td><td>' || l_quantity::int || '</td><td>' || {_money('p_retailprice')} || '</td><td>' || {_money('l_extendedprice')} || '</td></tr>' as html
      from lineitem join part on p_partkey = l_partkey),
    sums as (select l_orderkey, sum(price) as total, count(*) as n, string_agg(html, chr(10) order by html) as rows_html from rows_of group by all),
    inv as (select o_orderkey as doc_id, total, n, rows_html, {_money('total')} as total_text, strftime(o_orderdate, '%m/%d/%Y') as day,
      o_orderstatus as st, o_orderpriority as prio, o_custkey as cust, c_name as cname, c_mktsegment as seg,
      'INV-' || lpad(o_orderkey::varchar, 8, '0') as number
      from sums join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey)"""
PAGE_1 = ("'INVOICE # ' || doc_id || chr(10) || 'Invoice Number: ' || number || chr(10) || 'Date: ' || day || chr(10) || 'Total: ' || total_text || chr(10) || "
          "'Bill To: ' || cname || chr(10) || chr(10) || 'Ship To: ' || seg || chr(10) || 'Terms: ' || prio || "
          "case when st = 'F' then chr(10) || 'Total Amount: ' || total_text else '' end || chr(10) || table_html || chr(10) || chr(10) || 'Subtotal: ' || total_text || chr(10) || "
          "'<watermark>' || st || '</watermark>' || chr(10) || case when st = 'F' then '☑ Approved' || chr(10) || '☐ Pending' else '☐ Approved' || chr(10) || '☑ Pending' end "
          "|| chr(10) || '<page_number>1/2</page_number>'")
PAGE_2 = ("'<img>Stamp of ' || seg || '</img>' || chr(10) || '$x = ' || doc_id || '$' || chr(10) || '\\begin{equation}y = ' || cust || '\\end{equation}' || chr(10) || "
          "'- Order ID: ' || doc_id || chr(10) || chr(10) || '- Notes: none' || chr(10) || '<page_number>2/2</page_number>'")
TEXT = (f"{INV}, tabled as (select *, '<table><tr><th>Item</th><th>Quantity</th><th>Rate</th><th>Amount</th></tr>' || chr(10) || rows_html || '</table>' as table_html from inv), "
        f"paged as (select *, {PAGE_1} as page_1, {PAGE_2} as page_2 from tabled)")


def inv(spark, sf):
    return R.invoices(spark, sf)


def docs(spark, sf):
    return R.table(spark, sf, "documents").select("doc_id", "text")


def parsed(spark, sf):
    return pages.parse_documents(inv(spark, sf))


# --- pages and elements --------------------------------------------------------------------


@register("pages_split", f"with {TEXT} select doc_id, p::int as page_number, p::int as marker_no, md5(case p when 1 then page_1 else page_2 end) as text_hash "
          "from paged, (values (1), (2)) t(p)")
def _(spark, sf):
    return pages.split_pages(inv(spark, sf)).select("doc_id", "page_number", "marker_no", F.md5("text").alias("text_hash"))


@register("page_records", f"""with {INV}, sides as (select *, unnest([1, 2]) as p from inv) select doc_id, p::int as page_number,
    case p when 1 then 1 else 0 end::bigint as n_tables, case p when 1 then '' else 'x = ' || doc_id || '|y = ' || cust end as equations,
    case p when 1 then '' else 'Stamp of ' || seg end as images, case p when 1 then st else '' end as watermarks, p || '/2' as marks,
    case when p = 2 then '' when st = 'F' then 'true:Approved|false:Pending' else 'true:Pending|false:Approved' end as boxes from sides""")
def _(spark, sf):
    p = pages.parse_pages(inv(spark, sf))
    return p.select(
        "doc_id", "page_number", F.size("tables_html").cast("bigint").alias("n_tables"),
        F.array_join("latex_equations", "|").alias("equations"), F.array_join("image_descriptions", "|").alias("images"),
        F.array_join("watermarks", "|").alias("watermarks"), F.array_join("page_numbers_extracted", "|").alias("marks"),
        F.array_join(F.transform("checkboxes", lambda b: F.concat(b["checked"].cast("string"), F.lit(":"), b["label"])), "|").alias("boxes"))


@register("page_records_environments", f"""with {INV}, sides as (select *, unnest([1, 2]) as p from inv) select doc_id, p::int as page_number,
    case p when 1 then '' else 'y = ' || cust end as equations, case p when 1 then '' else 'Stamp of ' || seg end as images from sides""")
def _(spark, sf):
    p = pages.parse_pages(inv(spark, sf), environments_only=True)
    return p.select("doc_id", "page_number", F.array_join("latex_equations", "|").alias("equations"),
                    F.array_join("image_descriptions", "|").alias("images"))


_EQ = " || ".join(S.find_all("text", p, dotall=True) for p in (
    r"\$\$([^$]+)\$\$", r"\$([^$]+)\$", r"\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}", r"\\begin\{align\*?\}(.*?)\\end\{align\*?\}"))


@register("equations_free_text", f"with f as (select doc_id, {S.non_blank(_EQ)} as v from documents) "
          "select doc_id, (generate_subscripts(v, 1) - 1)::int as pos, unnest(v) as equation from f")
def _(spark, sf):
    return T.unnest(docs(spark, sf), ["doc_id"], pages.equations(F.col("text")), "pos").select("doc_id", "pos", F.col("_item").alias("equation"))


@register("element_flags", f"""with {TEXT}, src as (select doc_id, page_1 || page_2 as text from paged union all select -1 - doc_id, text from documents)
    select doc_id, regexp_matches(text, '(?i)<table[\\s>/]') as has_table, {S.matches('text', r'[$][$][^$]+[$][$]|[$][^$]+[$]')} as has_equation,
    {S.matches('text', '<img>.*?</img>')} as has_image from src""")
def _(spark, sf):
    both = inv(spark, sf).select("doc_id", "text").unionByName(docs(spark, sf).withColumn("doc_id", F.lit(-1) - F.col("doc_id")))
    return both.select("doc_id", *[c.alias(n) for n, c in pages.element_flags(F.col("text")).items()])


@register("content_counts", f"with {INV} select doc_id, 2::bigint as n_pages, 1::bigint as n_tables, 2::bigint as n_equations, 1::bigint as n_images, 1::bigint as n_watermarks from inv")
def _(spark, sf):
    return pages.content_counts(inv(spark, sf))


# --- tables ----------------------------------------------------------------------------------

_CELLS = f"""with {INV}, numbered as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by html) as r, p_name, qty, rate, amt from rows_of)"""


@register("table_cells", f"""{_CELLS} select doc_id, 0::int as "row", c::int as col, true as is_header, ['Item', 'Quantity', 'Rate', 'Amount'][c + 1] as text from inv, (values (0), (1), (2), (3)) t(c)
    union all select doc_id, r::int, c::int, false, [p_name, qty, rate, amt][c + 1] from numbered, (values (0), (1), (2), (3)) t(c)""")
def _(spark, sf):
    found = tables.table_rows(inv(spark, sf), ["doc_id"])
    return tables.cells(found, ["doc_id", "table_index"]).drop("table_index")


def _quoted(x: str) -> str:
    return f"case when contains({x}, ',') then '\"' || {x} || '\"' else {x} end"


_CSV = f"""csv as (select l_orderkey as doc_id, 'Item,Quantity,Rate,Amount' || chr(10) || string_agg(p_name || ',' || qty || ',' || {_quoted('rate')} || ',' || {_quoted('amt')}, chr(10) order by html) || chr(10) as text
    from rows_of group by l_orderkey)"""


@register("table_csv", f"with {INV}, {_CSV} select * from csv")
def _(spark, sf):
    found = tables.table_rows(inv(spark, sf), ["doc_id"])
    return found.select("doc_id", tables.csv_text(F.col("html")).alias("text"))


@register("line_items", f"{_CELLS} select doc_id, (r - 1)::int as item_index, p_name as description, qty as quantity, rate, amt as amount from numbered")
def _(spark, sf):
    return tables.line_item_rows(inv(spark, sf)).select("doc_id", "item_index", "description", "quantity", "rate", "amount")


@register("line_item_money", f"with {INV} select l_orderkey as doc_id, sum(replace(rate, ',', '')::decimal(18,2) * 100)::bigint as rate_cents, sum(price * 100)::bigint as amount_cents from rows_of group by l_orderkey")
def _(spark, sf):
    rows = tables.line_item_rows(inv(spark, sf))
    return rows.groupBy("doc_id").agg(*[
        F.sum(fields.money(F.col(c)) * 100).cast("bigint").alias(f"{c}_cents") for c in ("rate", "amount")])


@register("order_reconciliation", f"with {INV} select doc_id, n as n_items, (total * 100)::bigint as items_cents, (total * 100)::bigint as stated_cents, 0::bigint as difference_cents from inv")
def _(spark, sf):
    sums = fields.reconcile(fields.structured_records(inv(spark, sf)))
    return sums.select("doc_id", "n_items", (F.col("items_total") * 100).cast("bigint").alias("items_cents"),
                       (F.col("stated_total") * 100).cast("bigint").alias("stated_cents"),
                       (F.col("difference") * 100).cast("bigint").alias("difference_cents"))


# --- types of rendered documents ------------------------------------------------------------------


@register("classify_rendered", f"""with {INV} select 'invoice' as document_type, 'invoice' as suggested_schema, count(*) as n_docs from inv
    union all select 'receipt', 'receipt', count(*) from orders union all select 'bank_statement', 'bank_statement', count(*) from customer""")
def _(spark, sf):
    all_docs = inv(spark, sf).select("doc_id", "text").unionByName(R.receipts(spark, sf)).unionByName(R.statements(spark, sf))
    return classify.classify(all_docs).groupBy("document_type", "suggested_schema").agg(F.count("*").alias("n_docs"))


@register("classify_keywords", "select c_custkey as doc_id, k as keyword from customer, (values " + ", ".join(
    f"('{k}')" for k in ("statement", "account", "balance", "deposit", "opening balance", "closing balance")) + ") t(k)")
def _(spark, sf):
    typed = classify.classify(R.statements(spark, sf))
    return T.unnest(typed, ["doc_id"], F.col("keywords_found")).select("doc_id", F.col("_item").alias("keyword"))


@register("classify_response", f"""with src as (select c_custkey as doc_id, 'Bank Statement' || chr(10) || 'Account # ' || lpad(c_custkey::varchar, 8, '0') || chr(10) || 'Statement Period: January' || chr(10)
    || 'Opening Balance: $1.00' || chr(10) || 'Closing Balance: $1.00' || chr(10) || 'Deposits: $10.00' as text from customer), {S.type_scores_sql('src')}, {S.best_type_sql()}
    select doc_id, document_type, round(confidence, 2) as confidence, round(bank_statement, 3) as own_score from best""")
def _(spark, sf):
    shown = classify.response(classify.classify(R.statements(spark, sf)))
    return shown.select("doc_id", "document_type", "confidence", F.try_element_at("all_scores", F.lit("bank_statement")).alias("own_score"))


# --- labelled and structured fields ------------------------------------------------------------------

_LABELS = ["Invoice Number", "Subtotal", "Total Amount", "Due Date", "Notes"]
_EXTRA = [" Bill To ", "Ship To", ""]
_LABEL_VALUES = f"""with {INV}, found as (select doc_id, unnest(['Invoice Number', 'Subtotal', 'Total Amount', 'Due Date', 'Notes', 'Bill To', 'Ship To']) as field,
    unnest([number, total_text, case when st = 'F' then total_text else '' end, '', 'none', cname, seg]) as value from inv)"""
_CONF = "case when value <> '' then least(1.0::double, 0.85::double + (('0x' || substr(md5(field), 1, 8))::bigint % 15)::double / 100.0::double) else 0.0::double end"


@register("label_fields_rendered", f"{_LABEL_VALUES} select doc_id, field, value, value <> '' as found, round({_CONF}, 6) as confidence from found")
def _(spark, sf):
    return fields.label_rows(inv(spark, sf), enabled=_LABELS, extra=_EXTRA).withColumn("confidence", F.round("confidence", 6))


@register("label_threshold", f"{_LABEL_VALUES} select doc_id, field, value from found where {_CONF} >= 0.9")
def _(spark, sf):
    return fields.label_rows(inv(spark, sf), enabled=_LABELS, extra=_EXTRA, min_confidence=0.9).select("doc_id", "field", "value")


@register("label_statistics", f"""with {INV} select doc_id, 7::bigint as total_fields, case when st = 'F' then 6 else 5 end::bigint as fields_found,
    case when st = 'F' then 1 else 2 end::bigint as fields_empty, case when st = 'F' then 85.7 else 71.4 end::double as success_rate from inv""")
def _(spark, sf):
    return fields.label_statistics(fields.with_label_fields(inv(spark, sf), enabled=_LABELS, extra=_EXTRA))


@register("label_maps", f"""with {INV} select doc_id, number as invoice_number, seg as ship_to, round(least(1.0::double, 0.85::double + (('0x' || substr(md5('Notes'), 1, 8))::bigint % 15)::double / 100.0::double), 6) as notes_confidence from inv""")
def _(spark, sf):
    wide = fields.with_label_fields(inv(spark, sf), enabled=_LABELS, extra=_EXTRA)
    values, sure = fields.value_map(F.col("fields")), fields.confidence_map(F.col("fields"))
    return wide.select("doc_id", values["Invoice Number"].alias("invoice_number"), values["Ship To"].alias("ship_to"),
                       F.round(sure["Notes"], 6).alias("notes_confidence"))


_STRUCTURED = f"""with {INV}, long as (select doc_id, unnest(['date', 'total', 'invoice_number', 'bill_to', 'ship_to', 'subtotal', 'order_id', 'notes', 'terms']) as field,
    unnest([day, total_text, doc_id::varchar, cname, seg, total_text, doc_id::varchar, 'none', prio]) as value from inv)"""


@register("structured_fields", f"{_STRUCTURED} select doc_id, 'invoice' as document_type, field, value from long")
def _(spark, sf):
    return fields.structured_rows(inv(spark, sf))


@register("structured_nested", f"{_STRUCTURED} select doc_id, field, case field when 'bill_to' then 'name' when 'ship_to' then 'location' else '' end as key, value from long")
def _(spark, sf):
    records = fields.structured_records(inv(spark, sf)).select("doc_id", fields.nested(F.col("extracted_fields")).alias("m"))
    outer = records.select("doc_id", F.explode_outer("m").alias("field", "inner")).filter("field is not null")
    return outer.select("doc_id", "field", F.explode_outer("inner").alias("key", "value"))


@register("structured_receipts", """select o_orderkey as doc_id, f as field, v as value from (select o_orderkey,
    unnest(['date', 'total', 'receipt_number', 'store', 'cashier', 'payment_method']) as f,
    unnest([strftime(o_orderdate, '%m-%d-%Y'), format('{:,.2f}', o_totalprice), 'R' || o_orderkey, 'Corner Store', 'Clerk ' || o_custkey, 'cash']) as v from orders)""")
def _(spark, sf):
    return fields.structured_rows(R.receipts(spark, sf)).drop("document_type")


@register("structured_statements", """select c_custkey as doc_id, f as field, v as value from (select c_custkey,
    unnest(['account_number', 'statement_period', 'opening_balance', 'closing_balance', 'total_deposits']) as f,
    unnest([lpad(c_custkey::varchar, 8, '0'), 'January', format('{:,.2f}', abs(c_acctbal)), format('{:,.2f}', abs(c_acctbal) + 10), '10.00']) as v from customer)""")
def _(spark, sf):
    return fields.structured_rows(R.statements(spark, sf)).drop("document_type")


@register("structured_records", f"""with {INV} select doc_id, 'invoice' as document_type, 9::bigint as n_fields, n as n_items, 2::bigint as n_pages, st as watermark, seg as location from inv""")
def _(spark, sf):
    r = fields.structured_records(inv(spark, sf))
    return r.select("doc_id", "document_type", F.size("extracted_fields").cast("bigint").alias("n_fields"),
                    F.size("line_items").cast("bigint").alias("n_items"), F.size("pages").cast("bigint").alias("n_pages"),
                    F.get(F.col("pages")[0]["watermarks"], F.lit(0)).alias("watermark"),
                    fields.nested(F.col("extracted_fields"))["ship_to"]["location"].alias("location"))


@register("entities_rendered", f"""select o_orderkey as doc_id, t as type, v as value from (select o_orderkey, unnest(['date', 'money']) as t,
    unnest([strftime(o_orderdate, '%m-%d-%Y'), '$' || format('{{:,.2f}}', o_totalprice)]) as v from orders)
    union all select o_orderkey, 'person', 'Corner Store' || chr(10) || 'Receipt' from orders where false
    union all select o_orderkey, 'person', 'Corner Store' from orders""")
def _(spark, sf):
    rows = entities.entities(R.receipts(spark, sf), types=["date", "money", "person"])
    return rows.select("doc_id", "type", "value")


@register("context_fields_rendered", """select o_orderkey as doc_id, f as field, v as value from (select o_orderkey, unnest(['amount', 'id_number']) as f,
    unnest([format('{:,.2f}', o_totalprice), o_orderkey::varchar]) as v from orders)""")
def _(spark, sf):
    rows = entities.context_fields(R.receipts(spark, sf))
    return rows.select("doc_id", "field", "value").filter(F.col("field").isin("amount", "id_number"))


# --- schema-driven extraction ------------------------------------------------------------------------

_LEAD = r"regexp_extract(total_text, '^-?\d+\.?\d*')"
_SCHEMA = f"""with {INV}, long as (select doc_id, unnest(['invoice_number', 'invoice_date', 'due_date', 'vendor_name', 'total_amount', 'tax_amount', 'currency']) as field,
    unnest(['OICE', day, day, '--- Page 1 ---', total::double::varchar, case when st = 'F' then {_LEAD} else '1' end, null]) as value,
    unnest([0.95, 0.95, 0.9, 0.5, 0.95, case when st = 'F' then 0.9 else 0.5 end, 0.5])::double as confidence from inv)"""


@register("schema_invoice", f"""{_SCHEMA} select doc_id, field, case when field not in ('total_amount', 'tax_amount') then value end as text_value,
    case when field in ('total_amount', 'tax_amount') then value::double end as number_value, confidence, field <> 'currency' as valid,
    case when field = 'currency' then 'Value ''--- Page 1 ---'' not in allowed values: [''USD'', ''EUR'', ''GBP'', ''JPY'', ''CAD'', ''AUD'']' else '' end as errors from long""")
def _(spark, sf):
    rows = schema.extract(inv(spark, sf), C.INVOICE_SCHEMA)
    number = F.col("field").isin("total_amount", "tax_amount")
    return rows.select("doc_id", "field", F.when(~number, F.col("value")).alias("text_value"),
                       F.when(number, F.col("value")).try_cast("double").alias("number_value"), "confidence", "valid",
                       F.array_join("errors", "; ").alias("errors"))


@register("schema_report", f"with {INV} select doc_id, 7::bigint as total_fields, 6::bigint as valid_fields, 1::bigint as invalid_fields, 85.71::double as success_rate, 'currency' as bad_fields from inv")
def _(spark, sf):
    report = schema.validation_report(schema.extract_wide(inv(spark, sf), C.INVOICE_SCHEMA))
    return report.withColumn("bad_fields", F.array_join(F.transform("errors", lambda e: e["field"]), ",")).drop("errors")


@register("schema_errors", f"with {INV} select 'currency' as field, 'Value ''--- Page 1 ---'' not in allowed values: [''USD'', ''EUR'', ''GBP'', ''JPY'', ''CAD'', ''AUD'']' as error, count(*) as n from inv")
def _(spark, sf):
    return schema.error_counts(schema.extract(inv(spark, sf), C.INVOICE_SCHEMA))


@register("schema_values", f"with {INV} select doc_id, 6::bigint as n_values, day as invoice_date from inv")
def _(spark, sf):
    wide = schema.extract_wide(inv(spark, sf), C.INVOICE_SCHEMA)
    return wide.select("doc_id", schema.found_values(F.col("results")).alias("m")).select(
        "doc_id", F.size("m").cast("bigint").alias("n_values"), F.col("m")["invoice_date"].alias("invoice_date"))


@register("schema_receipt", """select o_orderkey as doc_id, f as field, v as text_value, n as number_value, c as confidence from (select o_orderkey,
    unnest(['store_name', 'date', 'receipt_number', 'payment_method', 'total_amount']) as f, unnest(['Receipt # R' || o_orderkey, strftime(o_orderdate, '%m-%d-%Y'), 'Corner Store', null, null]) as v,
    unnest([null, null, null, null, o_orderkey::double]) as n, unnest([0.85, 0.9, 0.5, 0.5, 0.5])::double as c from orders)""")
def _(spark, sf):
    rows = schema.extract(R.receipts(spark, sf), C.RECEIPT_SCHEMA)
    number = F.col("field") == "total_amount"
    return rows.select("doc_id", "field", F.when(~number, F.col("value")).alias("text_value"),
                       F.when(number, F.col("value")).try_cast("double").alias("number_value"), "confidence")


_TYPES = {"quantity": {"type": "integer", "minimum": 10, "maximum": 40}, "flag": {"type": "boolean"},
          "name": {"type": "string", "minLength": 9, "maxLength": 10, "enum": ["red widget", "small ring"]}, "parts": {"type": "array"}}


@register("schema_casts", """select p_partkey, p_size::varchar as as_integer, p_retailprice as as_number, case when p_size % 2 = 1 then 'true' when p_size % 2 = 0 then 'false' end as as_boolean,
    len(string_split(p_name, ' '))::bigint as n_parts, case when length(p_name) between 9 and 10 then p_name end as as_string from part""")
def _(spark, sf):
    p = R.table(spark, sf, "part")
    flag = F.when(F.col("p_size") % 2 == 1, "Yes").otherwise("0")
    listed = schema.cast_value(F.replace("p_name", F.lit(" "), F.lit(", ")), _TYPES["parts"])
    return p.select(
        "p_partkey", schema.cast_value(F.concat(F.lit("no. "), F.col("p_size").cast("string")), _TYPES["quantity"]).alias("as_integer"),
        schema.cast_value(F.concat(F.lit("$"), F.col("p_retailprice").cast("string")), {"type": "number"}).cast("double").alias("as_number"),
        schema.cast_value(flag, _TYPES["flag"]).alias("as_boolean"),
        F.size(F.from_json(listed, "array<string>")).cast("bigint").alias("n_parts"),
        schema.cast_value(F.col("p_name"), {"type": "string", "minLength": 9, "maxLength": 10}).alias("as_string"))


@register("schema_constraints", """select p_partkey, concat_ws('; ', case when p_size <> 0 and p_size < 10 then 'Value below minimum (10)' end, case when p_size > 40 then 'Value above maximum (40)' end) as size_errors,
    concat_ws('; ', case when length(p_name) < 9 then 'Value too short (min: 9)' end, case when length(p_name) > 10 then 'Value too long (max: 10)' end,
    case when p_name not in ('red widget', 'small ring') then 'Value ''' || p_name || ''' not in allowed values: [''red widget'', ''small ring'']' end) as name_errors from part""")
def _(spark, sf):
    p = R.table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(schema.check_values(F.col("p_size").cast("string"), _TYPES["quantity"]), "; ").alias("size_errors"),
                    F.array_join(schema.check_values(F.col("p_name"), _TYPES["name"]), "; ").alias("name_errors"))


# --- workflows -------------------------------------------------------------------------------------------


@register("workflow_invoice", f"""with {INV} select doc_id, 'completed' as extract_status, 'completed' as validate_status, case when st = 'F' then 'completed' else 'skipped' end as export_status,
    st = 'F' as valid, case when st = 'F' then '' else 'Total Amount' end as missing, 'completed' as workflow_status from inv""")
def _(spark, sf):
    done = workflow.run(inv(spark, sf), workflow.INVOICE_STEPS)
    return done.select("doc_id", "extract_status", "validate_status", "export_status", F.col("validate_output.valid").alias("valid"),
                       F.array_join("validate_output.missing_fields", ",").alias("missing"), "workflow_status")


_POLICY = [workflow.Step("extract", "field_extract", {"fields": ["Total Amount", "Notes"]}),
           workflow.Step("rename", "transform_data", {"source": "extract", "mapping": {"Total Amount": "amount"}}),
           workflow.Step("optional", "no_such_handler", on_failure="skip"),
           workflow.Step("gate", "no_such_handler", condition="extract_output['Total Amount'] = ''"),
           workflow.Step("notify", "send_notification", {"source": "rename", "event": "document.processed"})]


@register("workflow_summary", f"""with {INV}, s as (select unnest(['extract', 'rename', 'optional', 'gate', 'notify']) as step,
    unnest(['completed', 'completed', 'failed', case when st = 'F' then 'skipped' else 'failed' end, case when st = 'F' then 'completed' end]) as status from inv)
    select step, status, count(*) as n from s where status is not null group by all""")
def _(spark, sf):
    return workflow.step_summary(workflow.run(inv(spark, sf), _POLICY), _POLICY)


@register("workflow_dead_letters", f"with {INV} select doc_id, 'failed' as workflow_status, 'Unknown handler: no_such_handler' as gate_error from inv where st <> 'F'")
def _(spark, sf):
    return workflow.dead_letters(workflow.run(inv(spark, sf), _POLICY)).select("doc_id", "workflow_status", "gate_error")


@register("workflow_receipt", """select o_orderkey as doc_id, 'completed' as workflow_status, strftime(o_orderdate, '%m-%d-%Y') as day from orders""")
def _(spark, sf):
    done = workflow.run(R.receipts(spark, sf), workflow.RECEIPT_STEPS)
    return done.select("doc_id", "workflow_status", F.get_json_object("webhook_output", "$.data.Date").alias("day"))


@register("required_fields", f"with {INV} select doc_id, case when st = 'F' then '' else 'Total Amount' end as missing from inv")
def _(spark, sf):
    wide = fields.with_label_fields(inv(spark, sf), enabled=["Invoice Number", "Total Amount"])
    return wide.select("doc_id", F.array_join(schema.missing_required(
        fields.value_map(F.col("fields")), ["Invoice Number", "Total Amount"]), ",").alias("missing"))


# --- rendering ----------------------------------------------------------------------------------------------


@register("render_json", f"with {TEXT} select doc_id, 2::bigint as n_pages, st as watermark, 'y = ' || cust as equation, md5(page_1) as text_hash, 'Approved' as any_label from paged")
def _(spark, sf):
    out = render.render(parsed(spark, sf), "json")
    boxes = F.concat(F.get_json_object("output", "$.pages[0].checkboxes[0].label"), F.get_json_object("output", "$.pages[0].checkboxes[1].label"))
    return out.select("doc_id", F.json_array_length(F.get_json_object("output", "$.pages")).cast("bigint").alias("n_pages"),
                      F.get_json_object("output", "$.pages[0].watermarks[0]").alias("watermark"),
                      F.get_json_object("output", "$.pages[1].latex_equations[1]").alias("equation"),
                      F.md5(F.get_json_object("output", "$.pages[0].raw_text")).alias("text_hash"),
                      F.when(boxes.contains("Approved"), "Approved").alias("any_label"))


_XML_ITEMS = "array<struct<_id:string,_checked:string,_VALUE:string>>"
_XML_PAGES = f"""array<struct<_number:string,Watermarks:struct<Watermark:{_XML_ITEMS}>,Images:struct<Description:{_XML_ITEMS}>,
    Equations:struct<Equation:{_XML_ITEMS}>,Checkboxes:struct<Checkbox:{_XML_ITEMS}>>>"""
_XML_SHAPE = f"struct<Page:{_XML_PAGES}>"


@register("render_xml", f"with {INV} select doc_id, 2::bigint as n_pages, '2' as second_number, st as watermark, 'Stamp of ' || seg as image, 'x = ' || doc_id as equation, case when st = 'F' then 'Approved' else 'Pending' end as ticked from inv")
def _(spark, sf):
    out = render.render(parsed(spark, sf), "xml")
    # read back by one parse of each document, not by one a path
    read = F.from_xml("output", _XML_SHAPE, {"attributePrefix": "_", "valueTag": "_VALUE"})
    page = out.select("doc_id", read.alias("x")).select("doc_id", F.coalesce("x.Page", F.array().cast(_XML_PAGES)).alias("p"))

    def first(n: int, section: str, element: str, attribute: str, value: str):
        """Text of the first such element of page n, '' without one."""
        found = F.get(F.col("p"), F.lit(n - 1))[section][element]
        return F.coalesce(F.get(F.filter(found, lambda e: e[attribute] == value), F.lit(0))["_VALUE"], F.lit(""))

    return page.select("doc_id", F.size("p").cast("bigint").alias("n_pages"),
                       F.coalesce(F.get("p", F.lit(1))["_number"], F.lit("")).alias("second_number"),
                       first(1, "Watermarks", "Watermark", "_id", "1").alias("watermark"),
                       first(2, "Images", "Description", "_id", "1").alias("image"), first(2, "Equations", "Equation", "_id", "1").alias("equation"),
                       first(1, "Checkboxes", "Checkbox", "_checked", "true").alias("ticked"))


@register("render_csv", f"with {INV}, {_CSV} select doc_id, '--- Table 1 ---' || chr(10) || text as output from csv")
def _(spark, sf):
    return render.render(parsed(spark, sf), "csv")


_HTML_HEAD = S.q('<div style="font-family: Arial, sans-serif; padding: 20px; background: #f5f5f5; border-radius: 8px;">\n'
                 '<h2 style="color: #333; border-bottom: 2px solid #4CAF50; padding-bottom: 10px;">📄 Document Preview</h2>\n')
_HTML_PAGE = "'<div style=\"background: white; padding: 15px; border-radius: 5px; margin-top: 15px;\">' || chr(10) || '<h3>Page {n}</h3>' || chr(10) || '<div style=\"line-height: 1.6;\">' || replace(page_{n}, chr(10), '<br>') || '</div>' || chr(10) || '</div>' || chr(10)"


@register("render_html", f"with {TEXT} select doc_id, {_HTML_HEAD} || {_HTML_PAGE.format(n=1)} || {_HTML_PAGE.format(n=2)} || '</div>' as output from paged")
def _(spark, sf):
    return render.render(parsed(spark, sf), "html")


@register("render_listings", f"""with {TEXT} select doc_id, table_html as tables_html, '--- Page 2, Equation 1 ---' || chr(10) || 'x = ' || doc_id || chr(10) || chr(10) || '--- Page 2, Equation 2 ---' || chr(10) || 'y = ' || cust as equations,
    'Page 2, Image 1: Stamp of ' || seg as images, 'Page 1, Watermark 1: ' || st as watermarks, 'Page 1: 1/2' || chr(10) || 'Page 2: 2/2' as page_numbers from paged""")
def _(spark, sf):
    p = F.col("pages")
    return parsed(spark, sf).select(
        "doc_id", render.tables_html(p).alias("tables_html"), render.equation_listing(p).alias("equations"),
        render.image_listing(p).alias("images"), render.watermark_listing(p).alias("watermarks"),
        render.page_number_listing(p).alias("page_numbers"))


@register("render_nothing_found", f"""select doc_id, 'No HTML tables found.' as tables_html, 'No image descriptions found.' as images, 'No watermarks found.' as watermarks,
    'No page numbers found.' as page_numbers, 'No tables found or could not convert.' as csv from documents""")
def _(spark, sf):
    p = F.col("pages")
    return pages.parse_documents(docs(spark, sf)).select(
        "doc_id", render.tables_html(p).alias("tables_html"), render.image_listing(p).alias("images"),
        render.watermark_listing(p).alias("watermarks"), render.page_number_listing(p).alias("page_numbers"), render.as_csv(p).alias("csv"))


@register("render_line_items", f"""with {INV} select l_orderkey as doc_id, 'Description,Quantity,Unit Price,Total' || chr(10) || string_agg(p_name || ',' || qty || ',' || rate || ',' || amt, chr(10) order by html) as csv,
    '<table><tr><th>Description</th><th>Quantity</th><th>Unit Price</th><th>Total</th></tr>' || string_agg(html, '' order by html) || '</table>' as html from rows_of group by l_orderkey""")
def _(spark, sf):
    items = inv(spark, sf).select("doc_id", tables.line_items(tables.text_tables(F.col("text"))["own"]).alias("i"))
    return items.select("doc_id", render.items_csv(F.col("i")).alias("csv"), render.items_html(F.col("i")).alias("html"))


@register("render_envelope", f"""with {TEXT} select doc_id, '2.0' as version, number || '.pdf' as filename, 'PDF' as file_type, '2' as total_pages, 'invoice' as document_type, total_text as total, cname as bill_to from paged""")
def _(spark, sf):
    r = fields.structured_records(inv(spark, sf)).withColumn(
        "name", F.concat(F.lit("INV-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".pdf")))
    out = render.envelope(r, F.col("name"), F.lit(52428), F.size("pages"))

    # read back by one parse of each response, not by one a path
    read = F.from_json("response", """struct<api_version:string,document:struct<filename:string,file_type:string,total_pages:string>,
        result:struct<document_type:string,extracted_fields:struct<total:string,bill_to:string>>>""")
    return out.select("doc_id", read.alias("r")).select(
        "doc_id", F.col("r.api_version").alias("version"), "r.document.filename", "r.document.file_type", "r.document.total_pages",
        "r.result.document_type", "r.result.extracted_fields.total", "r.result.extracted_fields.bill_to")


@register("render_record_xml", f"with {INV} select doc_id, 'invoice' as document_type, cname as bill_to, 9::bigint as n_fields from inv")
def _(spark, sf):
    out = render.record_xml(fields.structured_records(inv(spark, sf)))
    # read back by one parse of each document, not by one a path
    read = F.from_xml("xml", "struct<document_type:string,extracted_fields:struct<field:array<struct<_name:string,_VALUE:string>>>>", {
        "attributePrefix": "_", "valueTag": "_VALUE", "ignoreSurroundingSpaces": "false"})
    found = F.coalesce("x.extracted_fields.field", F.array().cast("array<struct<_name:string,_VALUE:string>>"))
    return out.select("doc_id", read.alias("x")).select("doc_id", "x.document_type", found.alias("f")).select(
        "doc_id", F.coalesce("document_type", F.lit("")).alias("document_type"),
        F.coalesce(F.get(F.filter("f", lambda x: x["_name"] == "bill_to"), F.lit(0))["_VALUE"], F.lit("")).alias("bill_to"),
        F.size("f").cast("bigint").alias("n_fields"))


@register("cleaned_values", "select p_partkey, p_name as value from part")
def _(spark, sf):
    padded = F.concat(F.lit(" \u00a0** "), F.col("p_name"), F.lit("\t**\n"))
    return R.table(spark, sf, "part").select("p_partkey", fields.clean(padded).alias("value"))


@register("file_names", f"""with n as (select page_id, 'dir/' || page_id || '.' || ['jpg', 'PDF', 'docx', 'tar.gz'][(page_id % 4 + 1)::int] as path from pages)
    select page_id, '.' || ['jpg', 'pdf', 'docx', 'gz'][(page_id % 4 + 1)::int] as extension, ['image', 'pdf', 'unknown', 'unknown'][(page_id % 4 + 1)::int] as file_type,
    page_id % 4 < 2 as is_valid, case page_id % 4 when 2 then 'Unsupported file type: .docx' when 3 then 'Unsupported file type: .gz' end as error_message from n""")
def _(spark, sf):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "PDF", "docx", "tar.gz")]), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("dir/"), F.col("page_id").cast("string"), F.lit("."), ext)
    return R.table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in files.file_type(path).items()])


@register("file_extension_check", """select page_id, case when page_id % 2 = 0 then null else 'Unsupported file type: .txt. Supported: .jpg, .jpeg, .png, .bmp, .gif, .tiff, .pdf' end as error from pages""")
def _(spark, sf):
    path = F.concat(F.lit("a.b/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".PNG").otherwise(".txt"))
    return R.table(spark, sf, "pages").select("page_id", checks.extension_error(path).alias("error"))


# --- tables inside tables ------------------------------------------------------------------------

_FORMS = """f as (select c_custkey as doc_id, c_name as cname, c_mktsegment as seg, '<table><tr><td>in</td><td>' || c_mktsegment || '</td></tr></table>' as inner_html from customer),
    h as (select *, '<table><tr><td>A ' || cname || inner_html || '</td><td>B</td></tr><tr><td>C</td><td>D ' || doc_id || '</td></tr></table>' as outer_html,
      '<table><tr><th>open<td>cell ' || doc_id as last_html from f)"""
_OUTER_CSV = "'0,1' || chr(10) || 'A ' || cname || 'in' || seg || ',B' || chr(10) || 'C,D ' || doc_id || chr(10)"


@register("nested_page_records", f"""with {_FORMS} select doc_id, 1 as page_number, outer_html || '|' || inner_html as html, {_OUTER_CSV} || '|0,1' || chr(10) || 'in,' || seg || chr(10) as csv from h
    union all select doc_id, 2, last_html, 'open,cell ' || doc_id || chr(10) from h""")
def _(spark, sf):
    rows = T.unnest(pages.parse_documents(R.forms(spark, sf)), ["doc_id"], F.col("pages")).select("doc_id", "_item.*")
    return rows.select("doc_id", "page_number", F.array_join("tables_html", "|").alias("html"), F.array_join("tables_csv", "|").alias("csv"))


@register("nested_content_counts", "select c_custkey as doc_id, 2::bigint as n_pages, 3::bigint as n_tables from customer")
def _(spark, sf):
    return pages.content_counts(R.forms(spark, sf)).select("doc_id", "n_pages", "n_tables")


@register("nested_cells", f"""with {_FORMS}, c as (select *, unnest([[1, 0, 0], [1, 0, 1], [1, 1, 0], [1, 1, 1], [2, 0, 0], [2, 0, 1], [3, 0, 0], [3, 0, 1]]) as p,
    unnest(['A ' || cname || 'in' || seg, 'B', 'C', 'D ' || doc_id, 'in', seg, 'open', 'cell ' || doc_id]) as text from h)
    select doc_id, p[1] as table_index, p[2] as row, p[3] as col, p[1] = 3 and p[3] = 0 as is_header, text from c""")
def _(spark, sf):
    return tables.cells(tables.table_rows(R.forms(spark, sf), ["doc_id"]), ["doc_id", "table_index"])


@register("nested_listing", f"with {_FORMS} select doc_id, outer_html || chr(10) || inner_html || chr(10) || last_html as listing from h")
def _(spark, sf):
    return pages.parse_documents(R.forms(spark, sf)).select("doc_id", render.tables_html(F.col("pages")).alias("listing"))


@register("nested_records", "select c_custkey as doc_id, 3::bigint as n_tables, '2|1' as per_page from customer")
def _(spark, sf):
    records = fields.structured_records(R.forms(spark, sf))
    return records.select("doc_id", F.size("tables_html").cast("bigint").alias("n_tables"), F.array_join(F.transform(
        "pages", lambda p: F.size(p["tables_html"]).cast("string")), "|").alias("per_page"))


# --- papers of every type --------------------------------------------------------------------

_PAPER_TYPE = f"{R.PAPER_TYPES!r}[c_custkey % 10 + 1]"


@register("paper_types", f"select c_custkey as doc_id, {_PAPER_TYPE} as document_type from customer")
def _(spark, sf):
    return classify.classify(R.papers(spark, sf)).select("doc_id", "document_type")


_PAPER_FIELDS = f"""c as (select c_custkey as doc_id, c_custkey % 10 as k, c_name as name, c_mktsegment as seg, lpad(c_custkey::varchar, 8, '0') as padded,
      {_money('abs(c_acctbal)')} as amount from customer),
    fields as (select doc_id, 'contract' as document_type, unnest(['contract_date', 'parties', 'effective_date', 'date']) as field,
        unnest(['March 5, 2024', name || ' and Acme', '04/01/2024', '04/01/2024']) as value from c where k = 2
      union all select doc_id, 'id_document', unnest(['document_number', 'full_name', 'date_of_birth', 'expiration_date', 'issue_date', 'address']),
        unnest(['D' || padded, 'Jane Doe' || chr(10) || 'Date of Birth', '01/02/1980', '05/06/2030', '07/08/2020', seg || ' street']) from c where k = 6
      union all select doc_id, 'tax_document', unnest(['tax_year', 'form_type', 'taxpayer_name', 'ssn', 'gross_income', 'tax_due', 'refund']),
        unnest(['2023', '1040', name, 'XXX-XX-' || lpad(doc_id::varchar, 4, '0'), amount, '10.50', '1.25']) from c where k = 8
      union all select doc_id, 'medical', unnest(['patient_name', 'patient_id', 'provider', 'diagnosis', 'visit_date', 'facility', 'date']),
        unnest(['Name', 'M' || padded, 'Dr. Who', 'cold', '09/10/2024', seg, '09/10/2024']) from c where k = 9)"""


@register("paper_fields", f"with {_PAPER_FIELDS} select * from fields")
def _(spark, sf):
    rows = fields.structured_rows(R.papers(spark, sf))
    return rows.filter(F.col("document_type").isin("contract", "id_document", "tax_document", "medical"))


@register("paper_key_points", """select c_custkey as doc_id, unnest([0, 1, 2, 3])::int as pos, unnest(['First point of ' || c_custkey, 'Second point',
    'keep ' || lpad(c_custkey::varchar, 8, '0'), 'read section 4']) as point from customer where c_custkey % 10 = 5""")
def _(spark, sf):
    points = R.papers(spark, sf).select("doc_id", F.posexplode_outer(entities.key_points(F.col("text"))).alias("pos", "point"))
    return points.filter((F.col("doc_id") % 10 == 5) & F.col("pos").isNotNull())


@register("languages_of_all", f"select o_orderkey as doc_id, {list(R.TONGUES)!r}[o_orderkey % {len(R.TONGUES)} + 1] as language from orders")
def _(spark, sf):
    return language.detect(R.tongues(spark, sf)).select("doc_id", "language")
