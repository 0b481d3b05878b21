"""Queries over tables as grids, fill rates by type, the table function and reuse of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import markup_queries, service_queries
from fixtures import render_docs as R
from leafmill.operators import classify, fields, reuse, table_function, table_grid, tables

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def _price(cents: str) -> str:
    """Decimal text without useless zeros."""
    return f"({cents} // 100) || '.' || case when {cents} % 10 = 0 then ({cents} // 10 % 10)::varchar else lpad(({cents} % 100)::varchar, 2, '0') end"


_LINES = """l as (select l_orderkey as doc_id, l_linenumber as no, l_quantity::bigint as qty, round(l_extendedprice * 100)::bigint as c,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as i from lineitem)"""


@register("grid_csv", f"""with {_LINES} select doc_id, 'Order,Line,Line,Line' || chr(10) || 'Order,No,Quantity,Price' || chr(10) ||
    string_agg(doc_id || ',' || no || ',' || qty || ',' || {_price('c')}, chr(10) order by i) || chr(10) ||
    case when doc_id % 2 = 0 then '"Sum, net","Sum, net","Sum, net",' || {_price('sum(c)::bigint')} || chr(10) else '' end as csv from l group by doc_id""")
def _(spark, sf):
    found = tables.table_rows(R.spanned_tables(spark, sf), ["doc_id"])
    return found.select("doc_id", table_grid.typed_csv(F.col("own")).alias("csv"))


@register("grid_cells", f"""with {_LINES}, s as (select doc_id, count(*) as n, sum(c)::bigint as total from l group by 1), k as (select unnest(range(4))::int as col),
    p as (select *, (c // 100) as u from (select doc_id, i, no, qty, c from l union all select doc_id, n + 1, null, null, total from s where doc_id % 2 = 0)),
    m as (select *, format('{{:,}}', u) || '.' || lpad((c % 100)::varchar, 2, '0') as price from p)
    select doc_id, r::int as "row", col, true as is_header, case when col = 3 then 'decimal' when doc_id % 2 = 0 then 'text' else 'integer' end as type,
      case when col = 0 then 'Order' when r = 0 then 'Line' else ['No', 'Quantity', 'Price'][col] end as text from s, k, (values (0), (1)) t(r)
    union all select doc_id, (i + 1)::int, col, false, case when col = 3 then 'decimal' when doc_id % 2 = 0 then 'text' else 'integer' end,
      case when col = 3 then price when no is null then 'Sum, net' else [doc_id, no, qty][col + 1]::varchar end from m, k""")
def _(spark, sf):
    found = tables.table_rows(R.spanned_tables(spark, sf), ["doc_id"])
    return table_grid.grid_cells(found, ["doc_id", "table_index"]).drop("table_index")


@register("grid_column_types", """with t as (select distinct l_orderkey % 2 = 0 as even, l_orderkey from lineitem), k as (select unnest(range(4))::int as col)
    select col, case when col = 3 then 'decimal' when even then 'text' else 'integer' end as type, count(*) as n_tables from t, k group by all""")
def _(spark, sf):
    found = tables.table_rows(R.spanned_tables(spark, sf), ["doc_id"]).select(table_grid.grid(F.col("own")).alias("g"))
    kinds = found.select(F.posexplode(table_grid.types(F.col("g"))).alias("col", "type"))
    return kinds.groupBy("col", "type").agg(F.count("*").alias("n_tables"))


_FLAT = markup_queries.ORACLES["table_cells"].replace("0::int as", "1::int as table_index, 0::int as", 1).replace("select doc_id, r::int", "select doc_id, 1::int, r::int", 1)


@register("table_function", _FLAT)
def _(spark, sf):
    table_function.register(spark)
    markup_queries.inv(spark, sf).createOrReplaceTempView("invoice_texts")
    return spark.sql("select d.doc_id, t.* from invoice_texts d, lateral extract_tables(d.text) t")


@register("table_function_nested", markup_queries.ORACLES["nested_cells"].replace("p[1] as table_index, p[2] as row, p[3] as col", "p[1]::int as table_index, p[2]::int as row, p[3]::int as col"))
def _(spark, sf):
    table_function.register(spark)
    # a customer file may be a single task; the tokenizer is to run in as many as there are cores
    R.forms(spark, sf).repartition("doc_id").createOrReplaceTempView("form_texts")
    return spark.sql("select d.doc_id, t.* from form_texts d, lateral extract_tables(d.text) t")


# --- corpus reports ------------------------------------------------------------------------------


_PAPER_TYPE = "list_value({})[c_custkey % 10 + 1]".format(", ".join(f"'{t}'" for t in R.PAPER_TYPES))


@register("paper_type_distribution", f"""select {_PAPER_TYPE} as document_type, count(*) as n_docs from customer group by 1""")
def _(spark, sf):
    return classify.type_distribution(classify.classify(R.papers(spark, sf))).select("document_type", "n_docs")


@register("fill_rates_by_type", """with v as (select ['F', 'O', 'P'][(doc_id % 3 + 1)::int] as kind, unnest(['Alpha', 'Beta', 'Gamma']) as field, unnest([true, doc_id % 2 = 0, false]) as found
      from (select o_orderkey as doc_id from orders)),
    g as (select kind, field, grouping(kind) * 2 + grouping(field) as level, count(*) as n_values, count(*) filter (found) as n_found from v group by rollup (kind, field))
    select kind, field, level::int as level, n_values, n_found, round_even(n_found / n_values * 100, 1)::double as fill_rate from g""")
def _(spark, sf):
    key = F.col("o_orderkey").cast("string")
    beta = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\nBeta: b"), key)).otherwise("")
    docs = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Alpha: a"), key, beta).alias("text"))
    rows = fields.label_rows(docs, enabled=[], extra=["Alpha", "Beta", "Gamma"])
    kind = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("doc_id") % 3 + 1).cast("int"))
    return fields.fill_rates_by_type(rows.withColumn("kind", kind), "kind")


# --- reuse of results ----------------------------------------------------------------------------


def scratch_database(spark) -> str:
    """A new database below the shared folder, for tables that a query writes and reads back."""
    path = service_queries.scratch(spark)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"create database {name} location '{path}'")
    return name


@register("incremental_documents", service_queries.ORACLES["uncached_documents"])
def _(spark, sf):
    table = f"{scratch_database(spark)}.known"
    done = service_queries._done(spark, sf)
    reuse.write_keys(done, table, 8)
    blocks = reuse.filter_blocks(spark.table(table).count())
    return reuse.new_keys(service_queries._keyed(spark, sf), table, reuse.key_filter(spark.table(table), blocks), blocks).select("doc_id")
