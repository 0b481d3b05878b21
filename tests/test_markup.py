import random

from pyspark.sql import functions as F

from leafmill.operators import pages, table_grid, tables

SAMPLE = """
--- Page 1 ---
Stock list
<table><tr><td>bolt</td><td>12</td></tr></table>
The area is $w \\cdot h$ here
<img>a shelf
with boxes</img>
<watermark>DRAFT</watermark>
☑ counted
☐ signed
☑
--- Page 9 ---
   --- Page 3 ---
Second <page_number>5/10</page_number>
"""


def test_page_record(docs):
    rows = pages.parse_pages(docs(SAMPLE, "", "  \n ")).orderBy("doc_id", "page_number").collect()
    assert [(r.doc_id, r.page_number, r.marker_no) for r in rows] == [(0, 1, 1), (0, 2, 9)]
    first, second = rows
    assert first.tables_html == ["<table><tr><td>bolt</td><td>12</td></tr></table>"]
    assert first.tables_csv == ["0,1\nbolt,12\n"]
    assert first.latex_equations == ["w \\cdot h"]
    assert first.image_descriptions == ["a shelf\nwith boxes"]
    assert first.watermarks == ["DRAFT"]
    assert [(c.checked, c.label) for c in first.checkboxes] == [(True, "counted"), (True, ""), (False, "signed")]
    # an indented marker does not split
    assert second.raw_text.startswith("--- Page 3 ---") and second.page_numbers_extracted == ["5/10"]


def test_equation_order_and_overlap(docs):
    text = "$a$ then $$b$$ and \\begin{equation*}c\\end{equation*} \\begin{align}d\n\\end{align}"
    frame = docs(text).select(pages.equations(F.col("text")).alias("e"), pages.environment_equations(F.col("text")).alias("v"))
    row = frame.first()
    assert row.e[0] == "b" and row.e[-2:] == ["c", "d"] and "a" in row.e
    assert row.v == ["c", "d"]


def test_nested_and_unclosed_tables(docs):
    nested = "x <table id='o'><tr><td>1<table><tr><td>2</td></tr></table></td></tr></table> <!-- <table></table> --> y"
    found = docs(nested, "a <TABLE><tr><td>1</td></tr>").select(tables.html_tables(F.col("text")).alias("t")).collect()
    assert found[0].t == [nested[2:nested.index("> <!--") + 1], "<table><tr><td>2</td></tr></table>"]
    assert found[1].t == ["<TABLE><tr><td>1</td></tr>"]


def test_own_level(docs):
    text = "<table><tr><td>A<table><tr><td>in<td>&amp;2</table></td><td>B<tr><th>C<script>x</script></table><table><td>loose"
    found = docs(text).select(tables.text_tables(F.col("text")).alias("t")).first().t
    assert [t.own for t in found] == [
        "<table><tr><td>A<x><x><x>in<x>&amp;2<x></td><td>B</td></tr><tr><th>C<x><x></th></tr></table>",
        "<table><tr><td>in</td><td>&amp;2</td></tr></table>", "<table><tr><td>loose</td></tr></table>"]
    parsed = pages.parse_documents(docs(text)).first().pages[0]
    whole = pages.parse_pages(docs(text)).first()
    assert (parsed.tables_html, parsed.tables_csv) == (whole.tables_html, whole.tables_csv) and len(parsed.tables_html) == 3
    assert pages.content_counts(docs(text)).first().n_tables == 3


def test_line_items(docs):
    table = ("<table><tr><th>Item</th><th>Qty</th><th>Unit Price</th><th>Total</th><th>Other</th></tr>"
             "<tr><td>Widget A\nFurniture, FUR-CH-1000</td><td>5</td><td>$10</td><td><b>$50</b></td><td>z</td></tr>"
             "<tr><td>short</td></tr><tr><td></td><td>1</td><td>1</td><td>1</td><td>1</td></tr></table>")
    rows = tables.line_item_rows(docs(table, "<table><tr><th>Item</th></tr></table>", "none")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.description, r.quantity, r.rate, r.amount, r.sku, r.category) == (
        "Widget A", "5", "$10", "$50", "FUR-CH-1000", "Furniture")


def test_csv_quotes_and_padding(docs):
    table = '<table><tr><th>a</th><th>b</th></tr><tr><td>1,5</td></tr><tr><td>say "x"</td><td>&lt;2 &amp; 3</td></tr></table>'
    assert docs(table).select(tables.csv_text(F.col("text")).alias("c")).first().c == 'a,b\n"1,5",\n"say ""x""",<2 & 3\n'


def brute_grid(rows):
    """rows: lists of (text, colspan, rowspan) -> filled rows; one place at a time, as a browser lays a table out."""
    taken, lines = {}, []
    r = 0
    while r < len(rows) or any(k[0] >= r for k in taken):
        line, c = [], 0
        for text, wide, high in rows[r] if r < len(rows) else []:
            while (r, c) in taken:
                line.append(taken.pop((r, c)))
                c += 1
            for _ in range(wide):
                line.append(text)
                taken.update({(r + d, len(line) - 1): text for d in range(1, high)})
                c += 1
        line += [taken.pop(k) for k in sorted(k for k in taken if k[0] == r)]
        lines.append(line)
        r += 1
    return lines


def test_grid_equals_brute_force(spark):
    rng = random.Random(11)
    cases = []
    for _ in range(150):
        # spans only where no other span is crossed: overlapping tables have no defined layout
        rows = [[(f"r{r}c{c}", rng.choice([1, 1, 2]) if r == 0 else 1, rng.choice([1, 1, 2, 3])) for c in range(rng.randint(0, 4))] for r in range(rng.randint(0, 5))]
        cases.append(rows)
    html = ["<table>" + "".join("<tr>" + "".join(f'<td colspan="{w}" rowspan={h}>{t}</td>' for t, w, h in row) + "</tr>" for row in rows) + "</table>" for rows in cases]
    frame = spark.createDataFrame(list(enumerate(html)), "i int, own string").repartition(4)
    got = {r.i: r.g for r in frame.select("i", table_grid.grid(F.col("own"))["body"].alias("g")).collect()}
    for i, rows in enumerate(cases):
        assert got[i] == brute_grid(rows), html[i]


def test_typed_csv(spark):
    tables_ = {
        '<table><tr><th>a</th></tr><tr><td>1,234</td></tr><tr><td>+007</td></tr></table>': "a\n1234\n7\n",
        '<table><tr><th>a</th></tr><tr><td>1,234</td></tr><tr><td></td></tr></table>': "a\n1234.0\n\n",
        '<table><tr><td>2.50</td><td>x</td></tr><tr><td>-.5</td><td>1</td></tr><tr><td>3.</td><td>007</td></tr></table>': "0,1\n2.5,x\n-0.5,1\n3.0,007\n",
        '<table><tr><td rowspan=3>k, l</td><td>0</td></tr></table>': '0,1\n"k, l",0.0\n"k, l",\n"k, l",\n',
        '<table><tr><th>a</th><td>1</td></tr></table>': "0,1\na,1\n",
        '<table><tr><td colspan="0">gone</td><td colspan=x>1</td></tr></table>': "0\n1\n",
        '<table></table>': "",
        '<table><tr><th colspan="2">h</th></tr></table>': "h,h\n",
    }
    frame = spark.createDataFrame(list(enumerate(tables_)), "i int, own string")
    got = {r.i: r.c for r in frame.select("i", table_grid.typed_csv(F.col("own")).alias("c")).collect()}
    assert [got[i] for i in range(len(tables_))] == list(tables_.values())


def test_spans_of_nested_tables(docs):
    text = '<table><tr><td rowspan="2">a<table><tr><td colspan=2>in</td></tr></table></td><td>5</td></tr><tr><td>6</td></tr></table>'
    rows = tables.table_rows(docs(text), ["doc_id"]).select("table_index", table_grid.typed_csv(F.col("own")).alias("c")).orderBy("table_index").collect()
    assert [r.c for r in rows] == ["0,1\nain,5\nain,6\n", "0,1\nin,in\n"]


def test_table_patterns_equal_their_plain_spelling(spark):
    """The patterns that look for an end only behind a ``<`` find what ``.*?`` finds, whatever the tags look like."""
    plain = {tables._TABLE: r"(?is)<table\b[^>]*>.*?</table\s*>", tables._ROW: r"(?is)<tr\b[^>]*>(.*?)</tr\s*>",
             tables._CELL: r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>"}
    draw = random.Random(5)
    parts = ["<table>", "<TABLE a='1'>", "</table>", "</Table\n >", "<tr>", "<tr\n>", "</tr>", "</TR >", "<td>", "<th rowspan=2>", "<thead>",
             "</td>", "</tH>", "</t", "<", ">", "x", "\n", "☑", "&amp;", "<b>y</b>", ""]
    texts = [("".join(draw.choices(parts, k=draw.randint(0, 25))),) for _ in range(3000)]
    rows = spark.createDataFrame([*texts, (None,)], "t string")
    found = rows.select(*[F.array(*[F.regexp_extract_all("t", F.lit(p), F.lit(g)) for p in pair]).alias(f"p{n}_{g}")
                          for n, pair in enumerate(plain.items()) for g in range(2 if n else 1)])
    assert all(value[0] == value[1] for row in found.collect() for value in row)


def test_spans_come_from_the_opening_tag_alone(spark):
    table = ('<table><tr><th COLSPAN="2">a</th></tr><tr><td>x colspan=3 > y</td><td class="k">1</td></tr>'
             '<tr><td rowspan=2>p</td><td>2</td></tr><tr><td colspan = \'1\'>3</td></tr></table>')
    grid = spark.createDataFrame([(table,)], "t string").select(table_grid.grid(F.col("t")).alias("g")).first()["g"]
    assert grid["header"] == [["a", "a"]]
    assert grid["body"] == [["x colspan=3 > y", "1"], ["p", "2"], ["p", "3"]]


def test_page_patterns_run_behind_their_signs(docs):
    pages_of = lambda *texts: pages.parse_documents(docs(*texts))
    text = "$$a$$ $b$\\begin{equation*}c\\end{equation*}\\begin{align}d\\end{align}<img>e</img><watermark>f</watermark><page_number>1</page_number>☑ g\n☐ h"
    page = pages_of(text).first().pages[0]
    assert page.latex_equations == ["a", "a", "c", "d"] and page.image_descriptions == ["e"] and page.watermarks == ["f"]
    assert page.page_numbers_extracted == ["1"] and [(b.checked, b.label) for b in page.checkboxes] == [(True, "g"), (False, "h")]
    assert pages_of(None).first().pages is None
    plan = docs("a").select(pages.watermarks(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(text" in plan or "contains(text" in plan.lower()
