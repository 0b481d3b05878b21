"""Marked-up documents rendered from the given tables, so that extracted values have an
independent expectation.  Test data, not part of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def amount_text(amount: Column) -> Column:
    return F.format_number(amount.cast("decimal(18,2)"), 2)


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), amount_text(amount))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One two-page invoice per order with lines (doc_id = order key).

    Lines are moved to their order's partition once and grouped there; a sum per map task would only sort them twice.
    """
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name",
                                            amount_text(F.col("p_retailprice")).alias("rate")), "l_partkey")
    lines = lines.select("l_orderkey", "p_name", "l_quantity", "rate", "l_extendedprice").repartition("l_orderkey")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    row = F.concat(F.lit("<tr><td>"), "p_name", F.lit("</td><td>"), F.col("l_quantity").cast("int").cast("string"),
                   F.lit("</td><td>"), "rate", F.lit("</td><td>"),
                   amount_text(F.col("l_extendedprice")), F.lit("</td></tr>"))
    tables = lines.groupBy("l_orderkey").agg(
        F.sum(price).alias("amount"), F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    heads = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey")
    joined = tables.join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    box = F.when(F.col("o_orderstatus") == "F", "☑ Approved\n☐ Pending").otherwise("☐ Approved\n☑ Pending")
    key = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("\n--- Page 1 ---\nINVOICE # "), key, F.lit("\nInvoice Number: INV-"), F.lpad(key, 8, "0"),
        F.lit("\nDate: "), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("\nTotal: "), amount_text(F.col("amount")),
        F.lit("\nBill To: "), "c_name", F.lit("\n\nShip To: "), "c_mktsegment", F.lit("\nTerms: "), "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("\nTotal Amount: "), amount_text(F.col("amount")))).otherwise(""),
        F.lit("\n<table><tr><th>Item</th><th>Quantity</th><th>Rate</th><th>Amount</th></tr>\n"), "rows",
        F.lit("</table>\n\nSubtotal: "), amount_text(F.col("amount")), F.lit("\n<watermark>"), "o_orderstatus",
        F.lit("</watermark>\n"), box, F.lit("\n<page_number>1/2</page_number>\n--- Page 2 ---\n<img>Stamp of "),
        "c_mktsegment", F.lit("</img>\n$x = "), key, F.lit("$\n\\begin{equation}y = "), F.col("o_custkey").cast("string"),
        F.lit("\\end{equation}\n- Order ID: "), key, F.lit("\n\n- Notes: none\n<page_number>2/2</page_number>"))
    return joined.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt per order."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("Corner Store\nReceipt # R"), key, F.lit("\nTransaction ID: "), key, F.lit("\nDate: "),
        F.date_format("o_orderdate", "MM-dd-yyyy"), F.lit("\nTotal: "), dollars(F.col("o_totalprice")),
        F.lit("\nCashier: Clerk "), F.col("o_custkey").cast("string"), F.lit("\nPaid by: cash\nThank you"))
    return orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank statement per customer."""
    customers = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    balance = F.abs(F.col("c_acctbal"))
    text = F.concat(
        F.lit("Bank Statement\nAccount # "), F.lpad(key, 8, "0"), F.lit("\nStatement Period: January\nOpening Balance: "),
        dollars(balance), F.lit("\nClosing Balance: "), dollars(balance + 10), F.lit("\nDeposits: $10.00\n"))
    return customers.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as recognised pages; every seventh turn text is a failure message."""
    turns = table(spark, sf_dir, "conversations")
    bad = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) == 3
    text = F.when(bad, F.concat(F.lit("Error processing image: "), F.col("turn").cast("string"))).otherwise(F.col("text"))
    return turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"),
                        text.alias("text"), (F.length("text") / 1000.0).alias("seconds"))


def localised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language closed with a labelled line in that language."""
    docs = table(spark, sf_dir, "documents")
    label = F.create_map(*[F.lit(x) for x in ("en", "Invoice Number", "es", "Número de factura",
                                             "fr", "Numéro de facture", "de", "Rechnungsnummer")])
    line = F.concat(F.lit("\n"), label[F.col("lang")], F.lit(": N-"), F.col("doc_id").cast("string"), F.lit("\n"))
    return docs.select("doc_id", "lang", F.concat("text", line).alias("text"))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form per customer with a table inside a cell, a table in a comment, and one that is never closed."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit("\n--- Page 1 ---\nForm\n<table><tr><td>A "), "c_name", F.lit("<table><tr><td>in</td><td>"), "c_mktsegment",
        F.lit("</td></tr></table></td><td>B</td></tr><tr><td>C</td><td>D "), key,
        F.lit("</td></tr></table>\n<!-- <table><tr><td>no</td></tr></table> -->\n--- Page 2 ---\n<table><tr><th>open<td>cell "), key)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


PAPER_TYPES = ["invoice", "receipt", "contract", "form", "letter", "report", "id_document", "bank_statement", "tax_document", "medical"]


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper per customer; the last digit of the key picks its type."""
    key = F.col("c_custkey").cast("string")
    padded = F.lpad(key, 8, "0")
    amount = dollars(F.abs(F.col("c_acctbal")))
    texts = [
        F.concat(F.lit("INVOICE # "), key, F.lit("\nInvoice Number: INV-"), key, F.lit("\nBill To: "), "c_name", F.lit("\nDue Date: 01/02/2024\nSubtotal: "), amount),
        F.concat(F.lit("Receipt # R"), key, F.lit("\nTransaction ID: "), key, F.lit("\nPaid by: cash\nChange: 0")),
        F.concat(F.lit("This Agreement is dated as of March 5, 2024\nParties: "), "c_name", F.lit(" and Acme\nEffective Date: 04/01/2024\n"
                 "WHEREAS the parties agree and hereby accept all terms and conditions of this contract.")),
        F.concat(F.lit("Application Form # F"), key, F.lit("\nPlease fill in all required fields.\n[ ] yes [ ] no\nSignature required")),
        F.concat(F.lit("Dear "), "c_name", F.lit(",\nthank you for your visit.\nSincerely,\nClerk "), key),
        F.concat(F.lit("Executive Summary\nReport on findings and results of customer "), key, F.lit("\n- First point of "), key,
                 F.lit("\n\n2. Second point\n\nNote: keep "), padded, F.lit("\nMethodology and analysis\nYou must read section 4\nConclusion")),
        F.concat(F.lit("License # D"), padded, F.lit("\nFull Name: Jane Doe\nDate of Birth: 01/02/1980\nExp: 05/06/2030\nIssued: 07/08/2020\n"
                 "Address: "), "c_mktsegment", F.lit(" street\nNationality: none\nSex: X\nDriver license, identification, expiry")),
        F.concat(F.lit("Bank Statement\nAccount # "), padded, F.lit("\nStatement Period: January\nOpening Balance: "), amount, F.lit("\nClosing Balance: "), amount,
                 F.lit("\nDeposit and withdrawal")),
        F.concat(F.lit("Form 1040\nFederal income tax, IRS\nTax Year: 2023\nTaxpayer: "), "c_name", F.lit("\nSSN: XXX-XX-"), F.lpad(key, 4, "0"),
                 F.lit("\nGross Income: "), amount, F.lit("\nTax Due: $10.50\nRefund: $1.25\nstate deduction")),
        F.concat(F.lit("Facility: "), "c_mktsegment", F.lit("\nPatient Name: Jane Roe\nMRN: M"), padded, F.lit("\nDoctor: Dr. Who\nDiagnosis: cold\n"
                 "Service Date: 09/10/2024\nPrescription and medication by the physician\nDate of service: 09/10/2024")),
    ]
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.element_at(
        F.array(*texts), (F.col("c_custkey") % 10 + 1).cast("int")).alias("text"))


#: A sentence in each language that detection knows.
TONGUES = {
    "en": "The cat and the dog are in the house with that man, and this is for you.", "es": "El perro y el gato están en la casa de los niños, pero ¿qué es esto? No está aquí, señor.",
    "fr": "Le chat et le chien sont dans la maison, c'est une belle journée, qu'il est là où nous sommes.", "de": "Der Hund und die Katze sind in dem Haus, das ist nicht für mich, sondern für die Straße.",
    "it": "Il gatto e il cane sono nella casa, questo è della mia famiglia, perché non sono più qui gli amici.", "pt": "O gato e o cão estão na casa, não são os meus irmãos, mas você também está com uma coleção.",
    "nl": "De kat en de hond zijn in het huis, dat is niet voor mij maar wij zijn blij met een fijne tijd.", "ru": "Кошка и собака не в доме, это что на улице с ним.",
    "zh": "猫和狗在房子里，这是我的家，我们不是在学校的人。", "ja": "これは私の家です。猫と犬がいます。とても楽しいのです。", "ko": "이것은 나의 집입니다 고양이와 개가 있습니다.",
    "ar": "القطة والكلب في البيت وهذا من أجل هذه المدرسة على الطريق", "hi": "यह मेरा घर है और बिल्ली और कुत्ता में हैं", "th": "นี่คือบ้านของฉันและแมวกับสุนัขอยู่ในบ้าน"}


def tongues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text per order in one of the languages, by the order key, with the key in it."""
    texts = F.array(*[F.lit(t) for t in TONGUES.values()])
    pick = (F.col("o_orderkey") % len(TONGUES) + 1).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(
        F.element_at(texts, pick), F.lit(" "), F.col("o_orderkey").cast("string")).alias("text"))


def spanned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per order: two header rows with spans, the order's key over all its lines, for even keys a sum line."""
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    money = lambda c: F.format_number(c / 100, 2)
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.concat(
        cell(F.col("l_linenumber")), cell(F.col("l_quantity").cast("bigint")), cell(money(cents)), F.lit("</tr>")).alias("html"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.sort_array(F.collect_list(line)).alias("lines"), F.sum(cents).alias("total"))
    key = F.concat(F.lit('<td rowspan="'), F.size("lines").cast("string"), F.lit('">'), F.col("doc_id").cast("string"), F.lit("</td>"))
    body = F.array_join(F.transform("lines", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, key).otherwise(""), x["html"])), "\n")
    total = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<tr><td COLSPAN=3>Sum, net</td>"), cell(money(F.col("total"))), F.lit("</tr>"))).otherwise("")
    head = '<table><tr><th rowspan="2">Order</th><th colspan="3">Line</th></tr><tr><th>No</th><th>Quantity</th><th>Price</th></tr>\n'
    return rows.select("doc_id", F.concat(F.lit(head), body, total, F.lit("</table>")).alias("text"))
