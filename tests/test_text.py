import html
import random
import re

from pyspark.sql import functions as F

from leafmill.functions import catalog as C
from leafmill.functions import text as T
from leafmill.functions.regex import STEADY, needed_literals
from leafmill.operators import checks, classify, entities, fields, language, schema


def test_types(docs):
    invoice = "INVOICE #123\nBill To: Acme\nInvoice Date: 1\nSubtotal: 5\nTax: 1\nTotal Due: 6\nPayment Terms: 30"
    medical = "Patient Name: X\nDiagnosis: flu\nPrescription and medication by the doctor at the hospital clinic"
    rows = classify.classify(docs(invoice, medical, "xyz abc 123 random text without patterns", "")).orderBy("doc_id").collect()
    assert [r.document_type for r in rows] == ["invoice", "medical", "unknown", "unknown"]
    assert rows[0].confidence > 0.5 and "bill to" in rows[0].keywords_found
    assert rows[2].confidence == 0.0 and rows[2].keywords_found == [] and rows[2].suggested_schema == "general"


def _expected_scores(text):
    low, scores = text.lower(), {}
    for lang, (_, words, patterns) in C.LANGUAGE_RULES.items():
        n = sum(bool(re.search(rf"\b{re.escape(w)}\b", low)) for w in words)
        scores[lang] = n + sum(len(re.findall(p, text, re.I)) for p in patterns) * 0.5
    return scores


def test_languages(docs):
    texts = {
        "en": "The cat is in the house and the dog is with it", "es": "¿Qué hace el niño en la casa del señor que vive?",
        "fr": "C'est la vie, et les œufs du garçon qu'en une", "de": "Der Hund und die Katze für den schönen Fluß",
        "ru": "это не я и он как в с на что", "zh": "我是人的一了在有他不", "ja": "これはペンです。の に を が", "ko": "이 그 저 것 수 하다",
        "ar": "من في على هذا أن كان", "hi": "यह एक का में है और से", "th": "ที่นี้ และ ใน ของ มี จะ",
    }
    rows = language.detect(docs(*texts.values(), "  \n\t ", "12345 67890")).orderBy("doc_id").collect()
    assert [r.language for r in rows[:len(texts)]] == list(texts)
    blank, digits = rows[-2], rows[-1]
    assert (blank.language, blank.script, blank.language_scores) == ("unknown", "unknown", {})
    assert (digits.language, digits.script) == ("unknown", "latin")
    for r, text in zip(rows, texts.values()):
        for lang, want in _expected_scores(text).items():
            own, words, patterns = C.LANGUAGE_RULES[lang]
            want = want * (1.5 if own == r.script else 1.0) / (len(words) + 5 * len(patterns))
            assert abs(r.language_scores[lang] - want) < 1e-9, (text, lang)


def test_person_filter_and_order(docs):
    text = "Bill To\nAdam Smith\nShip Mode\nSecond Class\nLaser Printer\nDr. Brown $5.00 a.b@c.org 2024-01-02"
    rows = entities.entities(docs(text)).orderBy("ord").collect()
    assert [(r.type, r.pattern_no, r.value) for r in rows] == _python_entities(text)
    assert not {"bill to", "ship mode", "second class"} & {r.value.lower() for r in rows}


def _python_entities(text):
    out = []
    for kind, patterns in C.ENTITY_PATTERNS.items():
        for no, p in enumerate(patterns):
            for value in re.findall(p, text):
                if kind == "person" and (value.lower() in C.PERSON_LABELS or any(w in value.lower() for w in C.PERSON_STOP_PARTS)):
                    continue
                out.append((kind, no, value))
    return out


def _noise(seed, n, pieces):
    rng = random.Random(seed)
    return "".join(rng.choice(pieces) for _ in range(n))


def test_entities_equal_python_patterns(docs):
    pieces = ["Acme", "Foo", " ", " ", "\n", "Inc.", "Corp.", "LLC", "Ltd.", "AB", "XYZ", "Company", "Industries", "5", "12", ",", ".", "USD",
              " EUR", "$", "€", "a@b.com", "_x@c.org", "@", "-", "/", "(555)", " 123-4567", "Street", "St", "Road", "Stone", "é", "élan", "Mr.", "May 5, 2020"]
    texts = [_noise(i, 400, pieces) for i in range(60)]
    got = {}
    for r in entities.entities(docs(*texts)).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.type, r.pattern_no, r.value))
    for i, text in enumerate(texts):
        assert got.get(i, []) == _python_entities(text), repr(text)


def test_steady_patterns_equal_their_originals(docs):
    pieces = ["name", "from", "to", " ", "\n", ":", "Ab", "cd", "Efg", "_", "__", "(x)", "- ", "* ", "1. ", "•", "item", "\n\n", "é", "x@y.zz", "12,3", ".5", "USD"]
    texts = [_noise(i, 120, pieces) for i in range(60)]
    frame = docs(*texts)
    for original in STEADY:
        flags = original.startswith("(?:name")
        got = frame.select(T.find_all(F.col("text"), original, 0, ignore_case=flags).alias("m")).collect()
        for r, text in zip(got, texts):
            want = [m.group(0) for m in re.finditer(original, text, re.I if flags else 0)]
            assert r.m == want, (original, text)


def test_records_hold_every_entity(docs):
    text = "\n".join(f"2024-01-{i:02} a{i}@b.org $5.{i:02}" for i in range(1, 31))
    want = [(kind, value) for kind, _, value in _python_entities(text)]
    assert len(want) >= 90
    whole, first = (fields.structured_records(docs(text), entity_limit=n).select("entities").first().entities for n in (None, C.ENTITY_LIMIT))
    assert [(e.type, e.value) for e in whole] == want
    assert [(e.type, e.value) for e in first] == want[:C.ENTITY_LIMIT]


def test_long_runs_do_not_exhaust_the_stack(docs):
    chain = "Abc Defg " * 20000
    text = docs(chain + "Inc.", "5 " + chain + "Street", "name " + chain, "1" * 50000 + " X USD", "http://" + "a." * 20000 + "com")
    assert entities.entities(text).count() > 0
    assert entities.answer_questions(text, ["name"]).count() == 1
    assert text.select(checks.url_error(F.col("text")).alias("e")).filter("e is null").count() == 1


def test_needed_literals():
    assert needed_literals(r"invoice\s*#?\s*:?\s*\w+") == ["invoice"]
    assert needed_literals(r"(?:Total|Grand Total)\s*:?\s*([\d,]+)") == ["total", "grand total"]
    assert needed_literals(r"(?:number|#|no)\s*:?") == ["number", "#", "no"]
    assert needed_literals(r"\[\s*\]") == [] and needed_literals(r"\d{1,2}[/-]\d{2,4}") == []
    every = [p for d in [C.COMMON_FIELDS, *C.TYPE_FIELDS.values()] for ps in d.values() for p in ps]
    sample = "Total: 5 Date: 1/2/2020 Invoice # 7\nBill To: A\n\nTax (5%): 3\nAccount # 12 Form 1099 Name: Bob Expires: now No. 8"
    for p in every:
        if re.search(p, sample, re.I | re.M) and needed_literals(p):
            assert any(w in sample.lower() for w in needed_literals(p)), p


def test_labels(docs):
    text = "Invoice Number: INV-001\nINVOICEDATE 2024-01-15\nNotes:\n\n next line \nPrefixCurrency: USD"
    wide = fields.with_label_fields(docs(text, "other"), extra=[" My Field ", ""])
    got = {f.field: f for f in wide.orderBy("doc_id").first().fields}
    assert got["Invoice Number"].value == "INV-001" and got["Invoice Number"].found
    assert got["Invoice Date"].value == "2024-01-15" and got["Notes"].value == "next line" and got["Currency"].value == "USD"
    assert got["PO Number"].value == "" and got["PO Number"].confidence == 0.0 and "My Field" in got
    stats = fields.label_statistics(fields.with_label_fields(docs(text), enabled=["Invoice Number", "Notes", "PO Number"])).first()
    assert (stats.total_fields, stats.fields_found, stats.fields_empty, stats.success_rate) == (3, 2, 1, 66.7)


def test_structured_invoice(docs):
    text = ("INVOICE # 12345\nDate: 01/15/2024\nTotal: **$1,234.56\nBill To: **Acme*\nx\n\nTax (5%): $12.00\nNotes: **\n"
            "Order ID: A-1\n<table><tr><th>Item</th><th>Quantity</th><th>Amount</th></tr>"
            "<tr><td>Widget A</td><td>5</td><td>$1,234.56</td></tr></table>")
    record = fields.structured_records(docs(text, "")).orderBy("doc_id").collect()
    got = {f.field: f.value for f in record[0].extracted_fields}
    assert record[0].document_type == "invoice"
    assert got["invoice_number"] == "12345" and got["date"] == "01/15/2024" and got["total"] == "1,234.56"
    assert got["tax"] == "12.00" and "notes" not in got and got["order_id"] == "A-1"
    assert [(i.description, i.quantity) for i in record[0].line_items] == [("Widget A", "5")]
    assert record[1].document_type == "unknown" and record[1].extracted_fields == [] and record[1].pages == []
    sums = fields.reconcile(fields.structured_records(docs(text))).first()
    assert str(sums.items_total) == "1234.56" and str(sums.difference) == "0.00"


def test_schema_errors_survive_success(docs):
    spec = {"required": ["flag", "count", "gone"], "properties": {
        "flag": {"type": "boolean"}, "count": {"type": "integer", "minimum": 5},
        "price": {"type": "number", "pattern": r"price ([\d,.x]+)"},
        "gone": {"type": "date"}, "kind": {"type": "string", "pattern": r"kind (\w+)", "enum": ["a", "b"]}}}
    text = "count: 3\nflag: no\nprice xx price: 7.5\nkind z"
    got = {r.field: r for r in schema.extract(docs(text), spec).collect()}
    assert (got["flag"].value, got["flag"].valid) == ("false", False) and got["flag"].errors == ["Required field 'flag' not found"]
    assert got["count"].value == "3" and got["count"].errors == ["Value below minimum (5)"]
    assert got["price"].value == "7.5" and got["price"].errors == ["Value 'xx' doesn't match type 'number'"] and not got["price"].valid
    assert got["gone"].value is None and got["gone"].errors == ["Required field 'gone' not found"]
    assert got["kind"].value is None and got["kind"].confidence == 0.95 and "not in allowed values: ['a', 'b']" in got["kind"].errors[0]


def test_key_points_skip_every_second_adjacent_bullet(docs):
    text = "- one\n- two\n- three\nNote: read this\nYou must act\n"
    assert docs(text).select(entities.key_points(F.col("text")).alias("k")).first().k == ["one", "three", "read this", "act"]


def test_url_pattern_equals_python(docs):
    rng = random.Random(5)
    urls = ["http://a.com", "https://a.b.co./x", "ftp://a.com", "http://localhost:80/", "http://1.2.3.4?q", "http://a", "http://a.com.", "http://-a.com", ""]
    urls += ["http" + "".join(rng.choice(["://", "a", "com", ".", "-", "1", "/", ":8", "?", " ", "toolongtld"]) for _ in range(8)) for _ in range(400)]
    rows = docs(*urls).select("text", checks.url_error(F.col("text")).alias("e")).collect()
    for r in rows:
        assert (r.e is None) == (not r.text or bool(re.match(C.URL_PATTERN, r.text, re.I))), r.text


def test_enums_by_type(docs):
    def verdict(text, spec):
        row = schema.extract(docs(text), {"properties": {"rate": spec}}).first()
        return row.value, row.valid, len(row.errors)

    assert verdict("rate: 1", {"type": "number", "enum": [1, 2.5]})[1:] == (True, 0)
    assert verdict("rate: 2", {"type": "number", "enum": [1, 2.5]})[1:] == (False, 1)
    assert verdict("rate: 7", {"type": "integer", "enum": [7]})[1:] == (True, 0)
    assert verdict("rate: 7", {"type": "integer", "enum": ["7"]})[1:] == (False, 1)
    assert verdict("rate: yes", {"type": "boolean", "enum": [True]}) == ("true", True, 0)
    assert verdict("rate: yes", {"type": "boolean", "enum": [False]})[1:] == (False, 1)
    assert verdict("rate: red", {"type": "string", "enum": ["red"]})[1:] == (True, 0)


def test_html_references(docs):
    texts = ["caf&#233; &eacute; &mdash; &copy; &middot;", "&amp;lt; &amp;amp;", "&lt;b&gt; &nbsp;x", "&notit; &copy2 &copyx; &unknown; & &; &#; &#x; &a",
             "&#x1F600; &#128; &#x81; &#0; &#xD800; &#x110000; &#99999999999999999999; &#xFFFFFFFFFF; &#1; &#xFDD0; &#x1FFFF;", "&acE; &NotEqualTilde; &AMP &LT;&GT",
             "no reference", "", "&#65", "&frac12;&there4;"]
    got = [r.u for r in docs(*texts).orderBy("doc_id").select(T.html_unescape(F.col("text")).alias("u")).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_schema_ladder_stops_at_the_first_fit(docs):
    rungs = [("a=(.)", 0.9, 1), ("b=(.)", 0.8, 1), ("c=(.)", 0.7, 1), ("(.)", 0.5, 1)]
    df = docs("a=x b=1 c=2", "c=3", "b=x", None)
    tried = df.select("doc_id", schema._attempts(F.col("text"), F.array(F.lit("a"), F.lit("b"), F.lit("c")), {"type": "number"}, rungs).alias("t"))
    got = {r.doc_id: [(a.raw, a.v, a.w) for a in r.t] for r in tried.collect()}
    assert got == {0: [("x", None, 0.9), ("1", "1.0", 0.8)], 1: [("3", "3.0", 0.7)], 2: [("x", None, 0.8), ("b", None, 0.5)], 3: []}


def _first_value(text, patterns):
    """Group of the first of the patterns that matches anywhere, by ``re`` itself."""
    for p in patterns:
        if m := re.search(p, text, re.I | re.M):
            return m.group(1) or ""
    return ""


def test_structured_fields_equal_python_patterns(docs):
    pieces = ["Invoice ", "INVOICE #", "inv", "Total: ", "total", "$5.00", "\n", "\n\n", " ", ":", "#", "Date: ", "dated ", "01/02/2024", "March 5, 2024", "Bill To: ",
              "ſhip to: ", "Ship", "**", "é", "K", "ı", "bıll to", "Tax (5%): 1.5", "Notes: none", "Order ID: 7", "due date", "subtotal", "SUBTOTAL 7"]
    texts = ["Invoice Number: 5\nInvoice Date: 1\nBill To: x\n" + _noise(i, 60, pieces) for i in range(80)]
    got = {}
    for r in fields.structured_rows(docs(*texts)).collect():
        assert r.document_type == "invoice"
        got.setdefault(r.doc_id, {})[r.field] = r.value
    for i, text in enumerate(texts):
        want = {f: v.strip() for f, ps in C.COMMON_FIELDS.items() if (v := _first_value(text, ps))}
        want |= {f: v for f, ps in C.TYPE_FIELDS["invoice"].items() if (v := _first_value(text, ps).strip().strip("*").strip())}
        assert got.get(i, {}) == want, repr(text)


def test_every_part_of_a_record_is_planned_alone(docs):
    records = fields.structured_records(docs("INVOICE # 5\nInvoice Number: 5\nBill To: x\nTotal: 7.00"))
    for name in records.columns:
        assert records.select(name).count() == 1 and len(records.select(name).collect()) == 1
    found = records.select(F.explode(fields.nested(F.col("extracted_fields"))).alias("field", "inner")).collect()
    assert {"total", "invoice_number"} <= {r.field for r in found}


def test_structured_fields_run_no_regex_by_row(docs):
    plan = fields.structured_rows(docs("a"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("find(") == 1 and plan.count("scan(") == 1 and "rlike" not in plan and "regexp" not in plan
