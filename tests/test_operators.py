import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docaudit.operators import grounding, header, layout, lifecycle, rules
from docaudit.operators.ranking import number_rows
from docaudit.schemas import DOCUMENTS, LINE_ITEMS, VALIDATION_ERRORS

c = F.col


def documents(spark, *rows):
    names = DOCUMENTS.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], DOCUMENTS)


def items(spark, *rows):
    return spark.createDataFrame(
        [(r[0], r[1], *r[2:]) for r in rows],
        "document_id long, ord long, position int, description string, quantity double, unit_price double, amount double, tax double",
    )


def codes(df):
    return sorted((r.document_id, r.code, r.severity) for r in df.collect())


def test_numbering_of_a_hot_key(spark):
    rows = spark.range(20000).select(
        F.when(c("id") % 3 == 0, 7).otherwise(c("id") % 500).alias("k"), F.xxhash64("id").alias("v"), "id")
    order = [c("v"), c("id")]
    plain = rows.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy(*order)).cast("long"))
    assert number_rows(rows, ["k"], order, "n").exceptAll(plain).count() == 0
    whole = number_rows(rows, [], order, "n").agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(whole) == (1, 20000, 20000)


def test_rules_of_collapsed_and_taxed_documents(spark):
    docs = documents(
        spark,
        dict(id=1, invoice_number="1", issue_date="2024-01-03", vendor_name="V", subtotal=400.0, total_amount=400.0),
        dict(id=2, invoice_number="2", issue_date="2024-01-03", vendor_name="V", subtotal=100.0, total_amount=110.0),
        dict(id=3, invoice_number="", issue_date="x", due_date="2024-01-01", vendor_name=None),
    )
    rows = items(
        spark,
        (1, 1, None, "Skid-Steer 822-79-9581 5 pcs. € 200", None, None, 400.0, None),
        (2, 1, None, "a", 10.0, 10.0, 100.0, 10.0),
        (3, 1, None, "b", 0.0, 2.0, 0.0, None),
        (3, 2, None, "c", None, 2.0, 1.0, None),
        (3, 3, None, "d", 2.0, 2.0, None, None),
    )
    got = codes(rules.rule_check(docs, rows, "2025-01-01"))
    assert got == [
        (1, "R7", "critical"), (3, "R1", "critical"), (3, "R1", "critical"), (3, "R10", "critical"), (3, "R11", "warning"),
        (3, "R14", "critical"), (3, "R2", "critical"), (3, "R8", "warning"),
    ]


def test_truncated_numbering(spark):
    md = "| 1. | a |\n| 2. | b |\n\n3.\nx\n4. y\nDate: 24.06.2020\n7. z"
    docs = documents(spark, *[dict(id=i, markdown=md) for i in (1, 2, 3)])
    rows = items(spark, (1, 1, 1, "a", 1.0, 1.0, 1.0, None), (1, 2, 2, "b", 1.0, 1.0, 1.0, None),
                 (2, 1, 1, "a", 1.0, 1.0, 1.0, None), (2, 2, 1, "b", 1.0, 1.0, 1.0, None),
                 (3, 1, None, "a", 1.0, 1.0, 1.0, None))
    found = rules.one_rule("R9", docs, rows).collect()
    assert [(r.document_id, "2 rows (3-4)" in r.message) for r in found] == [(1, True)]


def test_grounding(spark):
    docs = documents(
        spark,
        dict(id=1, markdown="Globex\n60th Floor &amp; Co\nJan 03, 2024 net 4.271,05 Due 30 days", vendor_name="Globex, 1 Vanderbilt",
             issue_date="2024-01-03", due_date="Due 30 days", total_amount=4271.05, subtotal=99.5),
    )
    assert [r.field for r in grounding.grounding_check(docs).orderBy("row").collect()] == ["vendor_name", "subtotal"]
    kept, issues = grounding.drop_ungrounded(docs)
    row = kept.first()
    assert (row.vendor_name, row.issue_date, row.due_date, row.total_amount, row.subtotal) == ("Globex", "2024-01-03", None, 4271.05, None)
    assert sorted(r.code for r in issues.collect()) == ["G3_FIRST_PART", "G3_NOT_A_DATE", "G3_NOT_FOUND"]


def test_layout_rows(spark):
    def frag(t, top, left, page=1):
        return {"text": t, "prov": [{"page_no": page, "bbox": {"t": top, "l": left}}]}

    texts = [frag("7.", 100.0, 1.0), frag("Backhoe", 100.3, 2.0), frag("5 pcs.", 99.0, 3.0), frag("€ 150", 98.0, 4.0), frag("€ 750", 97.0, 5.0),
             frag("8.", 80.0, 1.0), frag("three", 80.0, 2.0), frag("1 pcs.", 79.0, 3.0), frag("€ 1", 79.0, 4.0), frag("€ 1", 78.0, 5.0), frag("€ 1", 77.0, 6.0)]
    docs = spark.createDataFrame([(1, json.dumps({"texts": texts})), (2, "{broken")], "document_id long, docling_json string")
    # a name placed slightly higher than its number is read before it
    known = items(spark, (1, 1, 1, "a", 1.0, 1.0, 1.0, None), (2, 1, 1, "a", 1.0, 1.0, 1.0, None))
    full, counts = layout.recover_missing_items(known, docs)
    got = [(r.document_id, r.ord, r.position, r.description, r.amount) for r in full.orderBy("document_id", "ord").collect()]
    assert got == [(1, 1, 1, "a", 1.0), (1, 2, 7, "Backhoe 7", 750.0), (2, 1, 1, "a", 1.0)]
    assert [tuple(r) for r in counts.collect()] == [(1, 1)]


def test_headings_and_types(spark):
    given = ["# KCC I&amp;C\n# Other", "## INVOICE 0012456", "# To", "#### deep", "# 12-34-56", "text"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, m string")
    got = [r.v for r in df.select("i", header.vendor_from_heading(c("m")).alias("v")).orderBy("i").collect()]
    assert got == ["KCC I&C", None, None, None, None, None]
    given = ["Due 30 days after receipt of goods. Invoice No. 1210", "Receipt# 4 invoice no 3", "nothing"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, m string")
    assert [r.v for r in df.select("i", header.classify_document(c("m")).alias("v")).orderBy("i").collect()] == ["INVOICE", "RECEIPT", "UNKNOWN"]


def test_broken_answers(spark):
    rows = [(1, '{"line_items":[{"description":"a","quantity":"2","unit_price":"$3","amount":"6"},{"description":"b","qu'),
            (2, '{"line_items":[{"description":"a","quantity":2,"unit_price":"3","amount":"6"}]}'), (3, '{"line_items":[]}')]
    found, issues = header.type_items(spark.createDataFrame(rows, "document_id long, items_json string"))
    assert [(r.document_id, r.description, r.quantity, r.unit_price) for r in found.collect()] == [(1, "a", 2.0, 3.0)]
    assert sorted(r.document_id for r in issues.collect()) == [1, 2]


def test_reserve_keeps_the_newest_and_the_first(spark):
    docs = documents(spark, dict(id=3, file_hash="h", status="PENDING"), dict(id=5, file_hash="h", status="VALIDATED"),
                     dict(id=6, file_hash="g", status="FAILED"))
    new = spark.createDataFrame([(1, "a", "h", "p"), (2, "b", "g", "p"), (3, "c", "g", "p")],
                                "arrival long, filename string, file_hash string, stored_path string")
    fresh, outcomes = lifecycle.reserve(docs, new, "2024-01-01T00:00:00+00:00")
    assert [r.id for r in fresh.collect()] == [7]
    assert sorted((r.arrival, r.document_id, r.skipped) for r in outcomes.collect()) == [(1, 5, True), (2, 7, False), (3, 7, True)]


def test_schemas_hold_the_header(spark):
    assert len(DOCUMENTS) == 27 and len(LINE_ITEMS) == 8 and len(VALIDATION_ERRORS) == 8
