"""Sums and rules with numbers of every size."""

import math
import random
from collections import defaultdict
from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from docaudit.functions import dates
from docaudit.operators import rules
from docaudit.operators.totals import exact_sums
from docaudit.plans import audit, reports
from docaudit.sources.tables import TABLES

from .test_operators import codes, documents, items

c = F.col
HEAD = "| QUANTITY | DESCRIPTION | UNIT PRICE | TOTAL |\n|---|---|---|---|\n"


def written_sum(values):
    """Sum of the numbers as they are written, rounded once."""
    values = [v for v in values if v is not None]
    if not values:
        return None
    if not all(map(math.isfinite, values)):
        return sum(v for v in values if not math.isfinite(v))
    with localcontext() as exact:
        exact.prec = 800
        return float(sum((Decimal(repr(v)) for v in values), Decimal(0)))


def near(a, b):
    if a is None or b is None or math.isnan(b) or math.isinf(b):
        return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))
    return a == b or abs(a - b) <= 4 * math.ulp(b)


def test_sums_of_any_size(spark):
    rng = random.Random(9)
    groups = {
        1: [0.1] * 30, 2: [0.1, 1e60, 0.2], 3: [1e300, -1e300, 5.0], 4: [float("inf"), 1.0], 5: [float("nan"), 1.0],
        6: [float("inf"), float("-inf")], 7: [1e-9, 2e-9, 5e-324], 8: [None, None], 9: [1e308, 1e308], 10: [1e17, 0.25, -1e17],
        11: [float("-inf"), None], 12: [1.5e6, 2.25, 1e6 + 0.1], 13: [0.0, -0.0],
        14: [rng.choice([-1, 1]) * 10 ** rng.uniform(-30, 40) for _ in range(400)],
        15: [round(rng.uniform(-1e5, 1e5), 2) for _ in range(4000)],
    }
    rows = [(k, v, v and -v) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    rows.append((None, 1e60, 1.0))
    df = spark.createDataFrame(rows, "k long, a double, b double")
    got = exact_sums(df.repartition(5), ["k"], {"a": c("a"), "b": c("b")}, F.count("*").alias("n")).collect()
    assert {r.k for r in got} == set(groups) and all(r.n == len(groups[r.k]) for r in got)
    for r in got:
        assert near(r.a, written_sum(groups[r.k])), (r.k, r.a, written_sum(groups[r.k]))
        assert near(r.b, written_sum([v and -v for v in groups[r.k]]))
    again = exact_sums(df.repartition(2, "a"), ["k"], {"a": c("a"), "b": c("b")}, F.count("*").alias("n")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_ordinary_sums_read_once_more_without_a_join(spark):
    df = spark.range(1000).select((c("id") % 7).alias("k"), (c("id") / 4).alias("a"))
    summed = exact_sums(df, ["k"], {"a": c("a")})
    summed.collect()
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Initial Plan")[0]


def test_one_number_stays_in_its_document(spark):
    fine = dict(issue_date="2024-01-03", vendor_name="V", subtotal=5.0, total_amount=5.0)
    docs = documents(spark, *[dict(fine, id=i, invoice_number=str(i)) for i in range(1, 6)])
    rows = items(
        spark, (1, 1, 1, "a", 1.0, 5.0, 5.0, None), (2, 1, 1, "a", 1.0, 1e60, 1e60, None), (3, 1, 1, "a", 1.0, float("inf"), float("inf"), None),
        (4, 1, 1, "a", 1.0, 5.0, 5.0, float("nan")), (5, 1, 1, "a", 1.0, 5.0, 5.0, 1e300),
    )
    found = codes(rules.rule_check(docs, rows, "2025-01-01"))
    # NaN and a difference of infinities contradict nothing
    assert found == [(2, "R6", "critical"), (3, "R6", "critical"), (5, "R15", "critical")]
    totals = {r.id: r.item_sum for r in reports.items_vs_totals(docs, rows).collect()}
    assert totals == {1: 5.0, 2: 1e60, 3: math.inf, 4: 5.0, 5: 5.0}


def upload(i, cell, total="5.00"):
    header = dict.fromkeys(
        ["doc_type", "invoice_number", "issue_date", "due_date", "vendor_name", "buyer_name", "po_number", "currency", "subtotal", "tax", "shipping", "total_amount"], "")
    header.update(invoice_number=f"N{i}", issue_date="2024-01-03", vendor_name="Acme", subtotal=total, total_amount=total)
    md = f"# Acme\nInvoice No. N{i}\nDate: 2024-01-03\n\n{HEAD}| 1 | red anvil | {cell} | {cell} |\n\nSubtotal {total}\n"
    import json

    return i, f"{i}.pdf", f"h{i}", f"/u/{i}.pdf", md, None, 1, json.dumps(header), None, None


def test_batch_survives_numbers_of_many_digits(spark):
    rows = [upload(1, "5.00"), upload(2, "7" * 60), upload(3, "9" * 400), upload(4, "5.00", "8" * 60), upload(5, "5.00", "3" * 400), upload(6, "5.00")]
    uploads = spark.createDataFrame(
        rows, "arrival long, filename string, file_hash string, stored_path string, markdown string, docling_json string,"
        " page_count int, header_json string, items_json string, findings_json string")
    tables, done = audit.process_batch({n: spark.createDataFrame([], s) for n, s in TABLES.items()}, uploads, "2025-01-01", "2025-01-01T00:00:00+00:00")
    assert [(r.arrival, r.status) for r in done.orderBy("arrival").collect()] == [
        (1, "PENDING"), (2, "ERROR"), (3, "ERROR"), (4, "PENDING"), (5, "PENDING"), (6, "PENDING")]
    # a total that the text spells in more digits than a double has is not found there and dropped
    warned = tables["validation_errors"].filter("severity = 'warning'").select("document_id").distinct().count()
    assert warned == 2
    amounts = {r.filename: r.amount for r in tables["line_items"].join(
        tables["documents"].select(c("id").alias("document_id"), "filename"), "document_id").collect()}
    assert amounts["2.pdf"] == float("7" * 60) and amounts["3.pdf"] == math.inf
    assert tables["validation_errors"].filter("severity = 'critical'").select("document_id").distinct().count() == 2


def test_spellings_of_huge_numbers(spark):
    xs = [1e35, 2.0**115, 2.0**115 + 2.0**70, 1e60, float("7" * 60), 1.7976931348623157e308, 2.0**1000, 123456.5 * 2.0**200, -1e40]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r.v for r in df.select("i", dates.number_variants(c("x")).alias("v")).orderBy("i").collect()]
    for x, forms in zip(xs, got):
        assert {f"{x:.2f}", f"{x:,.2f}", f"{x:g}", f"{int(x):,}"} <= set(forms), x
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),)], "x double")
    assert [r.v for r in odd.select(dates.number_variants(c("x")).alias("v")).collect()] == [["inf"], ["-inf"], ["nan"]]


def test_uploads_of_a_stream_end_as_in_batches(spark):
    from docaudit.session import shared_dir
    from docaudit.streaming import intake

    schema = ("arrival long, filename string, file_hash string, stored_path string, markdown string, docling_json string,"
              " page_count int, header_json string, items_json string, findings_json string")
    first = spark.createDataFrame([upload(1, "5.00"), upload(2, "6.00"), upload(3, "9" * 400)], schema)
    again = upload(4, "5.00")[:2] + ("h1",) + upload(4, "5.00")[3:]
    second = spark.createDataFrame([again, upload(5, "5.00")], schema)
    empty = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    source, folder = shared_dir(spark, "source"), shared_dir(spark, "run")
    first.coalesce(1).write.parquet(f"{source}/a")

    def drain():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
        tables, done = intake.stream_batches(stream, empty, "2025-01-01", "2025-01-01T00:00:00+00:00", folder=folder)
        return {n: df.count() for n, df in tables.items()}, sorted((r.arrival, r.document_id, r.status, r.skipped) for r in done.collect())

    one, done_one = drain()
    assert done_one == [(1, 1, "PENDING", False), (2, 2, "ERROR", False), (3, 3, "ERROR", False)]
    second.coalesce(1).write.parquet(f"{source}/b")
    both, done = drain()
    assert done == [*done_one, (4, 1, "PENDING", True), (5, 4, "PENDING", False)]
    assert both["documents"] == 4 and both["line_items"] == 4
    assert drain() == (both, done)


def test_a_batch_reads_its_uploads_and_judges_its_headers_once(spark, monkeypatch):
    from docaudit import session
    from docaudit.operators import grounding

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = ("arrival long, filename string, file_hash string, stored_path string, markdown string, docling_json string,"
              " page_count int, header_json string, items_json string, findings_json string")
    uploads = spark.createDataFrame([upload(i, "5.00") for i in range(1, 5)], schema).mapInArrow(counted, schema)
    written = []

    def noted(df, label):
        written.append(label)
        return session.settled(df, label)

    monkeypatch.setattr(grounding, "settled", noted)
    tables, done = audit.process_batch({n: spark.createDataFrame([], s) for n, s in TABLES.items()}, uploads, "2025-01-01", "2025-01-01T00:00:00+00:00")
    assert done.count() == 4 and tables["line_items"].count() == 4 and tables["documents"].count() == 4
    assert read.value == 4
    assert written == ["headers"]
