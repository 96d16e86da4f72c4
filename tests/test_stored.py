"""Tables dealt by document, and clustered for look-ups: plans, metrics and rows."""

import re

import pytest
from pyspark.sql import functions as F

from docaudit.operators import lifecycle as lc
from docaudit.plans import reports as rp
from docaudit.session import shared_dir
from docaudit.sources import stored
from docaudit.sources.tables import TABLES

c = F.col
NOW = "2025-01-01T00:00:00+00:00"


def filled(df, name, **given):
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]])


def sample(spark, n):
    docs = filled(
        spark.range(1, n + 1), "documents", id=c("id"), filename=F.concat(c("id").cast("string"), F.lit(".pdf")),
        file_hash=F.sha2(c("id").cast("string"), 256), status=F.lit("PENDING"), created_at=F.lit(NOW), updated_at=F.lit(NOW),
        subtotal=c("id") / 2, total_amount=c("id") / 2, vendor_name=F.lit("V"), page_count=F.lit(1))
    lines = filled(
        spark.range(n * 3), "line_items", id=c("id"), document_id=c("id") % n + 1, position=F.floor(c("id") / n) + 1,
        description=F.lit("a"), quantity=F.lit(1.0), unit_price=c("id") / 4, amount=c("id") / 4)
    errors = filled(
        spark.range(n * 2), "validation_errors", id=c("id"), document_id=c("id") % n + 1, field=F.lit("f"), message=F.lit("m"),
        severity=F.lit("critical"), source=F.lit("rule"), resolved=c("id") % 2 == 0, created_at=F.lit(NOW))
    return {"documents": docs, "line_items": lines, "validation_errors": errors}


@pytest.fixture(scope="module")
def dealt(spark):
    folder = shared_dir(spark, "dealt")
    tables = sample(spark, 400)
    stored.write_dealt(tables, folder, buckets=6)
    return tables, folder


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df):
    """Exchanges that deal rows by a key; a final sort deals by ranges."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning[^\n]*", plan.split("Initial Plan")[-1])


def same(a, b):
    assert a.select(sorted(a.columns)).exceptAll(b.select(sorted(a.columns))).count() == 0 and a.count() == b.count()


def test_dealt_tables_keep_their_rows(spark, dealt):
    tables, folder = dealt
    back = stored.read_dealt(spark, folder)
    for name, df in tables.items():
        assert back[name].schema == TABLES[name]
        same(back[name], df)


def test_joins_of_dealt_tables_move_no_rows(spark, dealt, no_broadcast):
    tables, folder = dealt
    docs, items, errors = (stored.read_dealt(spark, folder)[n] for n in TABLES)
    keys = docs.filter("id % 3 = 0").select("id")
    of = keys.withColumnRenamed("id", "document_id")
    queries = {
        "Q5": rp.items_with_document(docs, items), "Q7": rp.items_vs_totals(docs, items), "Q4": rp.extraction_summary(docs, items),
        "C7": lc._replace_children(errors, of, errors.limit(0)), "C11 items": lc.delete_documents(docs, items, errors, keys)[1],
        "C11 errors": lc.delete_documents(docs, items, errors, keys)[2], "C14": lc.load_fields(docs, items),
    }
    for name, df in queries.items():
        assert exchanges(df) == [], name
    same(queries["Q7"], rp.items_vs_totals(tables["documents"], tables["line_items"]))
    same(queries["Q5"], rp.items_with_document(tables["documents"], tables["line_items"]))


def test_more_rows_keep_the_layout(spark, no_broadcast):
    folder = shared_dir(spark, "dealt")
    tables = sample(spark, 50)
    stored.write_dealt({n: df.filter(c(stored.KEYS[n]) <= 25) for n, df in tables.items()}, folder, buckets=4)
    stored.write_dealt({n: df.filter(c(stored.KEYS[n]) > 25) for n, df in tables.items()}, folder, buckets=99)
    back = stored.read_dealt(spark, folder)
    same(rp.items_vs_totals(back["documents"], back["line_items"]), rp.items_vs_totals(tables["documents"], tables["line_items"]))
    assert exchanges(rp.items_vs_totals(back["documents"], back["line_items"])) == []
    with pytest.raises(ValueError):
        stored.read_dealt(spark, shared_dir(spark, "nothing"))


def rows_scanned(df):
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_look_ups_read_few_row_groups(spark):
    n = 40_000
    folder = shared_dir(spark, "clustered")
    stored.write_for_lookups(sample(spark, n), folder, group_bytes=200_000)
    from docaudit.sources.tables import read_tables

    tables = read_tables(spark, folder)
    ids = [5, 20_001, 39_999]
    found = rp.detail_of(tables, ids)
    assert sorted(r.id for r in found["header"].collect()) == ids
    assert found["line_items"].count() == 9 and found["errors"].count() == 6
    assert rows_scanned(tables["documents"].filter(c("id").isin(ids))) < n / 4
    assert rows_scanned(tables["line_items"].filter(c("document_id").isin(ids))) < 3 * n / 4

    import hashlib

    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in (7, 31_234)] + ["new"]
    assert rows_scanned(tables["documents"].filter(c("file_hash").isin(hashes)).select("id", "file_hash")) < n / 4
    incoming = spark.createDataFrame([(i, f"{i}", h, "p") for i, h in enumerate([*hashes, None])], "arrival long, filename string, file_hash string, stored_path string")
    fresh, outcomes = lc.reserve_few(tables["documents"], incoming, NOW, highest=n)
    assert sorted((r.arrival, r.document_id, r.skipped) for r in outcomes.collect()) == [(0, 7, True), (1, 31_234, True), (2, n + 1, False), (3, n + 2, False)]
    want = lc.reserve(tables["documents"], incoming, NOW)
    same(outcomes, want[1])
    with pytest.raises(ValueError):
        rp.detail_of(tables, list(range(2000)))
