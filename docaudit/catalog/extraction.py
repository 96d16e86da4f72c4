"""Registered extraction operators: headers H1-H8, tables P1-P16, layout L1-L6."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import header as hd
from ..operators import layout as lo
from ..operators import tables as tb
from ..operators.lifecycle import assign_positions
from ..session import settled
from .adapters import sql
from .scalars import sql_unescape

c = F.col
ITEM = ["document_id", "position", "description", "quantity", "unit_price", "amount"]


def _render(spark, sf, header, line):
    return fx._render(fx.inv_items_exact(spark, sf), f"concat('{header}', body)", line)


def md_priced(spark, sf):
    return _render(spark, sf, r"| Make/Model | Unit Price |\n|---|---|\n",
                   "concat('| ', description, ' | $ ', cast(amount as decimal(18,2)), ' |')")


def md_spilled(spark, sf):
    return _render(spark, sf, r"| Item # | Ordered Service | Item Price | Total |\n|---|---|---|---|\n",
                   "concat('| ', position, ' ', description, ' | Doors (', cast(quantity as bigint), ') | ',"
                   " cast(unit_price as decimal(18,2)), ' | ', cast(amount as decimal(18,2)), ' |')")


def _typed(docs, no=0):
    """document_id and the typed rows of table `no`."""
    return tb.with_tables(docs).select(
        "document_id", F.get("tables", F.lit(no)).alias("table"))


def _data(docs):
    return _typed(docs).select("document_id", F.slice("table", 2, F.size("table")).alias("table"))


def _mapping_cols(df, m="m"):
    return df.select("document_id", *[c(f"{m}.{k}").cast("long").alias(k) for k in "dptaq"])


def _p1(s, d):
    return tb.explode_table_rows(fx.md_single(s, d)).select(
        "document_id", c("table_no").cast("long").alias("table_no"), c("row_no").cast("long").alias("row_no"),
        F.array_join("cells", "|").alias("cells"))


def _p2(s, d):
    header = F.get(F.get(tb.table_rows(c("markdown")), F.lit(0)), F.lit(0))
    return _mapping_cols(fx.md_numbered(s, d).select("document_id", tb.map_columns(header).alias("m")))


def _p3(s, d):
    rows = _data(fx.md_shifted(s, d)).select("document_id", F.explode_outer(tb.column_shapes(c("table"))).alias("x"))
    return rows.select("document_id", c("x.i").cast("long").alias("i"), c("x.num").alias("num"), c("x.len").alias("len"))


def _p4(s, d):
    rows = _data(fx.md_shifted(s, d)).select("document_id", F.explode_outer(tb.column_shapes(c("table"))).alias("x"))
    return rows.select("document_id", c("x.i").cast("long").alias("i"), c("x.money").alias("money"), c("x.unit").alias("unit"))


def _p5(s, d):
    shapes = _data(fx.md_shifted(s, d)).select("document_id", tb.column_shapes(c("table")).alias("s"))
    return _mapping_cols(shapes.select("document_id", F.explode_outer(tb.candidate_mappings(c("s"))).alias("m")))


def _p6(s, d):
    m = lambda p, a: tb._mapping(d=F.lit(1), p=F.lit(p), a=F.lit(a), q=F.lit(0))
    df = _data(fx.md_shifted(s, d))
    scored = df.select("document_id", tb.score_mapping(c("table"), m(2, 3)).alias("x"), tb.score_mapping(c("table"), m(3, 2)).alias("y"))
    return scored.select("document_id", *[c(k).cast("long").alias(k.replace(".", "_")) for k in ("x.n", "x.ok", "y.n", "y.ok")])


def _p7(s, d):
    df = _typed(fx.md_shifted(s, d))
    named = tb.map_columns(F.transform(F.get("table", F.lit(0))["c"], lambda x: x["t"]))
    return _mapping_cols(df.select("document_id", tb.best_mapping(named, F.slice("table", 2, F.size("table"))).alias("m")))


def _p8(s, d):
    df = _typed(fx.md_paged(s, d), no=1).select("document_id", tb.infer_mapping(c("table")).alias("m"))
    return _mapping_cols(df)


def _p9(s, d):
    return _mapping_cols(_data(md_priced(s, d)).select("document_id", tb.single_amount_mapping(c("table")).alias("m")))


def _plan(s, d):
    planned = tb.with_plan(tb.with_tables(fx.md_paged(s, d)))
    rows = planned.select("document_id", F.posexplode_outer("plan").alias("table_no", "x"))
    return rows.select("document_id", c("table_no").cast("long").alias("table_no"), c("x.header").alias("header"),
                       *[c(f"x.m.{k}").cast("long").alias(k) for k in "dptaq"])


def _items(md):
    return lambda s, d: assign_positions(tb.parse_line_items(md(s, d))).select(*ITEM)


def _raw_items(md):
    return lambda s, d: tb.parse_line_items(md(s, d)).select(*ITEM)


def _p12(s, d):
    """Quantity and price pushed into the description; amount two cells further on."""
    cells = F.array(
        F.expr("concat(description, ' (', cast(quantity as bigint), ') ', cast(unit_price as decimal(18,2)))"),
        F.lit(""), F.expr("cast(cast(amount as decimal(18,2)) as string)"))
    m = tb._mapping(d=F.lit(0), p=F.lit(1), a=F.lit(2))
    rows = fx.inv_items_exact(s, d).select("document_id", "position", tb._typed_row(cells).alias("r"))
    return rows.select("document_id", "position", tb.build_item(c("r.c"), m).alias("x")).select(
        "document_id", "position", c("x.d").alias("description"), c("x.q").alias("quantity"),
        c("x.p").alias("unit_price"), c("x.a").alias("amount"))


def _p13(s, d):
    numbered = tb._mapping(d=F.lit(1), p=F.lit(3), a=F.lit(4), q=F.lit(2))
    plain = tb._mapping(d=F.lit(0), p=F.lit(2), a=F.lit(3), q=F.lit(1))
    found = F.when(c("document_id") % 2 == 0, tb.number_column(c("table"), numbered)).otherwise(tb.number_column(c("table"), plain))
    return _data(fx.md_numbered(s, d)).select("document_id", found.cast("long").alias("i"))


def _p15(s, d):
    pos = F.expr("case when document_id % 3 = 0 and position = 2 then null when document_id % 5 = 0 then 1000 - position"
                 " else position end")
    item = F.struct(pos.alias("pos"), c("description").alias("d"), *[c(x).alias(k) for k, x in
                    (("q", "quantity"), ("p", "unit_price"), ("a", "amount"))], F.lit(None).cast("double").alias("t"))
    docs = fx.inv_items_exact(s, d).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", item.alias("x")))).alias("l"))
    kept = docs.select("document_id", tb.keep_document_numbers(F.transform("l", lambda x: x["x"])).alias("items"))
    return kept.select("document_id", F.posexplode("items").alias("i", "x")).select(
        "document_id", (c("i") + 1).cast("long").alias("place"), c("x.pos").cast("long").alias("position"))


def _fragments(s, d):
    return lo.layout_fragments(fx.layout_scatter(s, d))


def _l2(s, d):
    return lo.row_anchors(lo.with_anchor_numbers(_fragments(s, d))).select(
        "document_id", c("number").cast("long").alias("number"), "anchor_top", c("limit").alias("low"))


def _bands(s, d):
    n = lo.with_anchor_numbers(_fragments(s, d))
    return lo.assign_fragments(n, lo.row_anchors(n))


def _l4(s, d):
    return _bands(s, d).select("document_id", c("number").cast("long").alias("position"), lo.build_layout_item(c("text")).alias("x")).select(
        "document_id", "position", "x.*")


def _l5(s, d):
    docs = settled(fx.layout_scatter(s, d), "documents")
    return lo.recover_missing_items(settled(tb.parse_line_items(docs), "parsed"), docs)[0].select(*ITEM, "ord")


def _l6(s, d):
    docs = settled(fx.layout_scatter(s, d), "documents")
    counts = lo.recover_missing_items(settled(tb.parse_line_items(docs), "parsed"), docs)[1]
    return lo.recovery_issues(counts).select("document_id", "code", "field", "severity", "message")


# --- headers ------------------------------------------------------------------------

def raw_headers(spark, sf):
    """Header answers as the model gives them: strings, blanks and blank words."""
    docs = fx.ground_docs(spark, sf, altered="false")
    text = lambda n: f"coalesce({n}, if(id % 2 = 0, '', ' N/A '))"
    amount = lambda n: f"coalesce({fx._AMOUNT_TEXT.format(x=n)}, '-')"
    fields = ", ".join(
        f"'{n}', " + (amount(n) if n in ("subtotal", "tax", "shipping", "total_amount") else text(n))
        for n in hd.RAW_HEADER.fieldNames())
    return docs.selectExpr("id as document_id", "markdown", f"to_json(named_struct({fields})) as header_json")


def raw_items(spark, sf):
    """Item answers; every third one is cut off inside its last object."""
    obj = ("to_json(named_struct('description', description, 'quantity', cast(cast(quantity as bigint) as string),"
           " 'unit_price', cast(cast(unit_price as decimal(18,2)) as string), 'amount', cast(cast(amount as decimal(18,2)) as string)))")
    rows = fx.inv_items_exact(spark, sf).withColumn("o", F.expr(obj))
    whole = F.concat(F.lit('{"line_items":['), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "o"))), lambda x: x["o"]), ","), F.lit("]}"))
    return rows.groupBy("document_id").agg(whole.alias("j")).selectExpr(
        "document_id", "if(document_id % 3 = 0, left(j, length(j) - 8), j) as items_json")


_H3_CASES = [
    ("Due 30 days after receipt of goods. Invoice No. {id}", "INVOICE"),
    ("Receipt# {id} for invoice no 7", "RECEIPT"),
    ("INVOICE\\n\\npayable upon  receipt", "INVOICE"),
    ("Your receipt and invoice {id}", "RECEIPT"),
    ("Statement {id}", "UNKNOWN"),
    ("세금계산서 {id} 영수증", "INVOICE"),
    ("net 10 on receipt {id}", "UNKNOWN"),
    ("on receipt invoice no {id}. later receipt no 5", "RECEIPT"),
    ("on receipt: invoice # {id}, then invoice", "INVOICE"),
]


def type_texts(spark, sf):
    """The documents' texts, which name no type by themselves, with a phrase that may do so."""
    whens = " ".join(f"when {i} then '{t.replace('{id}', chr(39) + ' || doc_id || ' + chr(39))}'" for i, (t, _) in enumerate(_H3_CASES))
    phrase = f"case doc_id % {len(_H3_CASES)} {whens} end"
    return fx.table(spark, sf, "documents").selectExpr("doc_id", f"concat(text, '\\n', {phrase}, '\\n', left(text, 300)) as markdown")


def headed_pages(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("# "), F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1), F.lit("\n\nbody\n\n# Other\n")).alias("markdown"))


def headed_docs(spark, sf):
    return fx.inv_documents(spark, sf).withColumn(
        "markdown", F.expr("concat(if(id % 2 = 0, '# Acme &amp; Sons ', '# INVOICE '), id, '\\n\\nbody')"))


def probed_docs(spark, sf):
    """Documents with holes, their items and the answers to the probe."""
    items = fx.inv_items_exact(spark, sf)
    top = items.groupBy("document_id").agg(F.max("amount").alias("top"))
    docs = (
        fx.inv_documents(spark, sf)
        .withColumn("currency", F.expr("if(id % 4 = 0, null, currency)"))
        .withColumn("issue_date", F.expr("if(id % 37 = 0, null, issue_date)"))
        .join(top, c("id") == c("document_id")).drop("document_id")
        .withColumn("shown", F.expr("cast(cast(if(id % 2 = 1, top + 100000, top) as decimal(18,2)) as string)"))
        .withColumn("markdown", F.expr(
            "concat('PO: AB-', id, '\\nNo ZZ', id, '\\nDue 30 days\\nTotal ', shown, ' USD\\nSubtotal 0.01')"))
    )
    answers = [("po_number", "concat('AB-', id)"), ("po_number", "'missing in text'"), ("currency", "'USD'"),
               ("currency", "'usd'"), ("subtotal", "'0.01'"), ("total_amount", "shown"), ("issue_date", "'Due 30 days'"),
               ("invoice_number", "' N/A '"), ("vendor_name", "concat('zz', id)"), ("colour", "'PO'")]
    parts = ", ".join(f"named_struct('field', '{f}', 'value', {v})" for f, v in answers)
    findings = docs.selectExpr("id as document_id", f"to_json(named_struct('findings', array({parts}))) as findings_json")
    return docs.drop("top", "shown"), items.withColumn("tax", F.lit(None).cast("double")), findings


def _h6_docs(s, d):
    return hd.apply_probe(*probed_docs(s, d))[0].select(
        "id", "po_number", "currency", "vendor_name", "issue_date", "invoice_number", "subtotal", "total_amount")


def _h6_issues(s, d):
    return hd.apply_probe(*probed_docs(s, d))[1].select("document_id", "code", "field", "severity", "source", "message")


def layered(spark, sf):
    docs = fx.table(spark, sf, "documents").select(c("doc_id").alias("document_id"), c("text").alias("markdown"))
    layer = fx.table(spark, sf, "documents").selectExpr(
        "doc_id as document_id", "concat('/up/', doc_id, if(doc_id % 2 = 0, '.PDF', '.docx')) as path",
        "concat(text, '\\n Invoice 4235-', doc_id, 'q7 \\nab\\n', text, '\\nInvoice  4235-', doc_id, 'q7\\n-----\\n') as raw_text")
    return docs, layer


def _h7(s, d):
    return hd.dropped_text(*layered(s, d)).select("document_id", "line")


def _h8(s, d):
    docs, layer = layered(s, d)
    return hd.augment_markdown(docs, hd.dropped_text(docs, layer)).select("document_id", F.md5("markdown").alias("v"))


QUERIES = {
    "h1_type_header": lambda s, d: hd.type_header(raw_headers(s, d)),
    "h2_type_items": lambda s, d: hd.type_items(raw_items(s, d))[0].drop("position", "tax"),
    "h2_item_issues": lambda s, d: hd.type_items(raw_items(s, d))[1].select("document_id", "code", "severity", "message"),
    "h2b_salvage_objects": lambda s, d: raw_items(s, d).select(
        "document_id", F.size(hd.salvage_objects(c("items_json"))).cast("long").alias("n")),
    "h3_classify_document": lambda s, d: type_texts(s, d).select("doc_id", hd.classify_document(c("markdown")).alias("doc_type")),
    "h4_vendor_from_heading": lambda s, d: headed_pages(s, d).select("page_id", hd.vendor_from_heading(c("markdown")).alias("vendor")),
    "h5_fill_vendor": lambda s, d: hd.fill_vendor(headed_docs(s, d))[0].select("id", "vendor_name"),
    "h5_vendor_issues": lambda s, d: hd.fill_vendor(headed_docs(s, d))[1].select("document_id", "code", "field", "severity"),
    "h6_apply_probe": _h6_docs,
    "h6_probe_issues": _h6_issues,
    "h7_dropped_text": _h7,
    "h8_augment_markdown": _h8,
    "p1_explode_table_rows": _p1,
    "p2_map_columns": _p2,
    "p3_column_shapes": _p3,
    "p4_column_marks": _p4,
    "p5_candidate_mappings": _p5,
    "p6_score_mapping": _p6,
    "p7_best_mapping": _p7,
    "p8_infer_mapping": _p8,
    "p9_single_amount_mapping": _p9,
    "p9_priced_items": _raw_items(md_priced),
    "p10_resolve_fragments": _plan,
    "p10_paged_items": _items(fx.md_paged),
    "p11_merge_spilled_text": _raw_items(md_spilled),
    "p12_build_item": _p12,
    "p13_number_column": _p13,
    "p14_strip_row_numbers": _raw_items(fx.md_numbered),
    "p15_keep_document_numbers": _p15,
    "p16_parse_line_items": _items(fx.md_single),
    "p16_shifted_items": _items(fx.md_shifted),
    "p16_numbered_items": _raw_items(fx.md_numbered),
    "l1_layout_fragments": lambda s, d: _fragments(s, d).drop("fragment").withColumn("page", c("page").cast("long")),
    "l2_row_anchors": _l2,
    "l3_assign_fragments": lambda s, d: _bands(s, d).select("document_id", c("number").cast("long").alias("number"), "text"),
    "l4_build_layout_item": _l4,
    "l5_recover_missing_items": _l5,
    "l6_recovery_issues": _l6,
}

# --- SQL ----------------------------------------------------------------------------

_X = "inv_items_exact"
_N = "SELECT document_id, count(*) AS n FROM inv_items_exact GROUP BY document_id"
_U, _A = "CAST(unit_price AS DECIMAL(18,2))", "CAST(amount AS DECIMAL(18,2))"
_EXACT = sql(f"SELECT {', '.join(ITEM)} FROM inv_items_exact", _X)
_NULLS = "CAST(NULL AS DOUBLE)"
_MISSING = """
    SELECT *, CASE WHEN id % 4 = 0 THEN NULL ELSE currency END AS cur, CASE WHEN id % 37 = 0 THEN NULL ELSE issue_date END AS day,
           CAST(CAST(CASE WHEN id % 2 = 1 THEN top + 100000 ELSE top END AS DECIMAL(18,2)) AS VARCHAR) AS shown
    FROM inv_documents JOIN (SELECT document_id, max(amount) AS top FROM inv_items_exact GROUP BY 1) ON id = document_id"""
_EMPTY = "was empty and filled with"


def _probe(field, where, message, extra=""):
    return (f"SELECT id AS document_id, 'H6' AS code, '{field}' AS field, 'warning' AS severity, 'llm' AS source,"
            f" {message} AS message FROM m WHERE {where}")


_TITLE = f"trim({sql_unescape('h')})"
ORACLES = {
    "h1_type_header": sql(
        """SELECT id AS document_id, CASE WHEN id % 41 <> 0 THEN 'INVOICE' ELSE 'UNKNOWN' END AS doc_type, invoice_number, issue_date,
           due_date, vendor_name, buyer_name, po_number, currency, CAST(CAST(subtotal AS DECIMAL(18,2)) AS DOUBLE) AS subtotal,
           tax, shipping, total_amount FROM inv_documents""", "inv_documents"),
    "h2_type_items": sql(
        """SELECT document_id, position AS ord, description, quantity, unit_price, amount FROM inv_items_exact JOIN t USING (document_id)
           WHERE document_id % 3 <> 0 OR position < n""", _X, t=_N),
    "h2_item_issues": sql(
        """SELECT document_id, 'H2' AS code, 'critical' AS severity, 'the item answer is cut off; ' || (n - 1) || ' items recovered' AS message
           FROM t WHERE document_id % 3 = 0""", _X, t=_N),
    "h2b_salvage_objects": sql("SELECT document_id, CASE WHEN document_id % 3 = 0 THEN n - 1 ELSE n END AS n FROM t", _X, t=_N),
    "h3_classify_document": f"SELECT doc_id, {[k for _, k in _H3_CASES]}[doc_id % {len(_H3_CASES)} + 1] AS doc_type FROM documents",
    "h4_vendor_from_heading": f"""
        SELECT page_id, CASE WHEN length(t) >= 3 AND NOT regexp_matches(t, '(?i)invoice|receipt|bill\\s*to|ship\\s*to|영수증|청구서|세금계산서')
            AND lower(t) NOT IN ('to', 'from', 'comments', 'notes', 'description', 'terms', 'summary', 'details', 'items')
            AND len(regexp_extract_all(t, '\\p{{L}}')) >= 2 AND len(regexp_extract_all(t, '\\p{{L}}')) >= length(replace(t, ' ', '')) * 0.5
            THEN t END AS vendor
        FROM (SELECT page_id, {_TITLE} AS t FROM (SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS h FROM pages))""",
    "h5_fill_vendor": sql(
        "SELECT id, coalesce(vendor_name, CASE WHEN id % 2 = 0 THEN 'Acme & Sons ' || id END) AS vendor_name FROM inv_documents",
        "inv_documents"),
    "h5_vendor_issues": sql(
        """SELECT id AS document_id, 'H5' AS code, 'vendor_name' AS field, 'warning' AS severity FROM inv_documents
           WHERE vendor_name IS NULL AND id % 2 = 0""", "inv_documents"),
    "h6_apply_probe": sql(
        """SELECT id, coalesce(po_number, 'AB-' || id) AS po_number, coalesce(cur, 'usd') AS currency,
                  coalesce(vendor_name, 'zz' || id) AS vendor_name, day AS issue_date, invoice_number, subtotal, total_amount FROM m""",
        "inv_documents", _X, m=_MISSING),
    "h6_probe_issues": sql(
        " UNION ALL ".join([
            _probe("po_number", "po_number IS NULL", f"'po_number {_EMPTY} ''AB-' || id || ''' from the source'"),
            _probe("currency", "cur IS NULL", f"'currency {_EMPTY} ''USD'' from the source'"),
            _probe("currency", "cur IS NULL", f"'currency {_EMPTY} ''usd'' from the source'"),
            _probe("vendor_name", "vendor_name IS NULL", f"'vendor_name {_EMPTY} ''zz' || id || ''' from the source'"),
            _probe("issue_date", "day IS NULL", "'issue_date: the source has ''Due 30 days'', which is no date'"),
            _probe("subtotal", "subtotal IS NULL", "'subtotal is empty, but the source has ''0.01'''"),
            _probe("total_amount", "total_amount IS NULL AND id % 2 = 1", "'total_amount is empty, but the source has ''' || shown || ''''"),
        ]), "inv_documents", _X, m=_MISSING),
    "h7_dropped_text": "SELECT doc_id AS document_id, 'Invoice 4235-' || doc_id || 'q7' AS line FROM documents WHERE doc_id % 2 = 0",
    "h8_augment_markdown": """
        SELECT doc_id AS document_id, md5(CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || chr(10) || '## (레이아웃 밖에서 읽은 텍스트)'
            || chr(10) || chr(10) || 'Invoice 4235-' || doc_id || 'q7' ELSE text END) AS v FROM documents""",
    "p1_explode_table_rows": sql(
        f"""SELECT document_id, 0 AS table_no, 0 AS row_no, 'QUANTITY|DESCRIPTION|UNIT PRICE|TOTAL' AS cells FROM t
            UNION ALL SELECT document_id, 0, position, CAST(quantity AS BIGINT) || '|' || description || '|' || {_U} || '|' || {_A} FROM inv_items_exact
            UNION ALL SELECT document_id, 0, count(*) + 1, '||SUBTOTAL|' || sum({_A}) FROM inv_items_exact GROUP BY document_id""", _X, t=_N),
    "p2_map_columns": sql(
        """SELECT document_id, CASE WHEN document_id % 2 = 0 THEN 1 ELSE 0 END AS d, CASE WHEN document_id % 2 = 0 THEN 3 ELSE 2 END AS p,
           CAST(NULL AS BIGINT) AS t, CASE WHEN document_id % 2 = 0 THEN 4 ELSE 3 END AS a, CASE WHEN document_id % 2 = 0 THEN 2 ELSE 1 END AS q
           FROM n""", _X, n=_N),
    "p3_column_shapes": sql(
        """SELECT document_id, i, i <> 1 AS num, CASE WHEN i = 1 THEN len ELSE 0 END AS len
           FROM (SELECT document_id, sum(length(description)) / count(*) AS len FROM inv_items_exact GROUP BY 1), range(4) r(i)""", _X),
    "p4_column_marks": sql("SELECT document_id, i, i >= 2 AS money, i = 0 AS unit FROM t, range(4) r(i)", _X, t=_N),
    "p5_candidate_mappings": sql(
        """SELECT document_id, 1 AS d, p, CAST(NULL AS BIGINT) AS t, a, q FROM n,
           (VALUES (2, 3, NULL), (2, 3, 0), (3, 2, NULL), (3, 2, 0)) v(p, a, q)""", _X, n=_N),
    "p6_score_mapping": sql(
        """SELECT document_id, count(*) AS x_n, count(*) FILTER (abs(quantity * unit_price - amount) <= 0.02) AS x_ok,
           count(*) AS y_n, count(*) FILTER (abs(quantity * amount - unit_price) <= 0.02) AS y_ok
           FROM inv_items_exact GROUP BY document_id""", _X),
    "p7_best_mapping": sql(
        """SELECT document_id, CASE WHEN n > 1 THEN 1 ELSE 2 END AS d, CASE WHEN n > 1 THEN 2 ELSE 3 END AS p, CAST(NULL AS BIGINT) AS t,
           CASE WHEN n > 1 THEN 3 ELSE 0 END AS a, CASE WHEN n > 1 THEN 0 ELSE 1 END AS q FROM c""", _X, c=_N),
    "p8_infer_mapping": sql(
        """SELECT document_id, CASE WHEN n >= 5 THEN 1 END AS d, CASE WHEN n >= 5 THEN 2 END AS p, CAST(NULL AS BIGINT) AS t,
                  CASE WHEN n >= 5 THEN 3 END AS a, CASE WHEN n >= 5 THEN 0 END AS q FROM c""", _X, c=_N),
    "p9_single_amount_mapping": sql(
        """SELECT document_id, 0 AS d, CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS t, 1 AS a, CAST(NULL AS BIGINT) AS q FROM n""",
        _X, n=_N),
    "p9_priced_items": sql(
        f"""SELECT document_id, CAST(NULL AS INTEGER) AS position, description, {_NULLS} AS quantity, {_NULLS} AS unit_price, amount
            FROM inv_items_exact JOIN t USING (document_id) WHERE n >= 2""", _X, t=_N),
    "p10_resolve_fragments": sql(
        """SELECT document_id, 0 AS table_no, true AS header, 1 AS d, 2 AS p, CAST(NULL AS BIGINT) AS t, 3 AS a, 0 AS q FROM c
           UNION ALL SELECT document_id, 1, false, 1, 2, NULL, 3, 0 FROM c WHERE n > 3""", _X, c=_N),
    "p10_paged_items": _EXACT,
    "p11_merge_spilled_text": sql(
        """SELECT document_id, position, description || ' Doors (' || CAST(quantity AS BIGINT) || ')' AS description, quantity, unit_price, amount
           FROM inv_items_exact""", _X),
    "p12_build_item": sql(
        """SELECT document_id, position, description || ' (' || CAST(quantity AS BIGINT) || ')' AS description, quantity, unit_price, amount
           FROM inv_items_exact""", _X),
    "p13_number_column": sql("SELECT document_id, CASE WHEN n > 1 AND document_id % 2 = 0 THEN 0 END AS i FROM t", _X, t=_N),
    "p15_keep_document_numbers": sql(
        """SELECT document_id, position AS place, CASE WHEN (document_id % 3 = 0 AND n >= 2) OR (document_id % 5 = 0 AND n >= 2) THEN NULL
           WHEN document_id % 5 = 0 THEN 1000 - position ELSE position END AS position FROM inv_items_exact JOIN t USING (document_id)""",
        _X, t=_N),
    "p16_parse_line_items": _EXACT,
    "p16_shifted_items": sql(
        f"""SELECT document_id, position, CASE WHEN n > 1 THEN description ELSE '€ ' || {_U} END AS description,
            CASE WHEN n > 1 THEN quantity END AS quantity, CASE WHEN n > 1 THEN unit_price ELSE amount END AS unit_price,
            CASE WHEN n > 1 THEN amount ELSE quantity END AS amount FROM inv_items_exact JOIN t USING (document_id)""", _X, t=_N),
    "p16_numbered_items": sql(
        """SELECT document_id, CASE WHEN document_id % 2 = 1 OR n > 1 THEN position END AS position, description, quantity, unit_price, amount
           FROM inv_items_exact JOIN t USING (document_id)""", _X, t=_N),
    "l1_layout_fragments": sql(
        f"""SELECT document_id, 1 AS page, CAST(700 - 20 * position AS DOUBLE) AS top, CAST(x AS DOUBLE) AS "left", CASE x WHEN 50 THEN position || '.' WHEN 90 THEN description
            WHEN 300 THEN CAST(quantity AS BIGINT) || ' pcs.' WHEN 400 THEN '€ ' || {_U} ELSE '€ ' || {_A} END AS text
            FROM inv_items_exact, (VALUES (50), (90), (300), (400), (480)) v(x) WHERE position > 2""", _X),
    "l2_row_anchors": sql(
        """SELECT document_id, position AS number, CAST(700 - 20 * position AS DOUBLE) AS anchor_top,
           CAST(700 - 20 * position - CASE WHEN n = 3 THEN 40 ELSE 20 END AS DOUBLE) AS low FROM inv_items_exact JOIN t USING (document_id) WHERE position > 2""",
        _X, t=_N),
    "l3_assign_fragments": sql(
        f"""SELECT document_id, position AS number, position || '. ' || description || ' ' || CAST(quantity AS BIGINT) || ' pcs. € ' || {_U}
            || ' € ' || {_A} AS text FROM inv_items_exact WHERE position > 2""", _X),
    "l4_build_layout_item": sql(
        "SELECT document_id, position, description, quantity, unit_price, amount FROM inv_items_exact WHERE position > 2", _X),
    "l5_recover_missing_items": sql(
        f"""SELECT {', '.join(ITEM)}, ord FROM (
            SELECT * REPLACE (CASE WHEN n > 1 THEN position END AS position), position AS ord FROM inv_items_exact JOIN t USING (document_id))""",
        _X, t=_N),
    "l6_recovery_issues": sql(
        """SELECT document_id, 'L6' AS code, 'line_items' AS field, 'warning' AS severity,
           (n - 2) || ' items lay outside of the tables and were recovered from their position' AS message FROM t WHERE n >= 3""", _X, t=_N),
}
ORACLES["p14_strip_row_numbers"] = ORACLES["p16_numbered_items"]
