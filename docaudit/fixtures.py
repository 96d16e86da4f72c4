"""Invoice-shaped tables derived from the driver's star schema and texts.

Every adapter here has the same definition in SQL in `catalog/adapters.py`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.dates import parse_date
from .operators.totals import exact_sums


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A driver table; `spread` gives a small file, which is one split, to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def billed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its place in the order and its price in whole cents."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        "cast(l_quantity as bigint) as q",
        "cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint) as unit_cents",
    )
    # the names come first, so that rows move by part once and then stay with their order; they are
    # a list, as a part that comes twice must not count twice in the places
    part = table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.collect_list(F.struct("p_name")).alias("names"))
    named = rows.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")
    # the lines of one order, a key of these tables, are few
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    numbered = named.withColumn("rn", F.row_number().over(order).cast("long"))
    return numbered.select("*", F.inline_outer("names")).drop("names")


def inv_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billed_lines(spark, sf_dir).selectExpr(
        "l_orderkey * 10000000 + rn as id",
        "l_orderkey as document_id",
        "cast(rn as int) as position",
        "p_name as description",
        "cast(q as double) as quantity",
        "case when l_suppkey % 19 <> 0 then unit_cents / 100.0D end as unit_price",
        "case when l_partkey % 31 <> 0 then l_extendedprice end as amount",
        "cast(null as double) as tax",
    )


def inv_items_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose arithmetic holds."""
    return billed_lines(spark, sf_dir).selectExpr(
        "l_orderkey as document_id",
        "cast(rn as int) as position",
        "p_name as description",
        "cast(q as double) as quantity",
        "unit_cents / 100.0D as unit_price",
        "(q * unit_cents) / 100.0D as amount",
    )


def inv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and customer as document headers."""
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "case when l_partkey % 31 <> 0 then l_extendedprice end as amount"
    )
    totals = exact_sums(li, ["l_orderkey"], {"s": F.col("amount")})
    orders = table(spark, sf_dir, "orders", spread=True).join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"),
        "left",
    )
    return (
        orders.join(totals, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .selectExpr(
            "*",
            "case when o_orderkey % 97 = 0 then 'FAILED' when o_orderstatus = 'F' then 'VALIDATED'"
            " when o_orderstatus = 'O' then 'PENDING' else 'ERROR' end as status",
        )
        .selectExpr(
            "o_orderkey as id",
            "concat('invoice-', o_orderkey, '.pdf') as filename",
            "sha2(cast(o_orderkey as string), 256) as file_hash",
            "case when o_orderkey % 9 <> 0 then concat(if(o_orderkey % 10 = 0, '/data/old/', '/data/uploads/'),"
            " o_orderkey, '.pdf') end as stored_path",
            "status",
            "case when status = 'FAILED' then null else status in ('VALIDATED', 'PENDING') end as is_valid",
            "cast(1 + o_orderkey % 4 as int) as page_count",
            "cast(null as string) as markdown",
            "cast(null as string) as docling_json",
            "case when o_orderkey % 23 = 0 then null when o_orderkey % 3 = 0 then 'RECEIPT' else 'INVOICE' end as doc_type",
            "case when o_orderkey % 41 <> 0 then cast(o_orderkey as string) end as invoice_number",
            "case when o_orderkey % 53 = 0 then 'bad' when o_orderkey % 7 = 0 then date_format(o_orderdate, 'dd.MM.yyyy')"
            " else date_format(o_orderdate, 'yyyy-MM-dd') end as issue_date",
            "case when o_orderkey % 59 = 0 then 'net 30' else"
            " date_format(date_add(cast(o_orderdate as date), cast(o_orderkey % 60 - 5 as int)), 'yyyy-MM-dd') end as due_date",
            "case when o_orderkey % 29 <> 0 then c_name end as vendor_name",
            "c_mktsegment as buyer_name",
            "case when o_orderkey % 3 = 0 then concat('PO-', o_custkey) end as po_number",
            "'USD' as currency",
            "case when o_orderkey % 5 <> 0 then s + if(o_orderkey % 13 = 0, 1.0D, 0.0D) end as subtotal",
            "case when o_orderkey % 17 = 0 then -1.0D end as tax",
            "case when o_orderkey % 17 = 0 then 2.5D end as shipping",
            "case when o_orderkey % 11 <> 0 then o_totalprice end as total_amount",
            "'m1' as model",
            "case when status = 'FAILED' then concat('conversion failed: ', o_orderpriority) end as failure_reason",
            "case when status = 'VALIDATED' and o_orderkey % 2 = 0 then concat('ok ', o_orderpriority) end as reviewer_note",
            "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\") as created_at",
            "date_format(o_orderdate + interval 1 day, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\") as updated_at",
            "case when status = 'VALIDATED' then"
            " date_format(o_orderdate + interval 3 day, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\") end as validated_at",
        )
    )


def inv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "user_id as document_id", "event_type as field", "props as message",
        "case when value > 50 then 'critical' else 'warning' end as severity",
        "case when event_id % 2 = 0 then 'rule' else 'llm' end as source",
        "event_id % 3 = 0 as resolved",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\") as created_at",
    )


def inv_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as arrival", "concat(source, '.txt') as filename", "sha2(text, 256) as file_hash",
        "concat('/data/uploads/', doc_id, '.txt') as stored_path", "length(text) as size", "text",
    )


def _render(rows: DataFrame, header: str, line: str) -> DataFrame:
    """One Markdown text per document; a document has a bounded number of rows."""
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda r: r["line"]), "\n"
    )
    return (
        rows.withColumn("line", F.expr(line))
        .groupBy("document_id")
        .agg(body.alias("body"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("total"))
        .withColumn("markdown", F.expr(header))
        .select("document_id", "markdown")
    )


_PLAIN_ROW = (
    "concat('| ', cast(quantity as bigint), ' | ', description, ' | ', cast(unit_price as decimal(18,2)),"
    " ' | ', cast(amount as decimal(18,2)), ' |')"
)


def md_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render(
        inv_items_exact(spark, sf_dir),
        r"concat('# Order ', document_id, '\n\n| QUANTITY | DESCRIPTION | UNIT PRICE | TOTAL |\n|---|---|---|---|\n',"
        r" body, '\n|  |  | SUBTOTAL | ', total, ' |\n\nThank you.\n')",
        _PLAIN_ROW,
    )


def md_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the third go to a second table without a header."""
    return _render(
        inv_items_exact(spark, sf_dir),
        r"concat('| QUANTITY | DESCRIPTION | UNIT PRICE | TOTAL |\n|---|---|---|---|\n', body)",
        rf"concat(if(position = 4, 'page 2\n', ''), {_PLAIN_ROW})",
    )


def md_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names moved by one place; the cells carry their unit or currency."""
    return _render(
        inv_items_exact(spark, sf_dir),
        r"concat('| TOTAL | QUANTITY | DESCRIPTION | UNIT PRICE |\n|---|---|---|---|\n', body)",
        "concat('| ', cast(quantity as bigint), ' pcs. | ', description, ' | € ', cast(unit_price as decimal(18,2)),"
        " ' | € ', cast(amount as decimal(18,2)), ' |')",
    )


def md_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents have an item-number column, odd ones the number before the name."""
    return _render(
        inv_items_exact(spark, sf_dir),
        r"concat(if(document_id % 2 = 0, '| Item # | Description | Qty | Unit Price | Total |\n|---|---|---|---|---|\n',"
        r" '| Description | Qty | Unit Price | Total |\n|---|---|---|---|\n'), body)",
        "concat('| ', position, if(document_id % 2 = 0, ' | ', ' '), description, ' | ', cast(quantity as bigint),"
        " ' | ', cast(unit_price as decimal(18,2)), ' | ', cast(amount as decimal(18,2)), ' |')",
    )


def layout_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows in a numbered table, the later ones scattered as placed fragments."""
    rows = inv_items_exact(spark, sf_dir)
    top = "cast(700 - 20 * position as double)"
    parts = [("concat(position, '.')", 50), ("description", 90), ("concat(cast(quantity as bigint), ' pcs.')", 300),
             ("concat('€ ', cast(unit_price as decimal(18,2)))", 400),
             ("concat('€ ', cast(amount as decimal(18,2)))", 480)]
    frag = ", ".join(
        f"named_struct('text', {t}, 'prov', array(named_struct('page_no', 1, 'bbox', named_struct('t', {top}, 'l', cast({x} as double)))))"
        for t, x in parts
    )
    placed = rows.withColumn("frags", F.expr(f"case when position > 2 then array({frag}) end"))
    ordered = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("position", c))))
    line = F.expr(
        "case when position <= 2 then concat('| ', position, '. | ', description, ' | ', cast(quantity as bigint), ' | ',"
        " cast(unit_price as decimal(18,2)), ' | ', cast(amount as decimal(18,2)), ' |') end"
    )
    return (
        placed.withColumn("line", line)
        .groupBy("document_id")
        .agg(F.count("*").alias("n"), ordered("line").alias("lines"), ordered("frags").alias("frags"))
        .selectExpr(
            "document_id",
            r"concat('| Item # | Description | Qty | Unit Price | Total |\n|---|---|---|---|---|\n',"
            r" array_join(transform(lines, x -> x.line), '\n')) as markdown",
            "to_json(named_struct('texts', flatten(transform(frags, x -> x.frags)))) as docling_json",
        )
    )


def rule_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inv_line_items with more holes, some negative quantities and row taxes; every ninth document
    has lost its quantity and price columns into the description."""
    return inv_line_items(spark, sf_dir).selectExpr(
        "id", "document_id", "position", "cast(position as bigint) as ord",
        "if(document_id % 9 = 0, concat(description, ' 5 pcs. € 2'), description) as description",
        "case when document_id % 9 = 0 or unit_price is null and document_id % 2 = 0 then null"
        " when position % 7 = 0 then -quantity else quantity end as quantity",
        "if(document_id % 9 = 0, null, unit_price) as unit_price", "amount",
        "case when document_id % 4 = 0 then 1.25D end as tax",
    )


def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text lists their item numbers; every seventh goes on for two more rows."""
    counts = inv_line_items(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("k"))
    text = (
        "array_join(transform(sequence(1, cast(k as int) + if(document_id % 7 = 0, 2, 0)),"
        " i -> concat('| ', i, '. | row |')), '\n') as listed"
    )
    return (
        inv_documents(spark, sf_dir)
        .join(counts.selectExpr("document_id", text), F.col("id") == F.col("document_id"), "left")
        .withColumn("markdown", F.col("listed"))
        .drop("document_id", "listed")
    )


def collapsed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth document has lost its quantity and price columns into the description."""
    return inv_items_exact(spark, sf_dir).selectExpr(
        "document_id", "position", "cast(position as bigint) as ord",
        "case when document_id % 4 = 0 and position % 3 <> 0 then concat(description, ' ', cast(quantity as bigint), ' pcs. € ',"
        " cast(unit_price as decimal(18,2))) else description end as description",
        "case when document_id % 4 <> 0 then quantity end as quantity",
        "case when document_id % 4 <> 0 then unit_price end as unit_price",
        "amount", "cast(null as double) as tax",
    )


def numbered_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose rows carry item numbers."""
    return _render(
        inv_items_exact(spark, sf_dir),
        r"concat('| No | Item |\n|---|---|\n', body)",
        "concat('| ', position, '. | ', description, ' |')",
    ).withColumnRenamed("document_id", "id")


def first_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three items per document; every fifth document lacks its second one."""
    return inv_items_exact(spark, sf_dir).filter(
        "position <= 3 and not (document_id % 5 = 0 and position = 2)"
    ).selectExpr("*", "cast(position as bigint) as ord", "cast(null as double) as tax")


_AMOUNT_TEXT = (
    "case when {x} is null then null when id % 3 = 0 then format_string('%,.2f', {x}) when id % 3 = 1 then translate(format_string('%,.2f', {x}), ',.', '.,')"
    " else cast(cast({x} as decimal(18,2)) as string) end"
)
_DATE_TEXT = (
    "case id % 4 when 0 then {x} when 1 then date_format({d}, 'dd/MM/yyyy') when 2 then date_format({d}, 'MMM dd, yyyy')"
    " else date_format({d}, \"y'년' M'월' d'일'\") end"
)


def ground_docs(spark: SparkSession, sf_dir: str, altered: str = "id % 2 = 1") -> DataFrame:
    """Documents whose text spells their values in varied ways; some headers are altered.

    `altered` says for which documents the header no longer agrees with the text.
    """
    text = [
        "concat('Invoice No. ', invoice_number)",
        "concat('P.O.   ', lower(po_number))",
        "concat('# ', upper(vendor_name))",
        "concat('To: ', initcap(buyer_name))",
        f"concat('Date: ', coalesce({_DATE_TEXT.format(x='issue_date', d='d1')}, issue_date))",
        f"concat('Due: ', {_DATE_TEXT.format(x='due_date', d='d2')})",
        *[f"concat('{n}: $', {_AMOUNT_TEXT.format(x=n)})" for n in ("subtotal", "tax", "shipping", "total_amount")],
    ]
    docs = (
        inv_documents(spark, sf_dir)
        .withColumn("d1", parse_date(F.col("issue_date")))
        .withColumn("d2", parse_date(F.col("due_date")))
        .withColumn("markdown", F.expr(f"concat_ws('\\n', {', '.join(text)})"))
    )
    change = {
        "invoice_number": "concat(invoice_number, '-X')",
        "po_number": "concat(po_number, '9X')",
        "vendor_name": "if(id % 4 = 1, concat(vendor_name, ', 12 Main Street'), concat('Zz ', vendor_name))",
        "buyer_name": "concat('Acme ', buyer_name)",
        "issue_date": "if(issue_date = 'bad', 'Due after 30 days', date_format(d1 + interval 400 days, 'yyyy-MM-dd'))",
        "due_date": "date_format(d2 + interval 400 days, 'yyyy-MM-dd')",
        **{n: f"{n} + 1000.01D" for n in ("subtotal", "tax", "shipping", "total_amount")},
    }
    return docs.selectExpr(
        *[f"if({altered}, {change[x]}, {x}) as {x}" if x in change else x for x in docs.columns if x not in ("d1", "d2")]
    )
