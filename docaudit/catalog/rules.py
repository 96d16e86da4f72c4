"""Registered rules R1-R18, verdicts V1-V4 and grounding G1-G4."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import grounding as g
from ..operators import rules as r
from ..operators.issues import dedupe_issues
from ..session import settled
from .adapters import sql
from .scalars import SQL_DATE, SQL_SPELLINGS

c = F.col
AS_OF = "1997-01-01"
D = fx.inv_documents
I = fx.rule_items
OUT = ["document_id", "code", "field", "severity", "source"]


def _rule(code):
    return lambda s, d: r.one_rule(code, D(s, d), I(s, d), AS_OF).select(*OUT)


def _verdict_counts(df):
    return df.groupBy("status", "is_valid").agg(
        F.count("*").alias("n"), F.sum("error_count").alias("errors"), F.sum("critical_count").alias("criticals")
    )


def _r18_status(s, d):
    docs = fx.listed_documents(s, d)
    checked = r.verdicts(docs, r.rule_check(docs, I(s, d), AS_OF))
    return r.assign_status(checked)


def _repeated(s, d):
    """Stored errors as issues, every one reported again a stage later."""
    e = fx.inv_errors(s, d).select(
        "document_id", F.lit(1).alias("stage"), F.lit(1).alias("rule"), c("id").alias("row"), F.lit("E").alias("code"),
        "field", F.concat(F.lit(" "), c("severity"), F.lit(" ")).alias("message"), "severity", "source",
    )
    return e.unionByName(e.withColumn("stage", F.lit(2)).withColumn("message", c("severity")))


def _kept(s, d):
    return g.drop_ungrounded(fx.ground_docs(s, d))[0].select("id", *[n for n, k in g.KINDS.items()])


def _dropped(s, d):
    return g.drop_ungrounded(fx.ground_docs(s, d))[1].select("document_id", "code", "field", "severity")


def _appears(s, d):
    docs = fx.ground_docs(s, d)
    hay = g.normalize(c("markdown"))
    cols = [F.coalesce(g.appears_in(hay, c(n), k), F.lit(False)).alias(n)
            for n, k in (("invoice_number", "text"), ("due_date", "date"), ("total_amount", "number"))]
    return docs.select("id", *cols)


def _collapsed(s, d):
    items = fx.collapsed_items(s, d)
    return r.collapsed_columns(items, r.item_totals(items)).select(*OUT, "message")


def _truncated(s, d):
    items = fx.first_items(s, d)
    # every eleventh source goes on for 300 numbers more
    more = F.expr("if(id % 11 = 0, array_join(transform(sequence(1, 300), i -> concat('\n| ', k + i, '. | x |')), ''), '')")
    last = fx.inv_items_exact(s, d).groupBy("document_id").agg(F.max("position").alias("k"))
    docs = fx.numbered_source(s, d).join(last, c("id") == c("document_id")).withColumn("markdown", F.concat("markdown", more))
    return r.truncated_items(docs.select("id", "markdown"), items, r.item_totals(items)).select(*OUT, "message")


def _validated(s, d):
    # the rules read documents and items several times each
    docs, items = settled(fx.ground_docs(s, d), "documents"), settled(I(s, d), "items")
    return r.assign_status(r.verdicts(docs, r.validate(docs, items, AS_OF)))


QUERIES = {f"r{n}_rule": _rule(f"R{n}") for n in (1, 2, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14, 15, 16, 17)}
QUERIES |= {
    "r7_collapsed_columns": _collapsed,
    "r9_truncated_items": _truncated,
    "r18_rule_check": lambda s, d: r.rule_check(fx.listed_documents(s, d), I(s, d), AS_OF).select(*OUT, "message").withColumn(
        "message", F.when(c("code").isin("R7", "R9"), c("message"))),
    "v1_dedupe_issues": lambda s, d: dedupe_issues(_repeated(s, d)).select("document_id", "stage", "row", "field", "severity"),
    "v2_validate": lambda s, d: r.validate(fx.ground_docs(s, d), I(s, d), AS_OF).select(*OUT),
    "v2_verdicts": _validated,
    "v3_revalidate": lambda s, d: r.revalidate(fx.listed_documents(s, d), I(s, d), AS_OF).groupBy("code", "severity").agg(
        F.count("*").alias("n")),
    "v4_assign_status": _r18_status,
    "v4_status_summary": lambda s, d: _verdict_counts(_r18_status(s, d)),
    "g1_appears_in": _appears,
    "g2_grounding_check": lambda s, d: g.grounding_check(fx.ground_docs(s, d)).select("document_id", "code", "field", "severity"),
    "g3_kept_values": _kept,
    "g3_dropped_values": _dropped,
    "g4_grounding_report": lambda s, d: g.grounding_report(
        fx.ground_docs(s, d, altered="false"), fx.ground_docs(s, d, altered="true")),
}

# --- SQL ----------------------------------------------------------------------------

_ITEMS = """
    SELECT id, document_id, position,
           CASE WHEN document_id % 9 = 0 THEN description || ' 5 pcs. € 2' ELSE description END AS description,
           CASE WHEN document_id % 9 = 0 OR unit_price IS NULL AND document_id % 2 = 0 THEN NULL
                WHEN position % 7 = 0 THEN -quantity ELSE quantity END AS quantity,
           CASE WHEN document_id % 9 <> 0 THEN unit_price END AS unit_price, amount, CASE WHEN document_id % 4 = 0 THEN 1.25::DOUBLE END AS tax FROM inv_line_items"""
TOTALS = """
    SELECT document_id, count(*) AS n, count(*) FILTER (quantity IS NOT NULL AND unit_price IS NOT NULL) AS priced,
           coalesce(CAST(sum(CAST(amount AS DECIMAL(28,4))) AS DOUBLE), 0) AS amounts,
           coalesce(CAST(sum(CAST(tax AS DECIMAL(28,4))) AS DOUBLE), 0) AS taxes
    FROM items GROUP BY document_id"""
HEADS = f"""
    SELECT d.*, coalesce(n, 0) AS n, priced, coalesce(amounts, 0) AS amounts,
           coalesce(tax, CASE WHEN coalesce(taxes, 0) <> 0 THEN taxes END, 0) AS eff_tax,
           {SQL_DATE.format(t='issue_date')} AS d1, {SQL_DATE.format(t='due_date')} AS d2
    FROM {{docs}} d LEFT JOIN totals ON document_id = id"""


def _head(code, field, severity, where):
    sev = severity if severity.startswith("CASE") else f"'{severity}'"
    return f"SELECT id AS document_id, '{code}' AS code, '{field}' AS field, {sev} AS severity, 'rule' AS source FROM heads WHERE {where}"


def _row(code, severity, where):
    return (f"SELECT i.document_id, '{code}' AS code, 'line_items[' || position || ']' AS field, '{severity}' AS severity,"
            f" 'rule' AS source FROM items i JOIN totals t ON i.document_id = t.document_id WHERE {where}")


_BARE = "subtotal IS NULL AND tax IS NULL AND shipping IS NULL"
RULES = {
    1: " UNION ALL ".join(_head("R1", f, "critical", f"coalesce({f}, '') = ''") for f in ("invoice_number", "issue_date", "vendor_name")),
    2: _head("R2", "issue_date", "critical", "coalesce(issue_date, '') <> '' AND d1 IS NULL"),
    3: _head("R3", "due_date", "critical", "coalesce(due_date, '') <> '' AND d2 IS NULL"),
    4: _head("R4", "due_date", "critical", "d2 < d1"),
    5: _head("R5", "issue_date", "warning", f"d1 > DATE '{AS_OF}'"),
    6: _head("R6", "line_items", "critical", "n > 0 AND abs(amounts - subtotal) > 0.02"),
    7: "SELECT document_id, 'R7' AS code, 'line_items' AS field, 'critical' AS severity, 'rule' AS source FROM items"
       " WHERE document_id % 9 = 0 GROUP BY document_id",
    8: _head("R8", "total_amount", "CASE WHEN priced = 0 THEN 'critical' ELSE 'warning' END",
             f"n > 0 AND {_BARE} AND total_amount IS NULL"),
    10: _row("R10", "critical", "amount IS NULL"),
    11: _row("R11", "warning", "amount IS NOT NULL AND (quantity IS NULL) <> (unit_price IS NULL)"),
    12: _row("R12", "warning", "amount IS NOT NULL AND quantity IS NULL AND unit_price IS NULL AND priced >= greatest(2, n // 2)"),
    13: _row("R13", "critical", "abs(quantity * unit_price - amount) > 0.02"),
    14: _row("R14", "critical", "amount IS NOT NULL AND unit_price IS NOT NULL AND quantity <= 0"),
    15: _head("R15", "total_amount", "critical",
              "abs(subtotal + eff_tax + coalesce(shipping, 0) - total_amount) > 0.02"),
    16: _head("R16", "total_amount", "warning", f"n > 0 AND {_BARE} AND abs(amounts - total_amount) > 0.02"),
    17: " UNION ALL ".join(_head("R17", f, "critical", f"{f} < 0") for f in ("subtotal", "tax", "shipping", "total_amount")),
}
_ALL = " UNION ALL ".join(RULES.values())
_ALL_LISTED = _ALL + " UNION ALL " + _head("R9", "line_items", "critical", "n > 0 AND id % 7 = 0")
_MESSAGES = """
    SELECT 'R7' AS code, document_id, 'quantity and price stand in the description of items '
           || array_to_string(list_sort(list(position))[:5], ', ')
           || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END
           || ' (such as ''' || left(arg_min(description, position), 60) || ''')' AS message
    FROM items GROUP BY document_id
    UNION ALL
    SELECT 'R9', document_id, n || ' items read, the source goes on to number ' || (n + 2) || ': 2 rows (' || (n + 1) || '-'
           || (n + 2) || ') are missing' FROM totals"""


def _with(body, heads_of="inv_documents", **extra):
    return sql(body, "inv_documents", "inv_line_items", items=_ITEMS, totals=TOTALS, **extra, heads=HEADS.format(docs=heads_of))


# documents with texts (see fixtures.ground_docs)
def _amount_text(x):
    return (f"CASE id % 3 WHEN 0 THEN format('{{:,.2f}}', {x}) WHEN 1 THEN translate(format('{{:,.2f}}', {x}), ',.', '.,')"
            f" ELSE CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR) END")


def _date_text(x, d):
    return (f"CASE id % 4 WHEN 0 THEN {x} WHEN 1 THEN strftime({d}, '%d/%m/%Y') WHEN 2 THEN strftime({d}, '%b %d, %Y')"
            f" ELSE strftime({d}, '%Y년 %-m월 %-d일') END")


_TEXT = f"""
    SELECT *, concat_ws(chr(10), 'Invoice No. ' || invoice_number, 'P.O.   ' || lower(po_number), '# ' || upper(vendor_name),
        'To: ' || upper(left(buyer_name, 1)) || lower(substr(buyer_name, 2)),
        'Date: ' || coalesce({_date_text('issue_date', 'd1')}, issue_date), 'Due: ' || {_date_text('due_date', 'd2')},
        {', '.join(f"'{n}: $' || {_amount_text(n)}" for n in ('subtotal', 'tax', 'shipping', 'total_amount'))}) AS markdown
    FROM (SELECT *, {SQL_DATE.format(t='issue_date')} AS d1, {SQL_DATE.format(t='due_date')} AS d2 FROM inv_documents)"""
_CHANGE = {
    "invoice_number": "invoice_number || '-X'",
    "po_number": "po_number || '9X'",
    "vendor_name": "CASE WHEN id % 4 = 1 THEN vendor_name || ', 12 Main Street' ELSE 'Zz ' || vendor_name END",
    "buyer_name": "'Acme ' || buyer_name",
    "issue_date": "CASE WHEN issue_date = 'bad' THEN 'Due after 30 days' ELSE strftime(d1 + 400, '%Y-%m-%d') END",
    "due_date": "strftime(d2 + 400, '%Y-%m-%d')",
    **{n: f"{n} + 1000.01::DOUBLE" for n in ("subtotal", "tax", "shipping", "total_amount")},
}


def _ground(altered):
    changed = ", ".join(f"CASE WHEN {altered} THEN {e} ELSE {n} END AS {n}" for n, e in _CHANGE.items())
    return f"SELECT * EXCLUDE (d1, d2) REPLACE ({changed}) FROM (SELECT * FROM texts)"


def _forms(name, kind):
    if kind == "text":
        return f"[lower({name})]"
    if kind == "date":
        day = SQL_DATE.format(t=name)
        spelled = SQL_SPELLINGS.replace("(d,", f"({day},")
        return f"CASE WHEN {day} IS NULL THEN [lower({name})] ELSE list_transform({spelled}, lambda s: lower(s)) END"
    x = name
    base = (f"list_filter([format('{{:.2f}}', {x}), format('{{:,.2f}}', {x}), printf('%g', {x}),"
            f" CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) END,"
            f" CASE WHEN {x} = floor({x}) THEN format('{{:,}}', CAST({x} AS BIGINT)) END], lambda s: s IS NOT NULL)")
    return f"list_concat({base}, list_transform({base}, lambda s: translate(s, ',.', '.,')))"


def _fields(docs):
    return " UNION ALL ".join(
        f"""SELECT id, hay, '{n}' AS field, '{k}' AS kind, CAST({n} AS VARCHAR) AS value, {_forms(n, k)} AS forms,
            {'(' + SQL_DATE.format(t=n) + ') IS NULL' if k == 'date' else 'false'} AS no_date
            FROM (SELECT *, lower(regexp_replace(markdown, '\\s+', ' ', 'g')) AS hay FROM {docs}) WHERE coalesce(CAST({n} AS VARCHAR), '') <> ''"""
        for n, k in g.KINDS.items())


_FOUND = "SELECT *, len(list_filter(forms, lambda s: contains(hay, s))) > 0 AS found FROM fields"
_JUDGED = """
    SELECT *, CASE WHEN found AND no_date THEN 'G3_NOT_A_DATE' WHEN found THEN NULL
        WHEN kind = 'text' AND head <> '' AND head <> value AND contains(hay, lower(head)) THEN 'G3_FIRST_PART'
        ELSE 'G3_NOT_FOUND' END AS code
    FROM (SELECT *, trim(regexp_split_to_array(value, '[\\n,]')[1]) AS head FROM found)"""
_GD = dict(texts=_TEXT, docs=_ground("id % 2 = 1"), fields=_fields("docs"), found=_FOUND)
_G2 = "SELECT id AS document_id, 'G2' AS code, field, 'critical' AS severity, 'rule' AS source FROM found WHERE NOT found"
_ISSUES_GD = f"SELECT DISTINCT * FROM ({_ALL} UNION ALL {_G2})"
_VERDICT = """
    SELECT id AS document_id, coalesce(cr, 0) = 0 AS is_valid, coalesce(k, 0) AS error_count, coalesce(cr, 0) AS critical_count,
           CASE WHEN coalesce(cr, 0) = 0 THEN 'PENDING' ELSE 'ERROR' END AS status
    FROM {docs} LEFT JOIN (SELECT document_id, count(*) AS k, count(*) FILTER (severity = 'critical') AS cr
                           FROM issues GROUP BY 1) ON document_id = id"""

ORACLES = {f"r{n}_rule": _with(q) for n, q in RULES.items() if n != 7}
ORACLES |= {
    "r7_collapsed_columns": sql(
        """SELECT document_id, 'R7' AS code, 'line_items' AS field, 'critical' AS severity, 'rule' AS source,
                  'quantity and price stand in the description of items ' || array_to_string(list_sort(list(position))[:5], ', ')
                  || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END
                  || ' (such as ''' || left(arg_min(d, position), 60) || ''')' AS message
           FROM (SELECT *, description || ' ' || CAST(quantity AS BIGINT) || ' pcs. € ' || CAST(unit_price AS DECIMAL(18,2)) AS d
                 FROM inv_items_exact WHERE document_id % 4 = 0 AND position % 3 <> 0) GROUP BY document_id""",
        "inv_items_exact"),
    "r9_truncated_items": sql(
        """SELECT document_id, 'R9' AS code, 'line_items' AS field, 'critical' AS severity, 'rule' AS source,
                  n || ' items read, the source goes on to number ' || last || ': ' || (last - n) || ' rows (' || (n + 1) || '-'
                  || last || ') are missing' AS message
           FROM (SELECT document_id, max(position) + CASE WHEN document_id % 11 = 0 THEN 300 ELSE 0 END AS last, max(position) AS k,
                        CASE WHEN document_id % 5 = 0 THEN 1 ELSE least(3, max(position)) END AS n
                 FROM inv_items_exact GROUP BY document_id)
           WHERE last > n AND (document_id % 5 <> 0 OR k <= 2)""",
        "inv_items_exact"),
    "r18_rule_check": _with(
        f"SELECT a.*, message FROM ({_ALL_LISTED}) a LEFT JOIN ({_MESSAGES}) m ON m.code = a.code AND m.document_id = a.document_id"),
    "v1_dedupe_issues": sql(
        """SELECT document_id, 1 AS stage, min(id) AS "row", field, severity FROM inv_errors
           GROUP BY document_id, field, severity""", "inv_errors"),
    "v2_validate": _with(_ISSUES_GD, heads_of="docs", **_GD),
    "v2_verdicts": _with(_VERDICT.format(docs="docs").replace("FROM issues", f"FROM ({_ISSUES_GD})"), heads_of="docs", **_GD),
    "v3_revalidate": _with(f"SELECT code, severity, count(*) AS n FROM ({_ALL_LISTED}) GROUP BY ALL"),
    "v4_assign_status": _with(_VERDICT.format(docs="inv_documents").replace("FROM issues", f"FROM ({_ALL_LISTED})")),
    "v4_status_summary": _with(
        "SELECT status, is_valid, count(*) AS n, sum(error_count) AS errors, sum(critical_count) AS criticals FROM ("
        + _VERDICT.format(docs="inv_documents").replace("FROM issues", f"FROM ({_ALL_LISTED})") + ") GROUP BY status, is_valid"),
    "g1_appears_in": sql(
        """SELECT id, coalesce(max(found) FILTER (field = 'invoice_number'), false) AS invoice_number,
                  coalesce(max(found) FILTER (field = 'due_date'), false) AS due_date,
                  coalesce(max(found) FILTER (field = 'total_amount'), false) AS total_amount
           FROM docs LEFT JOIN found USING (id) GROUP BY id""", "inv_documents", **_GD),
    "g2_grounding_check": sql(
        "SELECT id AS document_id, 'G2' AS code, field, 'critical' AS severity FROM found WHERE NOT found", "inv_documents", **_GD),
    "g3_kept_values": sql(
        "SELECT d.id, " + ", ".join(
            f"CASE WHEN max(j.code) FILTER (j.field = '{n}') IS NULL THEN any_value(d.{n})"
            + (f" WHEN max(j.code) FILTER (j.field = '{n}') = 'G3_FIRST_PART' THEN max(j.head) FILTER (j.field = '{n}')" if k == "text" else "")
            + f" END AS {n}" for n, k in g.KINDS.items())
        + " FROM docs d LEFT JOIN judged j ON j.id = d.id GROUP BY d.id", "inv_documents", **_GD, judged=_JUDGED),
    "g3_dropped_values": sql(
        "SELECT id AS document_id, code, field, 'warning' AS severity FROM judged WHERE code IS NOT NULL",
        "inv_documents", **_GD, judged=_JUDGED),
    "g4_grounding_report": sql(
        """SELECT mutated, count(*) AS n_values, count(*) FILTER (NOT found) AS flagged
           FROM (SELECT false AS mutated, len(list_filter(forms, lambda s: contains(hay, s))) > 0 AS found FROM f0
                 UNION ALL SELECT true, len(list_filter(forms, lambda s: contains(hay, s))) > 0 FROM f1) GROUP BY mutated""",
        "inv_documents", texts=_TEXT, d0=_ground("false"), d1=_ground("true"), f0=_fields("d0"), f1=_fields("d1")),
}
