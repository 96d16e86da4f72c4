"""The adapters of `fixtures.py` as SQL common table expressions."""

from __future__ import annotations

_ISO = "'%Y-%m-%dT%H:%M:%S+00:00'"

CTES = {
    "billed_lines": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, p_name,
               row_number() OVER (PARTITION BY l_orderkey
                   ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn,
               CAST(l_quantity AS BIGINT) AS q,
               CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS unit_cents
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "inv_line_items": """
        SELECT l_orderkey * 10000000 + rn AS id, l_orderkey AS document_id, CAST(rn AS INTEGER) AS position,
               p_name AS description, CAST(q AS DOUBLE) AS quantity,
               CASE WHEN l_suppkey % 19 <> 0 THEN unit_cents / 100.0::DOUBLE END AS unit_price,
               CASE WHEN l_partkey % 31 <> 0 THEN l_extendedprice END AS amount,
               CAST(NULL AS DOUBLE) AS tax
        FROM billed_lines""",
    "inv_items_exact": """
        SELECT l_orderkey AS document_id, CAST(rn AS INTEGER) AS position,
               p_name AS description, CAST(q AS DOUBLE) AS quantity,
               unit_cents / 100.0::DOUBLE AS unit_price, (q * unit_cents) / 100.0::DOUBLE AS amount
        FROM billed_lines""",
    "inv_documents": f"""
        SELECT o_orderkey AS id, 'invoice-' || o_orderkey || '.pdf' AS filename,
               sha256(CAST(o_orderkey AS VARCHAR)) AS file_hash,
               CASE WHEN o_orderkey % 9 <> 0 THEN
                   CASE WHEN o_orderkey % 10 = 0 THEN '/data/old/' ELSE '/data/uploads/' END || o_orderkey || '.pdf' END AS stored_path,
               status,
               CASE WHEN status = 'FAILED' THEN NULL ELSE status IN ('VALIDATED', 'PENDING') END AS is_valid,
               CAST(1 + o_orderkey % 4 AS INTEGER) AS page_count,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'RECEIPT' ELSE 'INVOICE' END AS doc_type,
               CASE WHEN o_orderkey % 41 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS invoice_number,
               CASE WHEN o_orderkey % 53 = 0 THEN 'bad' WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%d.%m.%Y')
                    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS issue_date,
               CASE WHEN o_orderkey % 59 = 0 THEN 'net 30' ELSE strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 - 5 AS INTEGER), '%Y-%m-%d') END AS due_date,
               CASE WHEN o_orderkey % 29 <> 0 THEN c_name END AS vendor_name,
               c_mktsegment AS buyer_name,
               CASE WHEN o_orderkey % 3 = 0 THEN 'PO-' || o_custkey END AS po_number,
               'USD' AS currency,
               CASE WHEN o_orderkey % 5 <> 0 THEN s + CASE WHEN o_orderkey % 13 = 0 THEN 1.0 ELSE 0.0 END END AS subtotal,
               CASE WHEN o_orderkey % 17 = 0 THEN -1.0::DOUBLE END AS tax,
               CASE WHEN o_orderkey % 17 = 0 THEN 2.5::DOUBLE END AS shipping,
               CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS total_amount,
               'm1' AS model,
               CASE WHEN status = 'FAILED' THEN 'conversion failed: ' || o_orderpriority END AS failure_reason,
               CASE WHEN status = 'VALIDATED' AND o_orderkey % 2 = 0 THEN 'ok ' || o_orderpriority END AS reviewer_note,
               strftime(o_orderdate, {_ISO}) AS created_at,
               strftime(o_orderdate + INTERVAL 1 DAY, {_ISO}) AS updated_at,
               CASE WHEN status = 'VALIDATED' THEN strftime(o_orderdate + INTERVAL 3 DAY, {_ISO}) END AS validated_at
        FROM (SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN 'FAILED' WHEN o_orderstatus = 'F' THEN 'VALIDATED'
                             WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'ERROR' END AS status FROM orders)
        LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (SELECT l_orderkey, CAST(sum(CASE WHEN l_partkey % 31 <> 0
                          THEN CAST(l_extendedprice AS DECIMAL(28,4)) END) AS DOUBLE) AS s
                   FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "inv_errors": f"""
        SELECT event_id AS id, user_id AS document_id, event_type AS field, props AS message,
               CASE WHEN value > 50 THEN 'critical' ELSE 'warning' END AS severity,
               CASE WHEN event_id % 2 = 0 THEN 'rule' ELSE 'llm' END AS source,
               event_id % 3 = 0 AS resolved, strftime(ts, {_ISO}) AS created_at
        FROM events""",
    "inv_uploads": """
        SELECT doc_id AS arrival, source || '.txt' AS filename, sha256(text) AS file_hash,
               '/data/uploads/' || doc_id || '.txt' AS stored_path, length(text) AS size, text
        FROM documents""",
}
_NEEDS = {
    "inv_line_items": ["billed_lines"],
    "inv_items_exact": ["billed_lines"],
}


def sql(body: str, *names: str, **extra: str) -> str:
    """`body` preceded by the adapters it names and by further named subqueries."""
    wanted: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in wanted:
                wanted.append(m)
    parts = [f"{n} AS ({CTES[n]})" for n in wanted] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
