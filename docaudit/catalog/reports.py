"""Registered report queries Q2-Q21."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.fixed_values import STATUS_LABELS
from ..plans import reports as rp
from .adapters import sql

D = fx.inv_documents
I = fx.inv_line_items
E = fx.inv_errors


def _outcomes(spark, sf):
    return D(spark, sf).select(
        (F.col("id") % 8 == 0).alias("skipped"),
        F.when(F.col("id") % 101 == 0, "PROCESSING").otherwise(F.col("status")).alias("status"),
    )


def _jobs(spark, sf):
    return D(spark, sf).selectExpr(
        "concat('job-', id) as job_id", "'RUNNING' as state", "filename", "created_at as started_at"
    )


def _job_outcomes(spark, sf):
    return D(spark, sf).filter("id % 19 <> 0").selectExpr(
        "concat('job-', id) as job_id", "id as document_id", "status", "cast(id % 4 as int) as error_count",
        "id % 8 = 0 as skipped", "if(id % 8 = 0, concat('already stored as #', id), '') as message",
    )


def _files(spark, sf):
    return fx.inv_uploads(spark, sf).selectExpr("arrival", "filename as name", "size")


QUERIES = {
    "q2_document_list": lambda s, d: rp.document_list(D(s, d)),
    "q2_document_list_pending": lambda s, d: rp.document_list(D(s, d), "PENDING"),
    "q3_status_counts": lambda s, d: rp.status_counts(D(s, d)),
    "q4_extraction_summary": lambda s, d: rp.extraction_summary(D(s, d), I(s, d)),
    "q5_items_with_document": lambda s, d: rp.items_with_document(D(s, d), I(s, d)),
    "q6_arithmetic_mismatches": lambda s, d: rp.arithmetic_mismatches(D(s, d), I(s, d)),
    "q7_items_vs_totals": lambda s, d: rp.items_vs_totals(D(s, d), I(s, d)),
    "q8_open_errors": lambda s, d: rp.open_errors(D(s, d), E(s, d)),
    "q9_error_statistics": lambda s, d: rp.error_statistics(E(s, d)),
    "q10_review_history": lambda s, d: rp.review_history(D(s, d), E(s, d)),
    "q11_vendor_summary": lambda s, d: rp.vendor_summary(D(s, d)),
    "q12_failures": lambda s, d: rp.failures(D(s, d)),
    "q13_open_error_counts": lambda s, d: rp.open_error_counts(E(s, d)),
    "q14_numbered_list": lambda s, d: rp.numbered_list(D(s, d), E(s, d)),
    "q14_newest_fifty_pending": lambda s, d: rp.numbered_list(D(s, d), E(s, d), "PENDING", 50),
    "q15_document_detail": lambda s, d: rp.document_detail(D(s, d), I(s, d), E(s, d))["header"],
    "q15_detail_errors": lambda s, d: rp.document_detail(D(s, d), I(s, d), E(s, d))["errors"],
    "q15_detail_items": lambda s, d: rp.document_detail(D(s, d), I(s, d), E(s, d))["line_items"],
    "q17_review_queue": lambda s, d: rp.review_queue(D(s, d)),
    "q17_review_queue_counts": lambda s, d: rp.review_queue_counts(D(s, d)),
    "q18_run_summary": lambda s, d: rp.run_summary(_outcomes(s, d)),
    "q19_job_list": lambda s, d: rp.job_list(rp.finish_jobs(_jobs(s, d), _job_outcomes(s, d), "2026-01-01T00:00:00+00:00")),
    "q20_record_as_pairs": lambda s, d: rp.record_as_pairs(D(s, d)),
    "q21_new_files": lambda s, d: rp.new_files(
        _files(s, d).filter("arrival % 2 = 0"), _files(s, d).filter("arrival % 2 = 1")
    ),
}

_LIST = "id, filename, status, is_valid, page_count, model, failure_reason, created_at, updated_at, validated_at"
_LABEL = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_LABELS.items()) + " ELSE status END"
_HEADER_TEXT = "doc_type invoice_number issue_date due_date vendor_name buyer_name po_number currency".split()
_HEADER_NUM = "subtotal tax shipping total_amount".split()
_COUNTS = """
    LEFT JOIN (SELECT document_id AS id, count(*) AS line_item_count FROM inv_line_items GROUP BY 1) USING (id)
    LEFT JOIN (SELECT document_id AS id, count(*) AS error_count, count(*) FILTER (NOT resolved) AS open_error_count
               FROM inv_errors GROUP BY 1) USING (id)"""
# a double as text reads alike on both engines after whole cents: 1234.5, never in exponent form below 10^7
_AS_TEXT = "CAST({c} AS VARCHAR)"

ORACLES = {
    "q2_document_list": sql(f"SELECT {_LIST} FROM inv_documents", "inv_documents"),
    "q2_document_list_pending": sql(f"SELECT {_LIST} FROM inv_documents WHERE status = 'PENDING'", "inv_documents"),
    "q3_status_counts": sql("SELECT status, count(*) AS n FROM inv_documents GROUP BY status", "inv_documents"),
    "q4_extraction_summary": sql(
        """SELECT id, filename, invoice_number, issue_date, vendor_name, buyer_name, subtotal, tax, total_amount,
           (SELECT count(*) FROM inv_line_items i WHERE i.document_id = d.id) AS item_count FROM inv_documents d""",
        "inv_documents", "inv_line_items"),
    "q5_items_with_document": sql(
        """SELECT d.id, d.filename, i.position, i.description, i.quantity, i.unit_price, i.amount
           FROM inv_line_items i JOIN inv_documents d ON d.id = i.document_id""", "inv_documents", "inv_line_items"),
    "q6_arithmetic_mismatches": sql(
        """SELECT d.id, d.filename, i.position, i.description, i.quantity, i.unit_price,
                  i.quantity * i.unit_price AS computed, i.amount AS stated,
                  abs(i.quantity * i.unit_price - i.amount) AS difference
           FROM inv_line_items i JOIN inv_documents d ON d.id = i.document_id
           WHERE abs(i.quantity * i.unit_price - i.amount) > 0.02""", "inv_documents", "inv_line_items"),
    "q7_items_vs_totals": sql(
        """SELECT d.id, d.filename, d.subtotal, d.tax, d.shipping, d.total_amount,
                  CAST(sum(CAST(i.amount AS DECIMAL(28,4))) AS DOUBLE) AS item_sum,
                  d.total_amount - (coalesce(d.subtotal, 0) + coalesce(d.tax, 0) + coalesce(d.shipping, 0)) AS difference
           FROM inv_documents d LEFT JOIN inv_line_items i ON i.document_id = d.id
           GROUP BY d.id, d.filename, d.subtotal, d.tax, d.shipping, d.total_amount""",
        "inv_documents", "inv_line_items"),
    "q8_open_errors": sql(
        """SELECT d.id, d.filename, e.severity, e.source, e.field, e.message
           FROM inv_errors e JOIN inv_documents d ON d.id = e.document_id WHERE NOT e.resolved""",
        "inv_documents", "inv_errors"),
    "q9_error_statistics": sql(
        "SELECT source, severity, field, count(*) AS n FROM inv_errors GROUP BY ALL", "inv_errors"),
    "q10_review_history": sql(
        """SELECT id, filename, validated_at, reviewer_note,
                  (SELECT count(*) FROM inv_errors e WHERE e.document_id = d.id) AS error_count
           FROM inv_documents d WHERE status = 'VALIDATED'""", "inv_documents", "inv_errors"),
    "q11_vendor_summary": sql(
        """SELECT coalesce(vendor_name, '(미확인)') AS vendor_name, count(*) AS n,
                  CAST(sum(CAST(total_amount AS DECIMAL(28,4))) AS DOUBLE) AS total,
                  min(issue_date) AS first_issue, max(issue_date) AS last_issue
           FROM inv_documents WHERE status = 'VALIDATED' GROUP BY vendor_name""", "inv_documents"),
    "q12_failures": sql(
        "SELECT id, filename, created_at, failure_reason FROM inv_documents WHERE status = 'FAILED'", "inv_documents"),
    "q13_open_error_counts": sql(
        "SELECT document_id, count(*) AS n FROM inv_errors WHERE NOT resolved GROUP BY document_id", "inv_errors"),
    "q14_numbered_list": sql(
        f"""SELECT id, filename, status, page_count, created_at, row_number() OVER (ORDER BY id DESC) AS row_no,
                  coalesce(n, 0) AS error_count, {_LABEL} AS label, count(*) OVER () AS total
           FROM inv_documents LEFT JOIN (SELECT document_id AS id, count(*) AS n FROM inv_errors
                                         WHERE NOT resolved GROUP BY 1) USING (id)""", "inv_documents", "inv_errors"),
    "q14_newest_fifty_pending": sql(
        f"""SELECT * FROM (SELECT id, filename, status, page_count, created_at, row_number() OVER (ORDER BY id DESC) AS row_no,
                  coalesce(n, 0) AS error_count, {_LABEL} AS label, count(*) OVER () AS total
           FROM inv_documents LEFT JOIN (SELECT document_id AS id, count(*) AS n FROM inv_errors
                                         WHERE NOT resolved GROUP BY 1) USING (id)
           WHERE status = 'PENDING') WHERE row_no <= 50""", "inv_documents", "inv_errors"),
    "q15_document_detail": sql(
        f"""SELECT id, filename, status, is_valid, page_count, model, created_at, validated_at, reviewer_note, failure_reason,
            coalesce(doc_type, 'UNKNOWN') AS doc_type, {', '.join(_HEADER_TEXT[1:] + _HEADER_NUM)},
            coalesce(line_item_count, 0) AS line_item_count, coalesce(open_error_count, 0) AS open_error_count,
            coalesce(error_count, 0) AS error_count FROM inv_documents {_COUNTS}""",
        "inv_documents", "inv_line_items", "inv_errors"),
    "q15_detail_errors": sql(
        "SELECT * FROM inv_errors WHERE document_id IN (SELECT id FROM inv_documents)", "inv_documents", "inv_errors"),
    "q15_detail_items": sql(
        "SELECT * FROM inv_line_items WHERE document_id IN (SELECT id FROM inv_documents)",
        "inv_documents", "inv_line_items"),
    "q17_review_queue": sql(
        "SELECT id, filename, status, created_at FROM inv_documents WHERE status IN ('ERROR', 'PENDING')", "inv_documents"),
    "q17_review_queue_counts": sql(
        """SELECT count(*) FILTER (status = 'ERROR') AS error, count(*) FILTER (status = 'PENDING') AS pending,
                  count(*) FILTER (status IN ('ERROR', 'PENDING')) AS badge FROM inv_documents""", "inv_documents"),
    "q18_run_summary": sql(
        """SELECT count(*) FILTER (id % 8 = 0) AS skipped,
                  count(*) FILTER (id % 8 <> 0 AND st = 'ERROR') AS error,
                  count(*) FILTER (id % 8 <> 0 AND st = 'FAILED') AS failed,
                  count(*) FILTER (id % 8 <> 0 AND st NOT IN ('ERROR', 'FAILED')) AS pending
           FROM (SELECT id, CASE WHEN id % 101 = 0 THEN 'PROCESSING' ELSE status END AS st FROM inv_documents)""",
        "inv_documents"),
    "q19_job_list": sql(
        """SELECT 'job-' || id AS job_id, CASE WHEN id % 19 <> 0 THEN 'DONE' ELSE 'FAILED' END AS state, filename,
                  CASE WHEN id % 19 <> 0 THEN id END AS document_id, CASE WHEN id % 19 <> 0 THEN status END AS document_status,
                  CASE WHEN id % 19 <> 0 THEN id % 4 ELSE 0 END AS error_count, id % 19 <> 0 AND id % 8 = 0 AS skipped,
                  CASE WHEN id % 19 <> 0 AND id % 8 = 0 THEN 'already stored as #' || id ELSE '' END AS message,
                  created_at AS started_at, '2026-01-01T00:00:00+00:00' AS finished_at FROM inv_documents""",
        "inv_documents"),
    "q20_record_as_pairs": sql(
        " UNION ALL ".join(
            [f"SELECT id, '{c}' AS column_name, coalesce({c}, 'NULL') AS value FROM inv_documents" for c in _HEADER_TEXT]
            + [f"SELECT id, '{c}' AS column_name, coalesce({_AS_TEXT.format(c=c)}, 'NULL') AS value FROM inv_documents"
               for c in _HEADER_NUM]), "inv_documents"),
    "q21_new_files": sql(
        """SELECT arrival, filename AS name, size FROM inv_uploads u WHERE arrival % 2 = 1 AND NOT EXISTS
           (SELECT 1 FROM inv_uploads o WHERE o.arrival % 2 = 0 AND o.filename = u.filename AND o.size = u.size)""",
        "inv_uploads"),
}
