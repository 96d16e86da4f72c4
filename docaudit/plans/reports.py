"""Reporting queries over documents, line_items and validation_errors.

Children are counted or summed per document before they meet the documents, so no join
multiplies rows and a document with very many children is reduced map-side first.
Listings end in a range-partitioned sort whose key is unique, so one document's rows
can spread over several sort partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import status_label
from ..operators.lookup import rows_of
from ..operators.ranking import number_rows
from ..operators.totals import exact_sums
from ..schemas import HEADER_FIELDS

LIST_COLUMNS = [
    "id", "filename", "status", "is_valid", "page_count", "model", "failure_reason",
    "created_at", "updated_at", "validated_at",
]


def _count_per_document(children: DataFrame, name: str) -> DataFrame:
    return children.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias(name))


def _with_count(docs: DataFrame, children: DataFrame, name: str) -> DataFrame:
    return docs.join(_count_per_document(children, name), "id", "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(0))
    )


def _of_document(children: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Children beside chosen columns of their document (inner join)."""
    head = docs.select(F.col("id").alias("document_id"), *columns)
    return children.withColumnRenamed("id", "child_id").join(head, "document_id")


def _known_status(status: str | None) -> None:
    if status and status not in V.STATUS_LABELS:
        raise ValueError(f"unknown status: {status}")


def document_list(docs: DataFrame, status: str | None = None) -> DataFrame:
    """Q2: all documents, or those in one status, newest first."""
    rows = docs.filter(F.col("status") == status) if status else docs
    return rows.select(*LIST_COLUMNS).orderBy(F.desc("id"))


def status_counts(docs: DataFrame) -> DataFrame:
    """Q3."""
    return docs.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def extraction_summary(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Q4: header values with the number of items."""
    head = docs.select(
        "id", "filename", "invoice_number", "issue_date", "vendor_name", "buyer_name",
        "subtotal", "tax", "total_amount",
    )
    return _with_count(head, items, "item_count").orderBy(F.desc("id"))


def items_with_document(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Q5."""
    return (
        _of_document(items, docs, "filename")
        .select(
            F.col("document_id").alias("id"), "filename", "position", "description",
            "quantity", "unit_price", "amount", "child_id",
        )
        .orderBy(F.desc("id"), "position", "child_id")
        .drop("child_id")
    )


def arithmetic_mismatches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Q6: rows whose quantity x unit price differs from the amount."""
    product = F.col("quantity") * F.col("unit_price")
    off = items.withColumn("computed", product).withColumn("difference", F.abs(product - F.col("amount")))
    return (
        _of_document(off.filter(F.col("difference") > V.AMOUNT_TOLERANCE), docs, "filename")
        .select(
            F.col("document_id").alias("id"), "filename", "position", "description", "quantity",
            "unit_price", "computed", F.col("amount").alias("stated"), "difference", "child_id",
        )
        .orderBy(F.desc("id"), "position", "child_id")
        .drop("child_id")
    )


def items_vs_totals(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Q7: item sum beside the stated totals; a NULL total gives a NULL difference."""
    sums = exact_sums(items.select(F.col("document_id").alias("id"), "amount"), ["id"], {"item_sum": F.col("amount")})
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("subtotal", "tax", "shipping")]
    return (
        docs.select("id", "filename", "subtotal", "tax", "shipping", "total_amount")
        .join(sums, "id", "left")
        .withColumn("difference", F.col("total_amount") - (parts[0] + parts[1] + parts[2]))
        .orderBy(F.desc("id"))
    )


def _severity_rank() -> Column:
    return F.when(F.col("severity") == "critical", 0).otherwise(1)


def open_errors(docs: DataFrame, errors: DataFrame) -> DataFrame:
    """Q8: unresolved issues, critical ones first within a document."""
    return (
        _of_document(errors.filter(~F.col("resolved")), docs, "filename")
        .select(F.col("document_id").alias("id"), "filename", "severity", "source", "field", "message", "child_id")
        .orderBy(F.desc("id"), _severity_rank(), "child_id")
        .drop("child_id")
    )


def error_statistics(errors: DataFrame) -> DataFrame:
    """Q9."""
    return (
        errors.groupBy("source", "severity", "field").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "source", "severity", "field")
    )


def review_history(docs: DataFrame, errors: DataFrame) -> DataFrame:
    """Q10: approved documents with all issues they ever had."""
    approved = docs.filter(F.col("status") == V.VALIDATED).select("id", "filename", "validated_at", "reviewer_note")
    return _with_count(approved, errors, "error_count").orderBy(F.desc("validated_at"), F.desc("id"))


def vendor_summary(docs: DataFrame) -> DataFrame:
    """Q11: approved documents per vendor; dates compare as text."""
    approved = docs.filter(F.col("status") == V.VALIDATED).select(
        F.col("vendor_name").isNull().alias("unknown"), F.coalesce("vendor_name", F.lit("")).alias("vendor_name"),
        "issue_date", "total_amount",
    )
    return (
        exact_sums(
            approved, ["unknown", "vendor_name"], {"total": F.col("total_amount")},
            F.count("*").alias("n"),
            F.min("issue_date").alias("first_issue"),
            F.max("issue_date").alias("last_issue"),
        )
        .withColumn("vendor_name", F.when(F.col("unknown"), V.UNKNOWN_VENDOR).otherwise(F.col("vendor_name")))
        .select("vendor_name", "n", "total", "first_issue", "last_issue")
        .orderBy(F.desc("total"), "vendor_name")
    )


def failures(docs: DataFrame) -> DataFrame:
    """Q12."""
    return (
        docs.filter(F.col("status") == V.FAILED)
        .select("id", "filename", "created_at", "failure_reason").orderBy(F.desc("id"))
    )


def open_error_counts(errors: DataFrame) -> DataFrame:
    """Q13."""
    return errors.filter(~F.col("resolved")).groupBy("document_id").agg(F.count("*").alias("n"))


def numbered_list(docs: DataFrame, errors: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Q14: the list with open-issue counts, labels and 1-based numbers.

    With a limit the newest documents are picked first (a top-k per partition) and only
    those meet the error counts; `total` is the count before the limit.
    """
    _known_status(status)
    rows = docs.filter(F.col("status") == status) if status else docs
    rows = rows.select("id", "filename", "status", "page_count", "created_at")
    total = rows.agg(F.count("*")).scalar()
    shown = rows.orderBy(F.desc("id")).limit(limit) if limit else rows
    counts = open_error_counts(errors).select(F.col("document_id").alias("id"), F.col("n").alias("error_count"))
    if limit:  # few rows are left to number
        numbered = shown.withColumn("row_no", F.row_number().over(W.orderBy(F.desc("id"))).cast("long"))
    else:
        numbered = number_rows(shown, [], [-F.col("id")], "row_no")
    joined = (
        numbered
        .join(counts, "id", "left")
        .withColumn("error_count", F.coalesce(F.col("error_count"), F.lit(0)))
        .withColumn("label", status_label(F.col("status")))
        .withColumn("total", total)
    )
    return joined.orderBy("row_no")


def document_detail(docs: DataFrame, items: DataFrame, errors: DataFrame) -> dict[str, DataFrame]:
    """Q15: header with counts, and the item and issue rows that belong to it.

    Items and issues stay rows ordered by (document, place) instead of being folded into
    one cell per document, so a document may have any number of them.
    """
    head = _with_count(
        docs.select(
            "id", "filename", "status", "is_valid", "page_count", "model", "created_at", "validated_at",
            F.when(F.col("reviewer_note") != "", F.col("reviewer_note")).alias("reviewer_note"),
            F.when(F.col("failure_reason") != "", F.col("failure_reason")).alias("failure_reason"),
            *HEADER_FIELDS,
        ).withColumn("doc_type", F.coalesce(F.when(F.col("doc_type") != "", F.col("doc_type")), F.lit("UNKNOWN"))),
        items, "line_item_count",
    )
    head = _with_count(head, errors.filter(~F.col("resolved")), "open_error_count")
    head = _with_count(head, errors, "error_count")
    keep = docs.select(F.col("id").alias("document_id"))
    return {
        "header": head,
        "line_items": items.join(keep, "document_id", "left_semi").orderBy("document_id", "position", "id"),
        "errors": errors.join(keep, "document_id", "left_semi").orderBy("document_id", _severity_rank(), "id"),
    }


def detail_of(tables: dict[str, DataFrame], ids: list[int]) -> dict[str, DataFrame]:
    """Q15 for a call of a few documents: on tables written for look-ups, few row groups are read."""
    return document_detail(
        rows_of(tables["documents"], "id", ids), rows_of(tables["line_items"], "document_id", ids),
        rows_of(tables["validation_errors"], "document_id", ids),
    )


def review_queue(docs: DataFrame) -> DataFrame:
    """Q17: documents waiting for a person."""
    return (
        docs.filter(F.col("status").isin(V.ERROR, V.PENDING))
        .select("id", "filename", "status", "created_at").orderBy("status", F.desc("id"))
    )


def review_queue_counts(docs: DataFrame) -> DataFrame:
    """Q17: its two sizes and the badge."""
    one = lambda s: F.count_if(F.col("status") == s)
    return docs.agg(one(V.ERROR).alias("error"), one(V.PENDING).alias("pending")).withColumn(
        "badge", F.col("error") + F.col("pending")
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Q18: outcomes of a run; skipped wins, and anything unnamed counts as pending."""
    kind = (
        F.when(F.col("skipped"), "skipped")
        .when(F.col("status") == V.ERROR, "error")
        .when(F.col("status") == V.FAILED, "failed")
        .otherwise("pending")
    )
    names = ("pending", "error", "failed", "skipped")
    return outcomes.select(kind.alias("kind")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in names])


def job_list(jobs: DataFrame) -> DataFrame:
    """Q19."""
    return jobs.orderBy(F.desc("started_at"), "job_id")


def finish_jobs(jobs: DataFrame, outcomes: DataFrame, finished_at: str) -> DataFrame:
    """Q19: jobs with the outcome of their run; a job without one failed outside of it."""
    done = F.col("o_status").isNotNull()
    out = outcomes.select(
        "job_id", F.col("document_id").alias("o_id"), F.col("status").alias("o_status"),
        F.col("error_count").alias("o_errors"), F.col("skipped").alias("o_skipped"), F.col("message").alias("o_message"),
    )
    return jobs.join(out, "job_id", "left").select(
        "job_id",
        F.when(done, "DONE").otherwise("FAILED").alias("state"),
        "filename",
        F.col("o_id").alias("document_id"),
        F.col("o_status").alias("document_status"),
        F.coalesce("o_errors", F.lit(0)).alias("error_count"),
        F.coalesce("o_skipped", F.lit(False)).alias("skipped"),
        F.coalesce("o_message", F.lit("")).alias("message"),
        "started_at",
        F.lit(finished_at).alias("finished_at"),
    )


def record_as_pairs(docs: DataFrame) -> DataFrame:
    """Q20: the header columns as (column, value) rows, NULL spelled out."""
    typed = docs.select("id", *[F.col(c).cast("string").alias(c) for c in HEADER_FIELDS])
    return typed.unpivot("id", HEADER_FIELDS, "column_name", "value").withColumn(
        "value", F.coalesce(F.col("value"), F.lit("NULL"))
    )


def new_files(listed: DataFrame, picked: DataFrame) -> DataFrame:
    """Q21: picked files whose name and size are not listed yet."""
    return picked.join(listed.select("name", "size").distinct(), ["name", "size"], "left_anti")
