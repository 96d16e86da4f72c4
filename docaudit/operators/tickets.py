"""Error tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import first_line
from .ranking import number_rows

c = F.col
OPEN, RESOLVED = "OPEN", "RESOLVED"


def list_tickets(tickets: DataFrame, scope: str = "open") -> DataFrame:
    """Newest first with the first line of the message."""
    rows = tickets.filter(c("status") == OPEN) if scope == "open" else tickets
    return rows.select(
        "slug", "number", "status", "created_at", "section", "document_id", first_line(c("message"), 120).alias("summary")
    ).orderBy(F.desc("created_at"), "slug")


def ticket_counts(tickets: DataFrame) -> DataFrame:
    """T2."""
    return tickets.agg(F.count_if(c("status") == OPEN).alias("open"), F.count("*").alias("total"))


def number_tickets(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Numbers after the highest slug prefix, in order of creation, and the slugs.

    `new` has created_at (ISO text), document_id and ticket_key, which orders equal times.
    """
    prefix = F.regexp_extract("slug", r"^(\d+)(?:_|$)", 1).try_cast("int")
    highest = existing.agg(F.coalesce(F.max(prefix), F.lit(0))).scalar()
    numbered = number_rows(new, [], [c("created_at"), c("ticket_key")], "__no").withColumn(
        "number", (highest + c("__no")).cast("int")
    )
    stamp = F.concat(
        F.translate(F.substr("created_at", F.lit(1), F.lit(10)), "-", ""), F.lit("-"),
        F.translate(F.substr("created_at", F.lit(12), F.lit(8)), ":", ""),
    )
    doc = F.when(c("document_id").isNotNull(), F.concat(F.lit("_doc"), c("document_id").cast("string"))).otherwise("")
    return (
        numbered.withColumn("slug", F.concat(F.format_string("%04d_%s", c("number"), stamp), doc))
        .withColumn("status", F.lit(OPEN)).drop("__no")
    )


def set_ticket_status(tickets: DataFrame, changes: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """T4: changes (slug, status); also returns the slugs that do not exist."""
    if "status_changed_at" not in tickets.columns:
        tickets = tickets.withColumn("status_changed_at", F.lit(None).cast("string"))
    new = changes.groupBy("slug").agg(F.max("status").alias("n_status"))
    out = tickets.join(new, "slug", "left").select(*[
        F.when(c("n_status").isNotNull(), c("n_status")).otherwise(c("status")).alias("status") if x == "status"
        else F.when(c("n_status").isNotNull(), F.lit(now)).otherwise(c(x)).alias(x) if x == "status_changed_at"
        else c(x)
        for x in tickets.columns
    ])
    return out, changes.select("slug").distinct().join(tickets.select("slug"), "slug", "left_anti")


def ticket_context(tickets: DataFrame, docs: DataFrame, errors: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """T5: what belongs to a ticket's document, as rows keyed by slug.

    The header comes with the start of its text; errors and items stay rows, so that a
    document with very many of them is no single cell.
    """
    keys = tickets.filter(c("document_id").isNotNull()).select("slug", "document_id")
    body = F.coalesce(c("markdown"), F.lit(""))
    head = docs.select(
        c("id").alias("document_id"),
        *[x for x in docs.columns if x not in ("id", "markdown", "docling_json")],
        F.left(body, F.lit(V.PREVIEW_LIMIT)).alias("markdown_preview"),
        (F.length(body) > V.PREVIEW_LIMIT).alias("markdown_truncated"),
    )
    n_err = errors.groupBy("document_id").agg(F.count("*").alias("error_count"))
    n_items = items.groupBy("document_id").agg(F.count("*").alias("item_count"))
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    document = (
        keys.join(head.withColumnRenamed("status", "document_status").withColumnRenamed("created_at", "document_created_at"),
                  "document_id", "left")
        .join(n_err, "document_id", "left").join(n_items, "document_id", "left")
        .withColumn("error_count", zero("error_count")).withColumn("item_count", zero("item_count"))
    )
    return {
        "document": document,
        "errors": keys.join(errors, "document_id"),
        "line_items": keys.join(items, "document_id"),
    }


def delete_tickets(tickets: DataFrame, slugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tickets without the slugs, and how many went. A slug is a plain name, never a path."""
    plain = slugs.filter(~c("slug").contains("/") & ~c("slug").isin("", ".", "..")).select("slug").distinct()
    return (
        tickets.join(plain, "slug", "left_anti"),
        tickets.join(plain, "slug", "left_semi").agg(F.count("*").alias("removed")),
    )
