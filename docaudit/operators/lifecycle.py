"""Document lifecycle: every operator takes table snapshots and returns the new ones.

Joins against ids or hashes use sides reduced to one row per key first. New ids follow
the highest existing one in a skew-safe global numbering; no step passes a table through
one task.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import strip
from ..schemas import DOCUMENTS, HEADER_FIELDS, VALIDATION_ERRORS
from ..session import settled
from .lookup import LOOKUP_KEYS, rows_of
from .ranking import number_rows
from .rules import revalidate, verdicts

c = F.col


def assign_ids(rows: DataFrame, existing: DataFrame, order: list[Column], highest: int | None = None) -> DataFrame:
    """`id` = highest existing id + place in `order`; `highest` saves looking for it."""
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() if highest is None else F.lit(highest)
    numbered = number_rows(rows, [], order, "__no")
    return numbered.withColumn("id", (highest + c("__no")).cast("long")).drop("__no")


# --- C1 -----------------------------------------------------------------------------

def reserve(
    docs: DataFrame, incoming: DataFrame, now: str, skip_duplicates: bool = True, highest: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Admit uploads (arrival, filename, file_hash, stored_path).

    Returns the new PROCESSING rows and an outcome per upload. With `skip_duplicates` a
    hash held by a document that has not failed points to the newest such document, and
    the first arrival of a new hash wins within the batch. Uploads without a hash are like no
    other and are all admitted. `highest` is the highest id so far, where the caller knows it.
    """
    if not skip_duplicates:
        fresh = assign_ids(incoming, docs, [c("arrival")], highest)
        outcomes = fresh.select(
            "arrival", "filename", c("id").alias("document_id"), F.lit(V.PROCESSING).alias("status"),
            F.lit(False).alias("skipped"), F.lit("").alias("message"),
        )
        return _processing(fresh, now), outcomes
    held = (
        docs.filter((c("status") != V.FAILED) & c("file_hash").isNotNull())
        .groupBy("file_hash").agg(F.max(F.struct("id", "status")).alias("d"))
        .select("file_hash", "d.id", "d.status")
    )
    rest = [x for x in incoming.columns if x not in ("arrival", "file_hash")]
    # what stands for the contents: the hash, or the upload itself where there is none
    content = F.coalesce(c("file_hash"), F.concat(F.lit("\x00"), c("arrival").cast("string")))
    known = incoming.withColumn("__content", content)
    first = (
        known.groupBy("__content").agg(F.min(F.struct("arrival", "file_hash", *rest)).alias("f"))
        .select("__content", "f.*")
        .join(held.select(c("file_hash").alias("__content")), "__content", "left_anti")
    )
    fresh = assign_ids(first, docs, [c("arrival")], highest)
    resolved = held.withColumnRenamed("file_hash", "__content").withColumn("by", F.lit(None).cast("long")).unionByName(
        fresh.select("__content", "id", F.lit(V.PROCESSING).alias("status"), c("arrival").cast("long").alias("by"))
    )
    skipped = ~F.coalesce(c("by") == c("arrival"), F.lit(False))
    state = F.when(c("status") == V.PROCESSING, "being processed").otherwise("stored")
    outcomes = known.select("arrival", "filename", "__content").join(resolved, "__content").select(
        "arrival", "filename", c("id").alias("document_id"), "status", skipped.alias("skipped"),
        F.when(skipped, F.format_string("the same file is already %s as #%d", state, c("id"))).otherwise("").alias("message"),
    )
    return _processing(fresh, now), outcomes


def reserve_few(docs: DataFrame, incoming: DataFrame, now: str, highest: int) -> tuple[DataFrame, DataFrame]:
    """C1 for a call of at most LOOKUP_KEYS uploads: only stored documents with their hashes are read.

    On tables written for look-ups these are few row groups. More uploads are refused: `reserve`
    joins them with all documents.
    """
    given = incoming.select("file_hash").filter(c("file_hash").isNotNull()).distinct().limit(LOOKUP_KEYS + 1)
    hashes = [r[0] for r in given.collect()]
    return reserve(rows_of(docs, "file_hash", hashes), incoming, now, highest=highest)


def _processing(fresh: DataFrame, now: str) -> DataFrame:
    given = {"status": F.lit(V.PROCESSING), "created_at": F.lit(now), "updated_at": F.lit(now), "page_count": F.lit(0)}
    have = {"id", "filename", "file_hash", "stored_path"}
    return fresh.select(*[
        (c(f.name) if f.name in have else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in DOCUMENTS
    ])


# --- C2-C4 --------------------------------------------------------------------------

def _overlay(docs: DataFrame, changes: DataFrame, values: dict[str, Column], key: str = "id") -> DataFrame:
    """docs with `values` (over columns n_*) where a change exists for the id."""
    renamed = changes.select(*[c(x).alias(f"n_{x}") for x in changes.columns])
    hit = c(f"n_{key}").isNotNull()
    joined = docs.join(renamed, c("id") == c(f"n_{key}"), "left")
    return joined.select(*[F.when(hit, values[x]).otherwise(c(x)).alias(x) if x in values else c(x) for x in docs.columns])


def _replace_children(children: DataFrame, keys: DataFrame, new: DataFrame) -> DataFrame:
    kept = children.join(keys.distinct(), "document_id", "left_anti")
    return kept.unionByName(new.select(*children.columns))


def assign_positions(items: DataFrame) -> DataFrame:
    """A document with any unnumbered item numbers all its items by their place."""
    gaps = items.filter(c("position").isNull()).select("document_id").distinct().withColumn("renumber", F.lit(True))
    place = F.when(c("renumber"), c("ord").cast("int")).otherwise(c("position"))
    return items.join(gaps, "document_id", "left").withColumn("position", place).drop("renumber")


def new_item_rows(items: DataFrame, existing: DataFrame) -> DataFrame:
    rows = assign_positions(items)
    return assign_ids(rows, existing, [c("document_id"), c("ord")]).select(*existing.columns)


def new_error_rows(issues: DataFrame, existing: DataFrame, now: str) -> DataFrame:
    rows = issues.withColumn("resolved", F.lit(False)).withColumn("created_at", F.lit(now))
    order = [c(x) for x in ("document_id", "stage", "rule", "row", "code", "field", "message")]
    return assign_ids(rows, existing, order).select(*VALIDATION_ERRORS.fieldNames())


def finalized_documents(docs: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """C2, headers: results (id, status, is_valid, page_count, markdown, docling_json, model, header) stored."""
    names = ["status", "is_valid", "page_count", "markdown", "docling_json", "model", *HEADER_FIELDS]
    values = {n: c(f"n_{n}") for n in names if n in results.columns}
    values |= {"failure_reason": F.lit(None).cast("string"), "updated_at": F.lit(now)}
    return _overlay(docs, results, values)


def replace_items(items: DataFrame, keys: DataFrame, new_items: DataFrame) -> DataFrame:
    """These items instead of those stored for the documents."""
    return _replace_children(items, keys, new_item_rows(new_items, items))


def finalize(
    docs: DataFrame, items: DataFrame, errors: DataFrame,
    results: DataFrame, new_items: DataFrame, issues: DataFrame, now: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, items and errors after processing; numbering writes the new rows."""
    keys = results.select(c("id").alias("document_id"))
    return (
        finalized_documents(docs, results, now),
        replace_items(items, keys, new_items),
        replace_errors(errors, keys, issues, now),
    )


def fail(docs: DataFrame, errors: DataFrame, failures: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Failures (id, reason, and what the conversion gave, if anything)."""
    given = lambda n, default: F.coalesce(c(f"n_{n}"), F.lit(default)) if n in failures.columns else F.lit(default)
    values = {
        "status": F.lit(V.FAILED),
        "is_valid": F.lit(None).cast("boolean"),
        "failure_reason": c("n_reason"),
        "markdown": given("markdown", ""),
        "docling_json": given("docling_json", "{}"),
        "page_count": given("page_count", 0),
        "updated_at": F.lit(now),
    }
    keys = failures.select(c("id").alias("document_id")).distinct()
    return _overlay(docs, failures, values), errors.join(keys, "document_id", "left_anti")


def stale_cutoff(now: str, minutes: int = V.STALE_MINUTES) -> str:
    return (datetime.fromisoformat(now) - timedelta(minutes=minutes)).isoformat(timespec="seconds")


def cleanup_stale(docs: DataFrame, now: str, minutes: int = V.STALE_MINUTES) -> tuple[DataFrame, DataFrame]:
    """C4: PROCESSING rows created before the cutoff fail; also returns how many (one row)."""
    stale = (c("status") == V.PROCESSING) & (c("created_at") < stale_cutoff(now, minutes))
    values = {
        "status": F.lit(V.FAILED),
        "failure_reason": F.lit("processing was interrupted"),
        "updated_at": F.lit(now),
    }
    out = docs.select(*[F.when(stale, values[x]).otherwise(c(x)).alias(x) if x in values else c(x) for x in docs.columns])
    return out, docs.agg(F.count_if(stale).alias("n"))


# --- C6-C9 --------------------------------------------------------------------------

def updated_documents(docs: DataFrame, edits: DataFrame, now: str) -> DataFrame:
    """C6, headers: edits (document_id, header columns, note) replace what is stored."""
    values = {n: c(f"n_{n}") for n in HEADER_FIELDS}
    values |= {"reviewer_note": c("n_note"), "updated_at": F.lit(now)}
    return _overlay(docs, edits, values, key="document_id")


def update_fields(
    docs: DataFrame, items: DataFrame, edits: DataFrame, edit_items: DataFrame, now: str
) -> tuple[DataFrame, DataFrame]:
    """Edited headers and their items."""
    return updated_documents(docs, edits, now), replace_items(items, edits.select("document_id"), edit_items)


def replace_errors(errors: DataFrame, keys: DataFrame, issues: DataFrame, now: str) -> DataFrame:
    """The issues of these documents instead of their stored errors."""
    return _replace_children(errors, keys, new_error_rows(issues, errors, now))


def checked_edits(docs: DataFrame, edits: DataFrame, edit_items: DataFrame, as_of: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Issues of the edited documents, and the verdict per document."""
    keys = edits.select(c("document_id").alias("id")).distinct()
    edited = updated_documents(docs, edits, now).join(keys, "id", "left_semi")
    issues = settled(revalidate(edited, edit_items, as_of), "recheck")
    return issues, verdicts(edited, issues)


def recheck(
    docs: DataFrame, items: DataFrame, errors: DataFrame, edits: DataFrame, edit_items: DataFrame, as_of: str, now: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Store edits, run the rules on them and replace the errors; the status stays.

    Returns the three tables and the verdict per edited document.
    """
    issues, checked = checked_edits(docs, edits, edit_items, as_of, now)
    new_docs, new_items = update_fields(docs, items, edits, edit_items, now)
    return new_docs, new_items, replace_errors(errors, edits.select("document_id").distinct(), issues, now), checked


def approve(
    docs: DataFrame, items: DataFrame, errors: DataFrame, edits: DataFrame, edit_items: DataFrame, as_of: str, now: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Recheck, then validate what has nothing critical or is forced.

    The last result names the rejected documents; their edits are stored nevertheless.
    """
    docs2, items2, errors2, checked = recheck(docs, items, errors, edits, edit_items, as_of, now)
    approved, rejected = approval(checked, edits)
    docs3, errors3 = _mark_validated(docs2, errors2, approved, now)
    return docs3, items2, errors3, rejected


def approval(checked: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that may be approved, and the documents that may not with their critical counts."""
    verdict = checked.join(edits.select("document_id", "force"), "document_id")
    passed = (c("critical_count") == 0) | F.coalesce(c("force"), F.lit(False))
    return (
        verdict.filter(passed).select(c("document_id").alias("id")),
        verdict.filter(~passed).select("document_id", "critical_count"),
    )


def approved_documents(docs: DataFrame, edits: DataFrame, checked: DataFrame, now: str) -> DataFrame:
    """C9, headers: the edits stored and what may be approved validated."""
    return _validated(updated_documents(docs, edits, now), approval(checked, edits)[0], now)


def _validated(docs: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    values = {
        "status": F.lit(V.VALIDATED), "is_valid": F.lit(True),
        "validated_at": F.lit(now), "updated_at": F.lit(now),
    }
    return _overlay(docs, ids.select("id"), values)


def _mark_validated(docs: DataFrame, errors: DataFrame, ids: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    done = ids.select(c("id").alias("document_id")).withColumn("__done", F.lit(True))
    closed = errors.join(done, "document_id", "left").withColumn(
        "resolved", c("resolved") | F.coalesce(c("__done"), F.lit(False))
    )
    return _validated(docs, ids, now), closed.select(*errors.columns)


def bulk_approve(docs: DataFrame, errors: DataFrame, ids: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Approve those of the ids that are PENDING; also returns the skipped ids."""
    wanted = ids.select("id").distinct()
    pending = docs.filter(c("status") == V.PENDING).select("id")
    targets = wanted.join(pending, "id", "left_semi")
    new_docs, new_errors = _mark_validated(docs, errors, targets, now)
    return new_docs, new_errors, wanted.join(pending, "id", "left_anti")


# --- C11-C14 ------------------------------------------------------------------------

def delete_documents(
    docs: DataFrame, items: DataFrame, errors: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """C11: documents and their children without the ids; and how many documents went."""
    gone = ids.select("id").distinct()
    of = gone.withColumnRenamed("id", "document_id")
    return (
        docs.join(gone, "id", "left_anti"),
        items.join(of, "document_id", "left_anti"),
        errors.join(of, "document_id", "left_anti"),
        docs.join(gone, "id", "left_semi").agg(F.count("*").alias("deleted")),
    )


def stored_paths(docs: DataFrame, ids: DataFrame, upload_dir: str) -> DataFrame:
    """Stored files of the documents, only those directly inside the upload folder."""
    path = c("stored_path")
    parent = F.regexp_replace(path, r"/[^/]*$", "")
    inside = (parent == upload_dir.rstrip("/")) & ~path.rlike(r"(?:^|/)\.\.?(?:/|$)")
    return (
        docs.join(ids.select("id").distinct(), "id", "left_semi")
        .filter(path.isNotNull() & (path != "") & inside)
        .select("id", "stored_path")
    )


def clean_item_edits(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """Edited rows without the blank ones; NaN means empty.

    `numbered` holds the documents whose stored items all had numbers; elsewhere the
    number column is ignored.
    """
    number = lambda n: F.when(~F.isnan(c(n)), c(n))
    cleaned = rows.select(
        "document_id", "ord",
        number("position").cast("int").alias("position"),
        strip(F.coalesce(c("description"), F.lit(""))).alias("description"),
        *[number(n).alias(n) for n in ("quantity", "unit_price", "amount", "tax")],
    )
    blank = (c("description") == "") & F.coalesce("quantity", "unit_price", "amount", "tax").isNull()
    kept = cleaned.filter(~blank).join(
        numbered.select("document_id").distinct().withColumn("has", F.lit(True)), "document_id", "left"
    )
    kept = kept.withColumn("position", F.when(c("has"), c("position"))).drop("has").withColumnRenamed("ord", "was")
    return number_rows(kept, ["document_id"], [c("was")], "ord").drop("was")


def load_fields(docs: DataFrame, items: DataFrame) -> DataFrame:
    """C14: header beside its items, one row per item in order (one without items).

    Kept as rows so that a document may have any number of items.
    """
    head = docs.select(
        c("id").alias("document_id"),
        F.coalesce(F.when(c("doc_type") != "", c("doc_type")), F.lit("UNKNOWN")).alias("doc_type"),
        *[x for x in HEADER_FIELDS if x != "doc_type"],
    )
    body = items.select(
        "document_id", "position", F.coalesce(c("description"), F.lit("")).alias("description"),
        "quantity", "unit_price", "amount", c("tax").alias("item_tax"),
    )
    return head.join(body, "document_id", "left")
