"""Table layouts. Money stays double, timestamps stay ISO text, as the data model has them."""

from __future__ import annotations

from pyspark.sql import types as T

from .functions import fixed_values as V

HEADER = T.StructType(
    [T.StructField(n, T.StringType()) for n in V.HEADER_TEXT]
    + [T.StructField(n, T.DoubleType()) for n in V.HEADER_AMOUNTS]
)
HEADER_FIELDS = HEADER.fieldNames()


_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """StructType from 'name type, ...' (needs no running session)."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


DOCUMENTS = T.StructType(
    _struct(
        "id long, filename string, file_hash string, stored_path string, status string,"
        "is_valid boolean, page_count int, markdown string, docling_json string"
    ).fields
    + HEADER.fields
    + _struct(
        "model string, failure_reason string, reviewer_note string,"
        "created_at string, updated_at string, validated_at string"
    ).fields
)
LINE_ITEMS = _struct(
    "id long, document_id long, position int, description string,"
    "quantity double, unit_price double, amount double, tax double"
)
VALIDATION_ERRORS = _struct(
    "id long, document_id long, field string, message string, severity string,"
    "source string, resolved boolean, created_at string"
)
RAW_HEADER = _struct(
    "invoice_number string, issue_date string, due_date string, vendor_name string,"
    "buyer_name string, po_number string, currency string, subtotal string, tax string,"
    "shipping string, total_amount string"
)
FINDINGS = "findings array<struct<field:string,value:string>>"
LAYOUT = "texts array<struct<text:string,prov:array<struct<page_no:int,bbox:struct<t:double,l:double>>>>>"
TICKET = _struct(
    "number int, slug string, status string, created_at string, section string,"
    "document_id long, message string, images array<string>"
)
JOBS = _struct(
    "job_id string, state string, filename string, document_id long, document_status string,"
    "error_count int, skipped boolean, message string, started_at string, finished_at string"
)
# one finding of the checks; (stage, rule, row) is its place in the report
ISSUES = _struct(
    "document_id long, stage int, rule int, row long, code string, field string,"
    "message string, severity string, source string"
)


def check_header(fields: list[str]) -> None:
    """Header columns declared in two places must agree, or values would be lost (IO7)."""
    declared, stored = set(HEADER_FIELDS), set(fields)
    if declared != stored:
        raise ValueError(
            f"header fields differ: only declared {sorted(declared - stored)}, "
            f"only stored {sorted(stored - declared)}"
        )
