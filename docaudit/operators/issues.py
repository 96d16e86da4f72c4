"""Issue rows: what a check reports, with its place in the report.

`code` names the rule and stays stable; `message` is for people. (stage, rule, row)
orders the issues of a document: 0 extraction, 1 rules, 2 grounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import ISSUES

EXTRACTION, RULES, GROUNDING = 0, 1, 2
COLUMNS = ISSUES.fieldNames()


def issue(
    when: Column, code: str, field, message, severity="critical", *, stage=RULES, rule=0, row=0, source="rule"
) -> Column:
    """Struct of one issue, NULL where `when` does not hold."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(
        when,
        F.struct(
            F.lit(stage).cast("int").alias("stage"),
            as_col(rule).cast("int").alias("rule"),
            as_col(row).cast("long").alias("row"),
            F.lit(code).alias("code"),
            as_col(field).alias("field"),
            as_col(message).alias("message"),
            as_col(severity).alias("severity"),
            as_col(source).alias("source"),
        ),
    )


def issue_rows(df: DataFrame, issues: list[Column], key: str = "document_id") -> DataFrame:
    """One row per issue that applies; a single pass without a shuffle.

    The outer form keeps the optimizer from testing the array for emptiness first,
    which would evaluate every check twice.
    """
    found = F.inline_outer(F.array_compact(F.array(*issues)))
    return df.select(F.col(key).alias("document_id"), found).filter(F.col("code").isNotNull()).select(*COLUMNS)


def dedupe_issues(issues: DataFrame) -> DataFrame:
    """First issue per document, field and message, in report order (V1).

    A grouped minimum combines map-side, so repeats of one issue never travel.
    """
    place = F.struct("stage", "rule", "row")
    rest = F.struct("code", "field", "message", "severity", "source")
    kept = issues.groupBy("document_id", F.col("field").alias("__f"), strip(F.col("message")).alias("__m")).agg(
        F.min(F.struct(place.alias("place"), rest.alias("rest"))).alias("first")
    )
    return kept.select("document_id", "first.place.*", "first.rest.*").select(*COLUMNS)
