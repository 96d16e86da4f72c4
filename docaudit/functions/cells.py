"""Classification of single table cells and descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import cast_found, let, strip

_NUMERIC = (
    rf"(?iU)^\s*(?:{V.CURRENCY})?\s*[-+]?\d[\d.,\s]*\s*"
    rf"(?:(?:{V.CURRENCY})|(?:{V.UNIT}))?\s*$"
)


def embedded_quantities(c: Column) -> Column:
    """Quantities written inside a description, one per pattern, in pattern order."""
    found = [cast_found(F.regexp_extract(c, f"(?iU){p}", 1), "double") for p in V.EMBEDDED_QUANTITY]
    return F.array_compact(F.array(*found))


def is_number_cell(c: Column) -> Column:
    """The whole cell is a number, possibly with a currency or a unit."""
    return F.coalesce(c.rlike(_NUMERIC), F.lit(False))


def has_currency(c: Column) -> Column:
    return c.rlike(f"(?iU){V.CURRENCY}")


def has_unit(c: Column) -> Column:
    return c.rlike(f"(?iU){V.UNIT}")


def item_number_cell(c: Column) -> Column:
    """Item number of a cell holding nothing else."""
    return cast_found(F.regexp_extract(F.coalesce(c, F.lit("")), f"(?U){V.ITEM_NUMBER_CELL}", 1), "int")


def is_summary_row(cells: Column) -> Column:
    """A totals row: summary words anywhere, or one cell that is only a label."""
    label = F.exists(cells, lambda x: F.rtrim(F.lower(strip(x)), F.lit(":")).isin(V.SUMMARY_LABELS))
    unknown = F.exists(cells, lambda x: F.when(x.isNotNull(), False))
    # every summary word and label holds one of these; the costly tests run only where one occurs
    likely = "total|tax|vat|shipping|handling|due|discount|balance|합계|소계|총계|부가세|세액|공급가액|할인"
    return let(
        F.array_join(cells, " "),
        lambda row: F.when(F.lower(row).rlike(likely), row.rlike(f"(?iU){V.SUMMARY_WORDS}") | label).otherwise(unknown),
    )


def has_quantity_text(c: Column) -> Column:
    """A counted quantity such as '5 pcs.' inside a description."""
    return c.rlike(f"(?iU){V.QUANTITY_TEXT}")


def trailing_number(c: Column) -> Column:
    return F.regexp_extract(c, f"(?U){V.TRAILING_NUMBER}", 1)


def before_trailing_number(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"(?U){V.TRAILING_NUMBER}", ""))
