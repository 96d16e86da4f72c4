"""Text and number cleaning."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` (used inside lambdas).

    The start of a fold over nothing: unlike the elements of a transform, neither the value nor
    what the body makes of it is copied, and such copies grow with the depth of nested calls.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def once(build):
    """A large column expression over fixed names, put together once per Spark context."""
    made = {}

    def column() -> Column:
        context = SparkContext._active_spark_context
        if made.get("context") is not context:
            made.update(context=context, column=build())
        return made["column"]

    return column


def cast_found(found: Column, kind: str) -> Column:
    """A matched text as a number; no match ('') is NULL without a failing, costly cast."""
    return let(found, lambda s: F.when(s != "", s.try_cast(kind)))


def any_of(words) -> str:
    """Regex alternation of literal words."""
    return "|".join("\\Q" + w + "\\E" for w in words)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(V.WHITESPACE))


def text_lines(c: Column) -> Column:
    """Lines of a text; a final line break opens no further line."""
    body = F.regexp_replace(c, rf"(?:{V.LINE_BREAKS})\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, V.LINE_BREAKS))


def to_text(c: Column) -> Column:
    """Stripped text, NULL for blank words."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(~F.lower(t).isin(V.BLANK_WORDS), t)


def to_number(c: Column) -> Column:
    """First number written in the text, whichever decimal separator it uses.

    The later of two different separators is the decimal one; a lone kind of comma is
    decimal when one or two digits follow it. Anything that then is no number is NULL.
    """
    # white space at the ends is no part of a token, so it need not be stripped
    token = F.regexp_extract(F.replace(c, F.lit(" "), F.lit("")), V.NUMBER_TOKEN, 0)

    def read(t):
        # blank words hold no digit, so their token is no number either
        mark = F.translate(t, "-0123456789", "")
        plain = (
            F.when((mark == "") | (mark == "."), t)
            .when(t.rlike(r"\..*,[^.]*$|^[^.]*,[0-9]{1,2}$"), F.translate(t, ",.", "."))
            .otherwise(F.translate(t, ",", ""))
        )
        return F.when(t.rlike("[0-9]"), plain.try_cast("double"))

    return let(token, read)


def head_tail_excerpt(c: Column, limit: int = V.EXCERPT_LIMIT) -> Column:
    """First 60 % and last 40 % of a text longer than `limit`."""
    head = int(limit * 0.6)
    cut = F.concat(F.substr(c, F.lit(1), F.lit(head)), F.lit(V.EXCERPT_MARK), F.right(c, F.lit(limit - head)))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def text_page(c: Column, offset: int, size: int) -> Column:
    """One page of a text with its counts."""
    body = F.coalesce(c, F.lit(""))
    chunk = F.substr(body, F.lit(offset + 1), F.lit(size))
    total, got = F.length(body), F.length(chunk)
    return F.struct(
        total.cast("long").alias("total_chars"),
        F.lit(offset).cast("long").alias("offset"),
        got.cast("long").alias("returned_chars"),
        (F.lit(offset) + got < total).alias("has_more"),
        chunk.alias("chunk"),
    )


def first_line(c: Column, size: int, ellipsis: bool = False) -> Column:
    """First line cut to `size`; the screen form strips first and marks the cut."""
    if not ellipsis:
        return F.substr(F.get(F.split(F.coalesce(c, F.lit("")), V.LINE_BREAKS), F.lit(0)), F.lit(1), F.lit(size))
    body = strip(F.coalesce(c, F.lit("")))
    head = F.get(F.split(body, V.LINE_BREAKS), F.lit(0))
    cut = F.concat(F.substr(head, F.lit(1), F.lit(size)), F.lit("…"))
    return (
        F.when(body == "", "(내용 없음)")
        .when(F.length(head) > size, cut)
        .otherwise(head)
    )


def _lookup(c: Column, labels: dict) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def status_label(c: Column) -> Column:
    return _lookup(c, V.STATUS_LABELS)


def doc_type_label(c: Column) -> Column:
    return _lookup(c, V.DOC_TYPE_LABELS)


def error_target(field: Column) -> Column:
    """Form field an issue points at, or NULL when the form has none."""
    target = F.substring_index(F.coalesce(F.when(field != "", field), F.lit("document")), "[", 1)
    return F.when(target.isin(V.EDITABLE_FIELDS), target)


def money(c: Column) -> Column:
    """1234.5 -> '1,234.50' for messages."""
    return F.format_string("%,.2f", c.cast("double"))


def close_to(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= V.AMOUNT_TOLERANCE


def apart(a: Column, b: Column) -> Column:
    """Further apart than the tolerance. Infinite amounts are apart from all others; where the
    difference is no number, nothing can be said against the values."""
    return (F.abs(a - b) > V.AMOUNT_TOLERANCE) & ~F.isnan(a - b)
