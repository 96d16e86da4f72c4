"""Deterministic checks of headers and line items.

`docs` has `id` and the header columns; `items` holds the rows of exactly those
documents with `ord`, their 1-based place, and `position`, the number the document
gives them. Header rules are one projection over documents joined with per-document
sums; row rules are one projection over items. Only rows that need a figure of their
whole document (R7, R12) are joined with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.cells import has_quantity_text
from ..functions.dates import parse_date
from ..functions.text import apart, money
from ..schemas import HEADER_FIELDS
from .grounding import grounding_check
from .issues import dedupe_issues, issue, issue_rows
from .totals import exact_sums

c = F.col


def stored_items(items: DataFrame) -> DataFrame:
    """Stored line items as rule input: they are kept in the order of their position."""
    return items.withColumn("ord", c("position").cast("long"))


def _missing(name: str) -> Column:
    return c(name).isNull() | (c(name) == "")


def shown_number() -> Column:
    return F.coalesce(c("position").cast("long"), c("ord"))


def item_totals(items: DataFrame) -> DataFrame:
    """Figures per document; combines map-side, so a huge document is no burden."""
    both = c("quantity").isNotNull() & c("unit_price").isNotNull()
    either = c("quantity").isNotNull() | c("unit_price").isNotNull()
    pos = c("position").cast("decimal(19,0)")
    return exact_sums(
        items, ["document_id"], {"amounts": c("amount"), "taxes": c("tax")},
        F.count("*").alias("n"),
        F.count_if(both).alias("priced"),
        F.count_if(either).alias("half_priced"),
        F.count("position").alias("numbered"),
        F.min("position").alias("low"),
        F.max("position").alias("high"),
        F.sum(pos).alias("pos_sum"),
        F.sum((pos * pos).cast("decimal(28,0)")).alias("pos_squares"),
    )


# --- header rules -------------------------------------------------------------------

def _required() -> list[Column]:
    labels = {"issue_date": "issue date", "vendor_name": "vendor name"}
    pairs = F.create_map(*[F.lit(x) for kv in V.DOC_NUMBER_LABELS.items() for x in kv])
    number = F.coalesce(F.try_element_at(pairs, c("doc_type")), F.lit(V.DOC_NUMBER_LABELS["UNKNOWN"]))
    out = []
    for i, f in enumerate(V.REQUIRED_FIELDS):
        label = number if f == "invoice_number" else F.lit(labels[f])
        out.append(issue(_missing(f), "R1", f, F.concat(label, F.lit(" is empty")), rule=1, row=i))
    return out


def _date_format(field: str, code: str, rule: int) -> list[Column]:
    bad = ~_missing(field) & parse_date(c(field)).isNull()
    text = F.format_string(f"{field} '%s' is not a date", c(field))
    return [issue(bad, code, field, text, rule=rule)]


def _date_order() -> list[Column]:
    text = F.format_string("due date %s is before issue date %s", c("due_date"), c("issue_date"))
    return [issue(parse_date(c("due_date")) < parse_date(c("issue_date")), "R4", "due_date", text, rule=4)]


def _future(as_of: str) -> list[Column]:
    late = parse_date(c("issue_date")) > F.lit(as_of).cast("date")
    return [issue(late, "R5", "issue_date", F.format_string("issue date %s lies in the future", c("issue_date")), "warning", rule=5)]


def _has_items() -> Column:
    return F.coalesce(c("n"), F.lit(0)) > 0


def _amounts() -> Column:
    return F.coalesce(c("amounts"), F.lit(0.0))


def _item_sum() -> list[Column]:
    off = apart(_amounts(), c("subtotal"))
    text = F.format_string("item amounts sum to %s, subtotal is %s", money(_amounts()), money(c("subtotal")))
    return [issue(_has_items() & off, "R6", "line_items", text, rule=6)]


def _nothing_to_reconcile() -> list[Column]:
    none = c("subtotal").isNull() & c("tax").isNull() & c("shipping").isNull() & c("total_amount").isNull()
    severity = F.when(c("priced") == 0, "critical").otherwise("warning")
    text = F.format_string("%d items but no subtotal, tax, shipping or total", c("n"))
    return [issue(_has_items() & none, "R8", "total_amount", text, severity, rule=8)]


def _effective_tax() -> Column:
    return F.coalesce(c("tax"), F.nullif(c("taxes"), F.lit(0.0)), F.lit(0.0))


def _total() -> list[Column]:
    expected = c("subtotal") + _effective_tax() + F.coalesce(c("shipping"), F.lit(0.0))
    text = F.format_string("subtotal + tax + shipping = %s, total is %s", money(expected), money(c("total_amount")))
    return [issue(apart(expected, c("total_amount")), "R15", "total_amount", text, rule=15)]


def _bare_total() -> list[Column]:
    bare = c("subtotal").isNull() & c("tax").isNull() & c("shipping").isNull()
    off = apart(_amounts(), c("total_amount"))
    text = F.format_string("item amounts sum to %s, total is %s, and nothing else is stated",
                           money(_amounts()), money(c("total_amount")))
    return [issue(_has_items() & bare & off, "R16", "total_amount", text, "warning", rule=16)]


def _negative() -> list[Column]:
    return [
        issue(c(f) < 0, "R17", f, F.format_string(f"{f} is negative: %s", money(c(f))), rule=17, row=i)
        for i, f in enumerate(V.HEADER_AMOUNTS)
    ]


def header_rules(as_of: str) -> dict[str, list[Column]]:
    return {
        "R1": _required(),
        "R2": _date_format("issue_date", "R2", 2),
        "R3": _date_format("due_date", "R3", 3),
        "R4": _date_order(),
        "R5": _future(as_of),
        "R6": _item_sum(),
        "R8": _nothing_to_reconcile(),
        "R15": _total(),
        "R16": _bare_total(),
        "R17": _negative(),
    }


# --- row rules ----------------------------------------------------------------------

def _row_issue(when: Column, code: str, text: Column, severity="critical", sub=0) -> Column:
    field = F.format_string("line_items[%d]", shown_number())
    named = F.concat(F.format_string("item %d '%s': ", shown_number(), F.left(F.coalesce(c("description"), F.lit("")), F.lit(40))), text)
    return issue(when, code, field, named, severity, rule=10, row=c("ord") * 4 + sub)


def row_rules() -> dict[str, Column]:
    half = c("quantity").isNull() != c("unit_price").isNull()
    full = c("quantity").isNotNull() & c("unit_price").isNotNull() & c("amount").isNotNull()
    product = c("quantity") * c("unit_price")
    which = F.when(c("quantity").isNull(), "quantity").otherwise("unit price")
    return {
        "R10": _row_issue(c("amount").isNull(), "R10", F.lit("amount is empty and missing from the sum")),
        "R11": _row_issue(c("amount").isNotNull() & half, "R11", F.concat(which, F.lit(" is empty, the amount cannot be checked")), "warning"),
        "R13": _row_issue(full & apart(product, c("amount")), "R13",
                          F.format_string("quantity x unit price = %s, amount is %s", money(product), money(c("amount")))),
        "R14": _row_issue(full & (c("quantity") <= 0), "R14",
                          F.format_string("quantity is %s", c("quantity").cast("string")), sub=1),
    }


def collapsed_columns(items: DataFrame, totals: DataFrame) -> DataFrame:
    """No row has quantity or price while descriptions hold quantities."""
    blind = totals.filter("half_priced = 0").select("document_id")
    rows = (
        items.filter(c("quantity").isNull() & c("unit_price").isNull())
        .filter(has_quantity_text(F.coalesce(c("description"), F.lit(""))))
        .select("document_id", "ord", shown_number().alias("number"), "description")
        .join(blind, "document_id", "left_semi")
    )
    count = rows.groupBy("document_id").agg(F.count("*").alias("k"), F.min(F.struct("ord", "description")).alias("s"))
    first = (
        rows.withColumn("rn", F.row_number().over(W.partitionBy("document_id").orderBy("ord"))).filter("rn <= 5")
        .groupBy("document_id")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "number"))).alias("five"))
    )
    listed = F.array_join(F.transform("five", lambda x: x["number"].cast("string")), ", ")
    more = F.when(c("k") > 5, F.format_string(" and %d more", c("k") - 5)).otherwise("")
    text = F.concat(
        F.lit("quantity and price stand in the description of items "), listed, more,
        F.format_string(" (such as '%s')", F.left(c("s.description"), F.lit(60))),
    )
    return issue_rows(count.join(first, "document_id"), [issue(F.lit(True), "R7", "line_items", text, rule=7)])


def truncated_items(docs: DataFrame, items: DataFrame, totals: DataFrame) -> DataFrame:
    """Items numbered 1..n while the source goes on with n+1, n+2, ...

    Only the item numbers found in a text travel to the join, never the text. Sums of
    the positions and of their squares sort out almost every document whose numbers are
    not 1..n; the few left are checked for a repeated number.
    """
    found = F.regexp_extract_all(c("markdown"), F.lit(f"(?md){V.NUMBERED_LINE}"), F.lit(1))
    small = F.array_compact(F.transform(F.array_distinct(found), lambda x: x.try_cast("long")))
    numbers = docs.select(c("id").alias("document_id"), small.alias("numbers")).filter(F.size("numbers") > 0)
    n = c("n").cast("decimal(19,0)")
    complete = totals.filter(
        (c("numbered") == c("n")) & (c("low") == 1) & (c("high") == c("n"))
        & (c("pos_sum") * 2 == n * (n + 1)) & (c("pos_squares") * 6 == n * (n + 1) * (2 * n + 1))
    ).select("document_id", "n")
    beyond = F.array_sort(F.filter("numbers", lambda x: x > c("n")))
    # numbers are distinct, so those that stand where a gapless run has them come first
    run = F.size(F.filter(beyond, lambda x, i: x == c("n") + 1 + i))
    going_on = (
        numbers.join(complete, "document_id")
        .withColumn("missing", run.cast("long"))
        .filter("missing > 0")
        .drop("numbers")
    )
    repeated = (
        items.select("document_id", "position").join(going_on, "document_id", "left_semi")
        .groupBy("document_id", "position").agg(F.count("*").alias("k")).filter("k > 1")
    )
    text = F.format_string("%d items read, the source goes on to number %d: %d rows (%d-%d) are missing",
                           c("n"), c("n") + c("missing"), c("missing"), c("n") + 1, c("n") + c("missing"))
    return issue_rows(
        going_on.join(repeated, "document_id", "left_anti"),
        [issue(F.lit(True), "R9", "line_items", text, rule=9)],
    )


def unpriced_rows(items: DataFrame, totals: DataFrame) -> DataFrame:
    """A row without quantity and price among rows that have both."""
    form = totals.filter(c("priced") >= F.greatest(F.lit(2), F.floor(c("n") / 2))).select("document_id", "priced")
    bare = items.filter(c("amount").isNotNull() & c("quantity").isNull() & c("unit_price").isNull())
    text = F.format_string("quantity and unit price are empty while %d rows have both", c("priced"))
    return issue_rows(bare.join(form, "document_id"), [_row_issue(F.lit(True), "R12", text, "warning")])


# --- composition --------------------------------------------------------------------

def _heads(docs: DataFrame, totals: DataFrame) -> DataFrame:
    return docs.select(c("id").alias("document_id"), *HEADER_FIELDS).join(
        totals.select("document_id", "n", "priced", "amounts", "taxes"), "document_id", "left"
    )


def one_rule(code: str, docs: DataFrame, items: DataFrame, as_of: str = "9999-12-31") -> DataFrame:
    """The issues of a single rule R1-R17."""
    totals = item_totals(items)
    if code == "R7":
        return collapsed_columns(items, totals)
    if code == "R9":
        return truncated_items(docs, items, totals)
    if code == "R12":
        return unpriced_rows(items, totals)
    if code in ("R10", "R11", "R13", "R14"):
        return issue_rows(items, [row_rules()[code]])
    needs_items = code in ("R6", "R8", "R15", "R16")
    heads = _heads(docs, totals) if needs_items else docs.withColumnRenamed("id", "document_id")
    return issue_rows(heads, header_rules(as_of)[code])


def rule_check(docs: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """All rules."""
    totals = item_totals(items)
    header = [i for group in header_rules(as_of).values() for i in group]
    parts = [
        issue_rows(_heads(docs, totals), header),
        issue_rows(items, list(row_rules().values())),
        collapsed_columns(items, totals),
        unpriced_rows(items, totals),
        truncated_items(docs, items, totals),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdicts(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Per document: valid iff nothing critical was found, and how much was found."""
    found = issues.groupBy("document_id").agg(
        F.count("*").alias("error_count"), F.count_if(c("severity") == "critical").alias("critical_count")
    )
    zero = lambda x: F.coalesce(c(x), F.lit(0)).alias(x)
    return docs.select(c("id").alias("document_id")).join(found, "document_id", "left").select(
        "document_id",
        (F.coalesce(c("critical_count"), F.lit(0)) == 0).alias("is_valid"),
        zero("error_count"),
        zero("critical_count"),
    )


def assign_status(checked: DataFrame) -> DataFrame:
    """V4."""
    return checked.withColumn("status", F.when(c("is_valid"), V.PENDING).otherwise(V.ERROR))


def validate(docs: DataFrame, items: DataFrame, as_of: str, extra: DataFrame | None = None) -> DataFrame:
    """Issues of extraction, rules and grounding without repeats (V2)."""
    issues = rule_check(docs, items, as_of).unionByName(grounding_check(docs))
    if extra is not None:
        issues = extra.unionByName(issues)
    return dedupe_issues(issues)


def revalidate(docs: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Rules only, repeats kept (V3)."""
    return rule_check(docs, items, as_of)
