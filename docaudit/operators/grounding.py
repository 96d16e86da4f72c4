"""Is an extracted value written in its source text?

Each document's text is normalised once; all ten fields are tested in the same
projection, so nothing is shuffled and no text is repeated per spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.dates import date_spellings, date_variants, number_variants, parse_date
from ..functions.markup import normalize
from ..functions.text import let, once, strip
from ..session import settled
from .issues import GROUNDING, issue, issue_rows

c = F.col
KINDS = dict(V.GROUNDED_FIELDS)


def spellings(value: Column, kind: str) -> Column:
    """Candidate spellings of a typed value."""
    if kind == "date":
        return date_variants(value)
    if kind == "number":
        return number_variants(value)
    return F.array(value)


def _plain(form: Column, kind: str) -> Column:
    """Spellings of numbers and parsed dates hold no entity and no run of white space."""
    return F.lower(form) if kind == "number" else normalize(form)


def appears_in(hay: Column, value: Column, kind: str) -> Column:
    """Any spelling of the value occurs in the normalised text (G1)."""
    return F.exists(spellings(value, kind), lambda s: (s != "") & F.contains(hay, _plain(s, kind)))


def _forms(value: Column, kind: str, plain: Column) -> Column:
    """Normalised spellings; `plain` is the normalised value itself."""
    if kind == "number":
        return number_variants(value)
    if kind == "text":
        return F.array(plain)
    return let(
        parse_date(value),
        lambda d: F.when(d.isNull(), F.array(plain)).otherwise(F.transform(date_spellings(d), lambda s: F.lower(s))),
    )


def _found(hay: Column, forms: Column) -> Column:
    return F.exists(forms, lambda s: (s != "") & F.contains(hay, s))


def _first_part(value: Column) -> Column:
    """First line or comma part of a text value."""
    return strip(F.get(F.split(value, "[\n,]"), F.lit(0)))


def _check(hay: Column, name: str, kind: str, plain: Column, plain_head: Column) -> Column:
    """One stated field against the text; NULL when the document does not state it."""
    value = c(name)
    stated = value.isNotNull() & (value != "") if kind != "number" else value.isNotNull()

    def outcome(found):
        head = F.lit(None).cast("string")
        if kind == "text":
            part = _first_part(value)
            usable = ~found & (plain_head != "") & (part != value) & F.contains(hay, plain_head)
            head = F.when(usable, part)
        return F.struct(
            F.lit(name).alias("field"),
            value.cast("string").alias("value"),
            found.alias("found"),
            (found & parse_date(value).isNull() if kind == "date" else F.lit(False)).alias("no_date"),
            head.alias("head"),
        )

    return F.when(stated, let(_found(hay, _forms(value, kind, plain)), outcome))


def _all_checks() -> Column:
    texts = [n for n, k in V.GROUNDED_FIELDS if k != "number"]
    names = [n for n, k in V.GROUNDED_FIELDS if k == "text"]
    raw = F.array(*[c(n) for n in texts], *[_first_part(c(n)) for n in names])

    def check(hay):
        def all_fields(plain):
            at = lambda i: F.get(plain, F.lit(i))
            out = []
            for n, k in V.GROUNDED_FIELDS:
                own = at(texts.index(n)) if n in texts else None
                head = at(len(texts) + names.index(n)) if n in names else None
                out.append(_check(hay, n, k, own, head))
            return F.array_compact(F.array(*out))

        return let(F.transform(raw, normalize), all_fields)

    return let(normalize(F.coalesce(c("markdown"), F.lit(""))), check)


_CHECKS = once(_all_checks)


def field_checks(docs: DataFrame, *keep: str) -> DataFrame:
    """One array of (field, value, found, no_date, head) per document.

    `head` is the part of a text value that is found where the whole is not.
    """
    return docs.select("id", *keep, _CHECKS().alias("checks"))


def grounding_check(docs: DataFrame) -> DataFrame:
    """A critical issue for every stated value its text does not contain."""
    order = F.array_position(F.array(*[F.lit(n) for n in KINDS]), c("f.field"))
    rows = field_checks(docs).select(
        c("id").alias("document_id"), F.explode_outer("checks").alias("f")
    ).filter(~c("f.found"))
    text = F.format_string("%s '%s' does not occur in the source", c("f.field"), c("f.value"))
    return issue_rows(rows, [issue(F.lit(True), "G2", c("f.field"), text, stage=GROUNDING, rule=1, row=order)])


def drop_ungrounded(docs: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents without the values their text does not contain, and the warnings.

    A text value whose first line or comma part is found keeps that part. A date field
    holding something found that is no date is emptied as well. With a label the judged
    documents are settled under it, for callers that need both results.
    """
    verdict = lambda f: (
        F.when(f["found"] & f["no_date"], "G3_NOT_A_DATE")
        .when(~f["found"] & f["head"].isNotNull(), "G3_FIRST_PART")
        .when(~f["found"], "G3_NOT_FOUND")
    )
    dropped = F.filter(
        F.transform(
            "checks",
            lambda f: F.struct(f["field"].alias("field"), f["value"].alias("value"), f["head"].alias("head"), verdict(f).alias("code")),
        ),
        lambda f: f["code"].isNotNull(),
    )
    keep = [x for x in docs.columns if x != "id"]
    judged = field_checks(docs, *keep).withColumn("dropped", dropped).drop("checks")
    judged = settled(judged, label) if label else judged

    def cleaned(name, kind):
        hit = F.get(F.filter("dropped", lambda f: f["field"] == name), F.lit(0))
        if kind == "text":
            return F.when(hit.isNull(), c(name)).otherwise(F.when(hit["code"] == "G3_FIRST_PART", hit["head"])).alias(name)
        return F.when(hit.isNull(), c(name)).alias(name)

    kept = judged.select(*[cleaned(x, KINDS[x]) if x in KINDS else c(x) for x in docs.columns])
    order = F.array_position(F.array(*[F.lit(n) for n in KINDS]), c("f.field"))
    rows = judged.select(c("id").alias("document_id"), F.explode_outer("dropped").alias("f")).filter(c("f").isNotNull())
    texts = {
        "G3_NOT_A_DATE": F.format_string("%s '%s' is in the source but is no date; emptied", c("f.field"), c("f.value")),
        "G3_FIRST_PART": F.format_string("%s differs from the source; only its first part '%s' kept", c("f.field"), c("f.head")),
        "G3_NOT_FOUND": F.format_string("%s '%s' does not occur in the source; emptied", c("f.field"), c("f.value")),
    }
    issues = issue_rows(
        rows,
        [issue(c("f.code") == k, k, c("f.field"), t, "warning", stage=0, rule=1, row=order) for k, t in texts.items()],
    )
    return kept, issues


def grounding_report(docs: DataFrame, mutated: DataFrame) -> DataFrame:
    """False alarms on true values and detections on altered ones."""

    def rate(df, flag):
        return df.select(F.lit(flag).alias("mutated"), F.explode_outer("checks").alias("f")).select(
            "mutated", c("f.found").alias("found")
        ).filter(c("found").isNotNull())

    both = rate(field_checks(docs), False).unionByName(rate(field_checks(mutated), True))
    return both.groupBy("mutated").agg(F.count("*").alias("n_values"), F.count_if(~c("found")).alias("flagged"))
