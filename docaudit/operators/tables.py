"""Line items read from Markdown tables.

A document is one row, and everything its tables need lies in that row, so the whole
reading is a projection: no shuffle, no sort, and the work splits with the input. Cells
are classified once (`typed_rows`); mapping, scoring and building then only compare
numbers. The mapping that later pages inherit is carried by a fold over the tables of
the document.

A mapping is struct<d, p, t, a, q>: the column indexes of description, unit price, tax,
amount and quantity, NULL where absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as fc
from ..functions import fixed_values as V
from ..functions.text import any_of, cast_found, close_to, let, once, strip, to_number, to_text

SLOTS = {"description": "d", "unit_price": "p", "tax": "t", "amount": "a", "quantity": "q"}
MAPPING = "struct<d:int,p:int,t:int,a:int,q:int>"
ITEM = "struct<pos:int,d:string,q:double,p:double,a:double,t:double>"
_NO_TABLE = "￿"
_BLANKS = r"[\s\x1c-\x1f&&[^\n]]*"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _indexes(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _first(values: Column, keep) -> Column:
    return F.get(F.filter(values, keep), F.lit(0))


def _mapping(**idx) -> Column:
    return F.struct(*[idx.get(k, _none("int")).cast("int").alias(k) for k in ("d", "p", "t", "a", "q")])


def _used(m: Column, i: Column) -> Column:
    """Column i belongs to the mapping."""
    return F.array_contains(F.array_compact(F.array(*[m[k] for k in "dptaq"])), i)


# --- P1 -----------------------------------------------------------------------------

def _split_row(line: Column) -> Column:
    return F.transform(F.split(F.btrim(strip(line), F.lit("|")), r"\|", -1), strip)


def _is_separator(cells: Column) -> Column:
    return F.array_join(cells, "").rlike(r"^[-: ]+$")


def table_rows(markdown: Column) -> Column:
    """array<table<row<cell>>>: consecutive lines that start with a pipe, without separators."""
    lines = F.regexp_replace(markdown, V.LINE_BREAKS, "\n")
    blocks = F.split(F.regexp_replace(lines, rf"(?mdU)^(?!{_BLANKS}\|).*$", _NO_TABLE), _NO_TABLE)
    is_row = lambda x: x.rlike(rf"(?dU)^{_BLANKS}\|")
    rows = lambda block: F.filter(
        F.transform(F.filter(F.split(block, "\n"), is_row), _split_row), lambda r: ~_is_separator(r)
    )
    with_rows = F.filter(blocks, lambda b: F.contains(b, F.lit("|")))
    return F.filter(F.transform(with_rows, rows), lambda t: F.size(t) > 0)


def explode_table_rows(docs: DataFrame) -> DataFrame:
    """P1 as rows: (document_id, table_no, row_no, cells); row 0 is the header."""
    return docs.select(
        "document_id", F.posexplode_outer(table_rows(F.col("markdown"))).alias("table_no", "t")
    ).select("document_id", "table_no", F.posexplode_outer("t").alias("row_no", "cells")).filter(F.col("cells").isNotNull())


def _cell(t: Column) -> Column:
    """A stripped cell with everything later steps ask about it.

    Cells without a digit, most descriptions, skip the number patterns; a cell that is
    only a number holds no quantity or price besides itself.
    """

    def described(flags):
        digit, number = flags["digit"], flags["number"]
        inner = digit & ~number
        short = F.length(t) <= max(map(len, V.BLANK_WORDS))
        x = F.when(short & F.lower(t).isin(V.BLANK_WORDS), "").otherwise(t)
        return F.struct(
            t.alias("t"),
            x.alias("x"),
            F.when(digit, to_number(t)).alias("v"),
            number.alias("d"),
            F.when(number, fc.item_number_cell(t)).alias("k"),
            F.when(inner, fc.embedded_quantities(x)).alias("e"),
            F.when(inner, to_number(fc.trailing_number(x))).alias("tn"),
            F.when(inner, fc.before_trailing_number(x)).alias("th"),
        )

    return let(F.struct(t.rlike("[0-9]").alias("digit"), fc.is_number_cell(t).alias("number")), described)


def _typed_row(cells: Column) -> Column:
    return F.struct(fc.is_summary_row(cells).alias("s"), F.transform(cells, _cell).alias("c"))


def typed_rows(rows: Column) -> Column:
    return F.transform(rows, _typed_row)


# --- P2 -----------------------------------------------------------------------------

def map_columns(header: Column) -> Column:
    """Mapping named by the header cells (strings); each field takes the leftmost free column."""
    names = F.transform(header, lambda x: F.lower(strip(x)))

    def assign(names, done: dict, todo: list):
        if not todo:
            return _mapping(**done)
        (field, hints), rest = todo[0], todo[1:]

        def fits(i):
            name = F.get(names, i)
            ok = name.rlike(any_of(hints))
            if field == "description":
                ok = ok & ~F.regexp_replace(name, ":+$", "").isin(V.ROW_NUMBER_NAMES)
            for taken in done.values():
                ok = ok & ~F.coalesce(i == taken, F.lit(False))
            return ok

        return let(
            _first(_indexes(F.size(names)), fits),
            lambda i: assign(names, {**done, SLOTS[field]: i}, rest),
        )

    return let(names, lambda n: assign(n, {}, list(V.COLUMN_HINTS)))


# --- P3, P4 -------------------------------------------------------------------------

def _stated(data: Column, i: Column) -> Column:
    """The cells of a column that are not empty."""
    return F.filter(F.transform(data, lambda r: F.get(r["c"], i)), lambda x: x.isNotNull() & (x["t"] != ""))


def _mostly(col: Column, test) -> Column:
    n = F.size(col)
    return F.when(n > 0, F.size(F.filter(col, lambda x: test(x["t"]))) / n >= 0.6).otherwise(F.lit(False))


def column_shapes(rows: Column, marks: bool = True, numeric: bool = False) -> Column:
    """Per column of typed rows: is it numeric, its mean text length, money and unit marks.

    The marks are looked for only where a caller weighs them, with `numeric` in numeric columns.
    """

    def shapes(data):
        width = F.coalesce(F.array_max(F.transform(data, lambda r: F.size(r["c"]))), F.lit(0))

        def shape(i):
            def measure(col):
                n = F.size(col)
                text = F.aggregate(
                    F.filter(col, lambda x: ~x["d"]), F.lit(0), lambda acc, x: acc + F.length(x["t"])
                )
                num = F.when(n > 0, F.size(F.filter(col, lambda x: x["d"])) / n >= 0.8).otherwise(F.lit(False))

                def marked(num):
                    mark = lambda test: F.when(num, _mostly(col, test)).otherwise(F.lit(False)) if numeric else _mostly(col, test)
                    return F.struct(
                        i.alias("i"),
                        num.alias("num"),
                        F.when(n > 0, text / n).otherwise(F.lit(0.0)).alias("len"),
                        (mark(fc.has_currency) if marks else F.lit(False)).alias("money"),
                        (mark(fc.has_unit) if marks else F.lit(False)).alias("unit"),
                    )

                return let(num, marked)

            return let(_stated(data, i), measure)

        return F.transform(_indexes(width), shape)

    return let(F.filter(rows, lambda r: ~r["s"]), shapes)


def _longest(shapes: Column) -> Column:
    """Index of the column with the longest text, the leftmost on a tie."""
    best = F.array_max(F.transform(shapes, lambda s: s["len"]))
    return let(best, lambda b: _first(shapes, lambda s: s["len"] == b))["i"]


# --- P12 ----------------------------------------------------------------------------

def build_item(cells: Column, m: Column) -> Column:
    """Item of one row of typed cells, NULL when the row is none.

    Values that layout shifts moved to a neighbouring cell are taken back only where
    quantity x unit price = amount proves it.
    """
    at = lambda k: F.get(cells, m[k])
    truthy = lambda x: x.isNotNull() & (x != 0)

    def read(w):
        swap = F.when(w == "p", at("p")).when(w == "q", at("q")).when(w == "t", at("t"))
        keep = lambda k: F.when(F.coalesce(w != k, F.lit(True)), at(k)["v"])
        pick = lambda normal, swapped: F.when(w.isNull(), at("d")[normal]).otherwise(swap[swapped])
        return F.struct(
            F.when(w.isNotNull(), at("d")["k"]).alias("pos"),
            F.coalesce(pick("x", "t"), F.lit("")).alias("d"),
            F.coalesce(pick("e", "e"), F.array().cast("array<double>")).alias("e"),
            pick("tn", "tn").alias("tn"),
            pick("th", "th").alias("th"),
            keep("q").alias("q"),
            keep("p").alias("p"),
            at("a")["v"].alias("a"),
            keep("t").alias("t"),
        )

    def repair(r):
        nothing = r["a"].isNull() & r["p"].isNull() & r["q"].isNull() & r["t"].isNull()
        no_item = ((r["d"] == "") & r["a"].isNull()) | (nothing & ~F.exists(cells, lambda x: x["d"]))
        tail_count = F.when(
            r["p"].isNull() & r["a"].isNotNull() & truthy(r["tn"]),
            _first(r["e"], lambda n: close_to(n * r["tn"], r["a"])),
        )

        def with_tail(count):
            price = F.when(count.isNotNull(), r["tn"]).otherwise(r["p"])
            free = F.filter(cells, lambda x, i: ~_used(m, i) & x["v"].isNotNull())
            spare = F.when(
                r["a"].isNull() & truthy(price),
                _first(free, lambda x: F.exists(r["e"], lambda n: close_to(n * price, x["v"])))["v"],
            )

            def finish(v):
                quantity = F.coalesce(
                    count,
                    r["q"],
                    F.when(truthy(v["p"]) & v["a"].isNotNull(), _first(r["e"], lambda n: close_to(n * v["p"], v["a"]))),
                )
                return F.struct(
                    r["pos"].alias("pos"),
                    F.when(count.isNotNull(), r["th"]).otherwise(r["d"]).alias("d"),
                    quantity.alias("q"), v["p"].alias("p"), v["a"].alias("a"), r["t"].alias("t"),
                )

            return let(F.struct(price.alias("p"), F.coalesce(r["a"], spare).alias("a")), finish)

        return F.when(~no_item, let(tail_count, with_tail))

    worded = lambda k: at(k)["t"].rlike(r"\p{L}")
    has_letters = F.when(worded("p"), "p").when(worded("q"), "q").when(worded("t"), "t")
    swapped = F.when(at("d")["k"].isNotNull(), has_letters)
    return let(let(swapped, read), repair)


# --- P5-P9 --------------------------------------------------------------------------

def _built(rows: Column, m: Column) -> Column:
    """The item of every row but the summary rows, NULL where a row is none."""
    return F.transform(F.filter(rows, lambda r: ~r["s"]), lambda r: build_item(r["c"], m))


def score_mapping(rows: Column, m: Column) -> Column:
    """struct<n, ok>: rows that can be checked under a mapping, and those that check out."""
    return _score(_built(rows, m))


def _score(items: Column) -> Column:
    full = F.filter(items, lambda x: x["q"].isNotNull() & x["p"].isNotNull() & x["a"].isNotNull())
    return let(
        full,
        lambda f: F.struct(
            F.size(f).alias("n"),
            F.size(F.filter(f, lambda x: close_to(x["q"] * x["p"], x["a"]))).alias("ok"),
        ),
    )


def _share(score: Column) -> Column:
    return F.when(score["n"] > 0, score["ok"] / score["n"]).otherwise(F.lit(0.0))


def candidate_mappings(shapes: Column) -> Column:
    """Mappings the column shapes allow, in the order price, amount, quantity (P5)."""
    num = F.filter(shapes, lambda s: s["num"])
    texts = F.filter(shapes, lambda s: ~s["num"] & (s["len"] >= 3))
    counted = F.exists(shapes, lambda s: s["unit"])

    def of_price(p):
        def of_amount(a):
            base = _mapping(d=_longest(texts), p=p["i"], a=a["i"])
            quantities = F.filter(
                num,
                lambda q: (q["i"] != p["i"]) & (q["i"] != a["i"]) & ~q["money"] & (~counted | q["unit"]),
            )
            return F.concat(
                F.array(base),
                F.transform(quantities, lambda q: _mapping(d=_longest(texts), p=p["i"], a=a["i"], q=q["i"])),
            )

        return F.flatten(F.transform(F.filter(num, lambda a: (a["i"] != p["i"]) & ~a["unit"]), of_amount))

    every = F.flatten(F.transform(F.filter(num, lambda p: ~p["unit"]), of_price))
    return F.when((F.size(num) >= 2) & (F.size(texts) > 0), every).otherwise(F.array().cast(f"array<{MAPPING}>"))


def _allowed(rows: Column, shapes: Column) -> Column:
    """struct<p, a, q: column indexes that may be price, amount, quantity; d: the description>.

    `shapes` has the marks of numeric columns; units in the others are looked for where none has one.
    """
    num = F.filter(shapes, lambda s: s["num"])
    texts = F.filter(shapes, lambda s: ~s["num"] & (s["len"] >= 3))
    worded = F.filter(shapes, lambda s: ~s["num"])
    in_words = let(F.filter(rows, lambda r: ~r["s"]), lambda data: F.exists(worded, lambda s: _mostly(_stated(data, s["i"]), fc.has_unit)))
    counted = F.exists(num, lambda s: s["unit"]) | in_words
    unmarked = F.transform(F.filter(num, lambda s: ~s["unit"]), lambda s: s["i"])
    quantities = let(counted, lambda any_unit: F.transform(F.filter(num, lambda q: ~q["money"] & (~any_unit | q["unit"])), lambda s: s["i"]))
    enough = (F.size(num) >= 2) & (F.size(texts) > 0)
    return F.when(enough, F.struct(
        unmarked.alias("p"), unmarked.alias("a"), quantities.alias("q"), _longest(texts).alias("d"),
        F.transform(num, lambda s: s["i"]).alias("n"), F.size(shapes).cast("long").alias("w"),
    ))


_BIN = 0.05
"""Amounts are looked up in bins wider than twice the tolerance, so that a product meets two bins."""
_MARGIN = 0.021
_FINE = 1e12
"""Beyond, doubles lie too far apart for the margin, and a product is compared with all amounts."""


def _by_amount(values: Column, allowed: Column) -> Column:
    """struct<bins, places>: the columns of each bin of amounts of a row, and all of them."""
    found = F.filter(allowed, lambda a: F.get(values, a).isNotNull())
    bin_of = lambda a: F.floor(F.get(values, a) / _BIN)
    return let(
        F.array_distinct(F.transform(found, bin_of)),
        lambda bins: F.struct(
            F.map_from_arrays(bins, F.transform(bins, lambda b: F.filter(found, lambda a: bin_of(a) == b))).alias("bins"),
            found.alias("places"),
        ),
    )


def _matches(product: Column, row: Column) -> Column:
    """The columns whose amount a product agrees with."""
    low, high = F.floor((product - _MARGIN) / _BIN), F.floor((product + _MARGIN) / _BIN)
    at = lambda b: F.coalesce(F.try_element_at(row["by"]["bins"], b), F.array().cast("array<int>"))
    binned = F.when(low == high, at(low)).otherwise(F.concat(at(low), at(high)))
    near = F.when(F.abs(product) < _FINE, binned).otherwise(row["by"]["places"])
    return F.filter(near, lambda a: close_to(product, F.get(row["v"], a)))


def _code(width: Column, p: Column, a: Column, q: Column) -> Column:
    """Number of a triple, in the order price, amount, quantity; -1 for no quantity, which comes first."""
    return (p * width + a) * (width + 1) + q + 1


def _decoded(code: Column, allowed: Column) -> Column:
    width = allowed["w"]
    base, q = F.call_function("div", code, width + 1), code % (width + 1) - 1
    return _mapping(d=allowed["d"], p=F.call_function("div", base, width), a=base % width, q=F.when(q >= 0, q))


def _all_stated(values: Column, m: Column) -> Column:
    return F.forall(F.array(m["p"], m["a"], m["q"]), lambda i: F.get(values, i).isNotNull())


def _proven(rows: Column, allowed: Column, price: Column) -> Column:
    """For one price column the triples that some row proves: array<struct<code, ok, n>>.

    `ok` rows prove a triple, and `n` rows hold numbers in its three cells. Rows are counted by
    sorting the codes of all matches, so the work grows with pairs of columns and with matches.
    """

    def codes(row):
        p = F.get(row["v"], price)
        others = F.filter(allowed["q"], lambda q: (q != price) & F.get(row["v"], q).isNotNull())
        hits = F.flatten(F.transform(others, lambda q: let(F.get(row["v"], q) * p, lambda product: F.transform(
            F.filter(_matches(product, row), lambda a: (a != price) & (a != q)), lambda a: _code(allowed["w"], price, a, q)))))
        return F.when(p.isNotNull(), hits).otherwise(F.array().cast("array<bigint>"))

    def count(found):
        full = lambda code: let(
            _decoded(code, allowed), lambda m: F.size(F.filter(rows, lambda r: _all_stated(r["v"], m))))
        starts = F.filter(_indexes(F.size(found)), lambda i: (i == 0) | (F.get(found, i) != F.get(found, i - 1)))
        return let(starts, lambda begins: F.transform(begins, lambda i, k: F.struct(
            F.get(found, i).alias("code"), (F.coalesce(F.get(begins, k + 1), F.size(found)) - i).alias("ok"),
            full(F.get(found, i)).alias("n"))))

    return let(F.sort_array(F.flatten(F.transform(rows, codes))), count)


def _unproven(d: Column, allowed: Column, listed: Column, with_quantity: Column) -> Column:
    """Candidates that no row proves by its three cells, as array<struct<code, ok, n>>.

    Without a quantity, only pairs that two rows could be repaired for are candidates.
    """
    width, none = allowed["w"], F.lit(-1).cast("long")

    def repairable(p, a):
        cell = lambda r, i: F.get(r["c"], i)["v"]
        may = lambda r: cell(r, p).isNull() | cell(r, a).isNull() | F.exists(
            F.get(r["c"], allowed["d"])["e"], lambda n: close_to(n * cell(r, p), cell(r, a)))
        return F.size(d["odd"]) + F.size(F.filter(d["worded"], may)) >= 2

    def of_amount(p, a):
        entry = lambda code, n: F.struct(code.alias("code"), F.lit(0).alias("ok"), n.alias("n"))
        bare = F.when(repairable(p, a), F.array(entry(_code(width, p, a, none), F.lit(0)))).otherwise(
            F.array().cast("array<struct<code:bigint,ok:int,n:int>>"))
        full = lambda q: F.size(F.filter(d["plain"], lambda r: _all_stated(r["v"], F.struct(p.alias("p"), a.alias("a"), q.alias("q")))))
        others = F.filter(allowed["q"], lambda q: (q != p) & (q != a) & ~F.array_contains(listed, _code(width, p, a, q)))
        counted = F.transform(others, lambda q: entry(_code(width, p, a, q), full(q)))
        return F.concat(bare, F.when(with_quantity, counted).otherwise(F.slice(counted, 1, 0)))

    return F.flatten(F.transform(allowed["p"], lambda p: F.flatten(
        F.transform(F.filter(allowed["a"], lambda a: a != p), lambda a: of_amount(p, a)))))


def best_candidate(rows: Column, shapes: Column, least: Column) -> Column:
    """Of the candidate mappings (P5) the one of the highest score above `least`, the first on a tie.

    A row that holds numbers in the three cells of a triple counts by them alone, unless its
    description is a row number. So the triples come from the data (`_proven`). Rows with a cell
    missing count only where a quantity in their text repairs them; they bound how much a score
    can gain. Triples are scored on such rows from the highest bound down, until none can win.
    """

    def choose(allowed):
        described = lambda r: F.get(r["c"], allowed["d"])
        data = F.filter(rows, lambda r: ~r["s"])
        numbered = lambda r: described(r)["k"].isNotNull()
        values = lambda r: F.transform(r["c"], lambda x: x["v"])
        whole = lambda r: F.forall(allowed["n"], lambda i: F.get(r["c"], i)["v"].isNotNull())

        def part(unnumbered):
            worded = F.filter(unnumbered, lambda r: F.coalesce(F.size(described(r)["e"]) > 0, F.lit(False)))
            plain = F.transform(unnumbered, lambda r: let(values(r), lambda v: F.struct(v.alias("v"), _by_amount(v, allowed["a"]).alias("by"))))
            return F.struct(
                F.filter(data, numbered).alias("odd"), worded.alias("worded"), plain.alias("plain"),
                F.size(F.filter(unnumbered, whole)).alias("complete"), F.size(F.filter(worded, lambda r: ~whole(r))).alias("loose"),
            )

        return let(let(F.filter(data, lambda r: ~numbered(r)), part), lambda d: weigh(d, allowed))

    def weigh(d, allowed):
        proven = F.flatten(F.transform(allowed["p"], lambda p: _proven(d["plain"], allowed, p)))
        return let(proven, lambda found: settle(d, allowed, found))

    def settle(d, allowed, found):
        spare = F.size(d["odd"]) + d["loose"]
        bound = lambda ok, n: F.when(n + spare > 0, (ok + spare) / (n + spare)).otherwise(0.0)
        # without a quantity every row that counts has been repaired to agree
        hope = lambda x: F.when(x["code"] % (allowed["w"] + 1) == 0, 1.0).otherwise(bound(x["ok"], x["n"]))
        entry = lambda x: F.struct((-hope(x)).alias("rank"), x["code"].alias("code"), x["ok"].alias("ok"), x["n"].alias("n"))
        ranked = lambda cands: F.sort_array(F.transform(cands, entry))
        start = F.struct(_none("double").alias("v"), _none("bigint").alias("code"))
        by_cells = F.aggregate(ranked(found), start, lambda acc, x: step(acc, x, d, allowed))

        def beyond(best):
            gain = bound(F.lit(0), d["complete"]) >= F.coalesce(best["v"], least)
            rest = _unproven(d, allowed, F.transform(found, lambda x: x["code"]), gain)
            more = F.aggregate(ranked(rest), best, lambda acc, x: step(acc, x, d, allowed))
            return F.when((F.size(d["worded"]) > 0) | (F.size(d["odd"]) > 0), more).otherwise(best)

        return let(let(by_cells, beyond), lambda b: F.when(b["code"].isNotNull(), _decoded(b["code"], allowed)))

    def step(acc, x, d, allowed):
        better = lambda v: acc["v"].isNull() | (v > acc["v"]) | ((v == acc["v"]) & (x["code"] < acc["code"]))
        hope = -x["rank"]

        def on_rest(m):
            lacking = F.filter(d["worded"], lambda r: ~_all_stated(F.transform(r["c"], lambda y: y["v"]), m))
            return let(F.concat(d["odd"], lacking), lambda rest: F.when(F.size(rest) > 0, score_mapping(rest, m)).otherwise(
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("ok"))))

        def judge(s):
            n, ok = x["n"] + s["n"], x["ok"] + s["ok"]
            share = F.when(n > 0, ok / n).otherwise(0.0)
            wins = (n >= 2) & (share > least) & better(share)
            return F.when(wins, F.struct(share.alias("v"), x["code"].alias("code"))).otherwise(acc)

        return F.when((hope > least) & better(hope), let(let(_decoded(x["code"], allowed), on_rest), judge)).otherwise(acc)

    return let(_allowed(rows, shapes), lambda allowed: F.when(allowed.isNotNull(), choose(allowed)))


def best_mapping(header_mapping: Column, rows: Column) -> Column:
    """The header's mapping if the arithmetic agrees, else the best other one."""
    return _settled_mapping(header_mapping, rows)["m"]


def _settled_mapping(header_mapping: Column, rows: Column) -> Column:
    """struct<m, items>: the mapping, and the items of all rows where they were built for its score."""

    def judge(items):
        def choose(own):
            found = let(column_shapes(rows, numeric=True), lambda s: best_candidate(rows, s, _share(own)))
            other = F.when(~((own["n"] > 0) & (_share(own) >= 0.5)), found)
            return let(other, lambda o: F.struct(F.coalesce(o, header_mapping).alias("m"), F.when(o.isNull(), items).alias("items")))

        return let(_score(items), choose)

    return let(_built(rows, header_mapping), judge)


def infer_mapping(rows: Column) -> Column:
    """Mapping of a table without header: the last two numeric columns are price and amount."""

    def infer(shapes):
        num = F.filter(shapes, lambda s: s["num"])

        def place(ends):
            p, a = ends["p"], ends["a"]
            rest = F.filter(shapes, lambda s: (s["i"] != p) & (s["i"] != a))
            wordy = let(_longest(rest), lambda d: F.when(F.get(shapes, d)["len"] >= 3, d))

            def complete(d):
                others = F.filter(num, lambda s: (s["i"] != p) & (s["i"] != a))
                proven = _first(
                    others,
                    lambda s: let(score_mapping(rows, _mapping(d=d, p=p, a=a, q=s["i"])), lambda x: (x["n"] > 0) & (_share(x) >= 0.8)),
                )["i"]
                return F.when(d.isNotNull(), _mapping(d=d, p=p, a=a, q=proven))

            return let(wordy, complete)

        ends = F.struct(
            F.element_at(num, F.lit(-2))["i"].alias("p"), F.element_at(num, F.lit(-1))["i"].alias("a")
        )
        enough = (F.size(shapes) >= 3) & (F.size(num) >= 2)
        return F.when(enough, let(ends, place))

    return F.when(F.size(rows) >= 2, let(column_shapes(rows, marks=False), infer))


def single_amount_mapping(rows: Column) -> Column:
    """A table with one numeric column: that is the amount."""

    def single(shapes):
        num = F.filter(shapes, lambda s: s["num"])
        texts = F.filter(shapes, lambda s: ~s["num"] & (s["len"] >= 3))
        fits = (F.size(num) == 1) & (F.size(texts) > 0)
        return F.when(fits, _mapping(d=_longest(texts), a=F.get(num, F.lit(0))["i"]))

    return let(column_shapes(rows, marks=False), single)


# --- P10, P11 -----------------------------------------------------------------------

STEP = f"struct<m:{MAPPING},header:boolean,items:array<{ITEM}>>"
"""A table's mapping, whether its first row is a header, and its items if its score has built them."""


def _step(m: Column, header: bool, items: Column | None = None) -> Column:
    built = _none(f"array<{ITEM}>") if items is None else items.cast(f"array<{ITEM}>")
    return F.struct(m.alias("m"), F.lit(header).alias("header"), built.alias("items"))


def own_mappings(tables: Column) -> Column:
    """Per table what its header alone decides: NULL where it decides nothing."""

    def own(table):
        first, data = F.get(table, F.lit(0))["c"], F.slice(table, 2, F.size(table))

        def by_header(hm):
            named = hm["d"].isNotNull() & hm["a"].isNotNull()
            priced = hm["p"].isNotNull() & hm["a"].isNull() & (F.size(data) >= 2)
            by_score = let(_settled_mapping(hm, data), lambda x: _step(x["m"], True, x["items"]))
            return F.when(named, by_score).when(priced, _step(single_amount_mapping(data), True))

        return let(map_columns(F.transform(first, lambda x: x["t"])), by_header)

    return F.transform(tables, own)


def resolve_fragments(tables: Column, own: Column) -> Column:
    """Per table its mapping and whether the first row is a header (P10).

    A fold over the tables of the document: a table whose header decides nothing
    continues the mapping before it when shape or arithmetic says so, or is skipped.
    """

    def inherit(active, table):
        first = F.get(table, F.lit(0))["c"]
        width = F.greatest(*[active[k] for k in "dptaq"]) + 1
        continues = F.coalesce(F.get(first, active["a"])["d"], F.lit(False)) & (F.size(first) == width)
        proven = let(_built(table, active), lambda items: let(_score(items), lambda s: F.when(
            (s["n"] > 0) & (_share(s) >= 0.5), _step(active, False, items)).otherwise(_step(infer_mapping(table), False))))
        return F.when(active.isNull(), _none(STEP)).when(continues, _step(active, False)).otherwise(proven)

    def fold(acc, x):
        step = F.when(x["own"].isNotNull(), x["own"]).otherwise(inherit(acc["active"], x["table"]))
        return let(
            step,
            lambda s: F.struct(
                F.coalesce(s["m"], acc["active"]).alias("active"), F.concat(acc["plan"], F.array(s)).alias("plan")
            ),
        )

    start = F.struct(_none(MAPPING).alias("active"), F.array().cast(f"array<{STEP}>").alias("plan"))
    zipped = F.arrays_zip(tables.alias("table"), own.alias("own"))
    return F.aggregate(zipped, start, fold, lambda acc: acc["plan"])


def merge_spilled_text(rows: Column, m: Column) -> Column:
    """Text columns outside the mapping are part of the description."""

    def merge(spill):
        order = F.array_sort(F.concat(spill, F.array(m["d"])))

        def one(r):
            cells = r["c"]
            texts = F.filter(F.transform(order, lambda i: F.get(cells, i)["t"]), lambda x: x.isNotNull() & (x != ""))
            joined = F.array_join(texts, " ")
            merged = F.transform(
                cells,
                lambda x, i: F.when(i == m["d"], joined).when(F.array_contains(spill, i), "").otherwise(x["t"]),
            )
            return F.when(r["s"], r).otherwise(let(merged, _typed_row))

        return F.when(F.size(spill) == 0, rows).otherwise(F.transform(rows, one))

    outside = F.filter(column_shapes(rows, marks=False), lambda s: ~_used(m, s["i"]) & ~s["num"] & (s["len"] > 0))
    return F.when(_unmapped(rows, m), let(F.transform(outside, lambda s: s["i"]), merge)).otherwise(rows)


def _unmapped(rows: Column, m: Column) -> Column:
    """Some column lies outside of the mapping."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r["c"])))
    return F.exists(_indexes(F.coalesce(width, F.lit(0))), lambda i: ~_used(m, i))


# --- P13-P15 ------------------------------------------------------------------------

def number_column(rows: Column, m: Column) -> Column:
    """Unmapped column that counts up by one from row to row."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r["c"]))), F.lit(0))
    data = F.filter(rows, lambda r: ~r["s"])

    def counts_up(i):
        values = F.transform(F.filter(data, lambda r: F.size(r["c"]) > i), lambda r: F.get(r["c"], i)["k"])
        return let(
            values,
            lambda v: (F.size(v) >= 2) & F.forall(v, lambda x: x.isNotNull())
            & (v == F.sequence(F.get(v, F.lit(0)), F.get(v, F.lit(0)) + F.size(v) - 1)),
        )

    return _first(_indexes(width), lambda i: ~_used(m, i) & F.coalesce(counts_up(i), F.lit(False)))


def _strictly_ascending(v: Column) -> Column:
    return v == F.array_sort(F.array_distinct(v))


def strip_row_numbers(items: Column) -> Column:
    """Row numbers glued to the descriptions of a fragment become positions."""
    pattern = f"(?U){V.LEADING_ITEM_NUMBER}"
    leading = F.transform(items, lambda x: cast_found(F.regexp_extract(x["d"], pattern, 1), "int"))

    def settle(lead):
        def with_present(present):
            most = F.size(present) >= F.greatest(F.lit(2), F.floor(F.size(lead) * 0.6))
            ascending = most & _strictly_ascending(present)

            def one(x, i):
                n = F.get(lead, i)
                rest = strip(F.regexp_replace(x["d"], pattern, ""))
                stripped = F.struct(n.alias("pos"), rest.alias("d"), *[x[k].alias(k) for k in "qpat"])
                return F.when(n.isNotNull() & (ascending | (n == i + 1)) & (rest != ""), stripped).otherwise(x)

            return F.transform(items, one)

        return let(F.array_compact(lead), with_present)

    return let(leading, settle)


def keep_document_numbers(items: Column) -> Column:
    """Positions stay only if every item has one and they strictly ascend."""

    def settle(pos):
        trusted = F.forall(pos, lambda x: x.isNotNull()) & _strictly_ascending(pos)
        bare = lambda x: F.struct(_none("int").alias("pos"), *[x[k].alias(k) for k in "dqpat"])
        return F.when(trusted, items).otherwise(F.transform(items, bare))

    return let(F.transform(items, lambda x: x["pos"]), settle)


def fragment_items(rows: Column, m: Column, built: Column) -> Column:
    """Items of one table whose mapping is settled; `built` holds those of its rows where they are known."""

    def read(number):
        def placed(x, r):
            pos = F.coalesce(F.get(r["c"], number)["k"], x["pos"]).alias("pos")
            return F.when(x.isNotNull(), F.struct(pos, *[x[k].alias(k) for k in "dqpat"]))

        made = F.coalesce(built, _built(rows, m).cast(f"array<{ITEM}>"))
        items = F.zip_with(made, F.filter(rows, lambda r: ~r["s"]), placed)
        return let(F.array_compact(items), strip_row_numbers)

    return let(number_column(rows, m), read)


# --- P16 ----------------------------------------------------------------------------

def _read_rows() -> Column:
    zipped = F.arrays_zip(F.col("tables").alias("table"), F.col("plan").alias("step"))

    def rows(x):
        m, below, items = x["step"]["m"], F.slice(x["table"], 2, F.size(x["table"])), x["step"]["items"]
        fragment = lambda rows, built: F.struct(m.alias("m"), rows.alias("rows"), built.alias("items"))
        merged = let(merge_spilled_text(below, m), lambda rows: fragment(rows, F.when(rows == below, items)))
        whole = F.when(_unmapped(below, m), merged).otherwise(fragment(below, items))
        return F.when(x["step"]["header"], whole).otherwise(fragment(x["table"], items))

    return F.transform(F.filter(zipped, lambda x: x["step"]["m"].isNotNull()), rows)


_TABLES = once(lambda: F.transform(table_rows(F.col("markdown")), typed_rows))
_OWN = once(lambda: own_mappings(F.col("tables")))
_PLAN = once(lambda: resolve_fragments(F.col("tables"), F.col("own")))
_FRAGMENTS = once(_read_rows)
_ITEMS = once(lambda: F.flatten(F.transform("fragments", lambda x: fragment_items(x["rows"], x["m"], x["items"]))))
_NUMBERED = once(lambda: keep_document_numbers(F.col("items")))


def with_tables(docs: DataFrame) -> DataFrame:
    """Documents with their typed tables; those without a table row drop out at the scan."""
    return docs.filter(F.contains(F.col("markdown"), F.lit("|"))).select("document_id", _TABLES().alias("tables"))


def with_plan(tabled: DataFrame) -> DataFrame:
    """Typed tables with the mapping of each."""
    return tabled.withColumn("own", _OWN()).withColumn("plan", _PLAN())


def data_rows(planned: DataFrame) -> DataFrame:
    """The rows to read of every table that has a mapping."""
    return planned.select("document_id", _FRAGMENTS().alias("fragments"))


def parse_line_items(docs: DataFrame) -> DataFrame:
    """Items of all documents (document_id, markdown); `ord` is the place in the document."""
    read = data_rows(with_plan(with_tables(docs))).select("document_id", _ITEMS().alias("items"))
    numbered = read.select("document_id", _NUMBERED().alias("items"))
    return (
        numbered.select("document_id", F.posexplode_outer("items").alias("ord", "x"))
        .filter(F.col("x").isNotNull())
        .select(
            "document_id",
            (F.col("ord") + 1).cast("long").alias("ord"),
            F.col("x.pos").alias("position"),
            F.col("x.d").alias("description"),
            F.col("x.q").alias("quantity"),
            F.col("x.p").alias("unit_price"),
            F.col("x.a").alias("amount"),
            F.col("x.t").alias("tax"),
        )
    )
