"""Dates and the spellings of values that documents use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import let, strip


def parse_date(c: Column) -> Column:
    """Date of a text in one of the known notations, else NULL (S3).

    The shape test in front keeps texts that are no dates away from the parser.
    """
    t = strip(c)
    tries = []
    for shape, formats in V.DATE_FORMATS:
        parsed = F.coalesce(*[F.try_to_date(t, f) for f in formats])
        tries.append(F.when(t.rlike(shape), parsed))
    return F.coalesce(*tries)


def _fill(form: str, parts: Column, name: str | None = None) -> Column:
    """Concatenation described by a form such as 'dd/mm/y'."""
    pieces = [x for x in re.split(r"(name|dd|mm|d|m|y)", form) if x]
    known = {"dd", "mm", "d", "m", "y"}
    return F.concat(*[parts[x] if x in known else parts[name] if x == "name" else F.lit(x) for x in pieces])


def date_spellings(d: Column) -> Column:
    """Notations a document may use for a date; its parts are formatted once."""
    parts = F.struct(
        *[F.date_format(d, f).alias(n) for n, f in (
            ("y", "y"), ("m", "M"), ("mm", "MM"), ("d", "d"), ("dd", "dd"), ("short", "MMM"), ("long", "MMMM"))]
    )

    def spell(p):
        numeric = [o.format(s=s) for s in V.DATE_SEPARATORS for o in V.DATE_ORDERS]
        forms = [_fill(f, p) for f in numeric]
        forms += [_fill(f, p, n) for n in ("short", "long") for f in V.MONTH_NAME_FORMS]
        return F.array(*forms, *[_fill(f, p) for f in V.KOREAN_DATE_FORMS])

    return let(parts, spell)


def date_variants(c: Column) -> Column:
    """All spellings of a date text, or the text itself when it is no date."""
    return let(parse_date(c), lambda d: F.when(d.isNull(), F.array(c)).otherwise(date_spellings(d)))


def _above_decimal(x: Column, t: Column, digits: Column) -> Column:
    """Sign of (binary value of x) - (its decimal notation t, with `digits` places), exactly.

    x * 2^k is a whole number for a large enough k, so both sides can be compared as
    whole decimals.
    """
    k = F.greatest(F.lit(52) - F.floor(F.log2(x)), F.lit(0)).cast("int")
    half = F.floor(k / 2).cast("int")
    one = F.lit(1).cast("long")
    power = lambda n: F.call_function("shiftleft", one, n).cast("decimal(18,0)")
    scale = F.pow(F.lit(10.0), digits).cast("decimal(12,0)")
    left = (x * F.pow(F.lit(2.0), k)).cast("long").cast("decimal(20,0)") * scale
    right = (t * scale).cast("decimal(18,0)") * (power(half) * power(k - half)).cast("decimal(20,0)")
    return F.sign(left - right)


def _rounded_units(x: Column, digits: Column) -> Column:
    """x * 10^digits rounded to a whole number as C and Python print doubles.

    They round the exact binary value, half to even. The decimal notation decides unless
    it ends in a lone 5, where the binary value lies above, below or exactly on it.
    """
    t = x.try_cast("decimal(28,12)")

    def settle(y):
        low = F.floor(y)
        side = _above_decimal(x, t, digits + 1)
        up = (side > 0) | ((side == 0) & (low % 2 == 1))
        return F.when(y - low == 0.5, low + F.when(up, 1).otherwise(0)).otherwise(F.round(y, 0)).cast("decimal(24,0)")

    return let(t * F.pow(F.lit(10.0), digits).cast("decimal(10,0)"), settle)


_LIMB = 10**14


def _huge_digits(a: Column) -> Column:
    """The digits of a finite double from 2^115 on, exactly.

    It is a whole number m * 2^e. Its decimal digits, in limbs of 14 from the lowest up, are
    multiplied by 2^13 at a time.
    """
    limb = F.lit(_LIMB)

    def times(limbs, factor):
        def one(acc, x):
            return let(x * factor + acc["carry"], lambda y: F.struct(
                F.call_function("div", y, limb).alias("carry"), F.array_append(acc["out"], y % limb).alias("out")))

        start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(
            limbs, start, one, lambda acc: F.when(acc["carry"] > 0, F.array_append(acc["out"], acc["carry"])).otherwise(acc["out"])
        )

    def digits(e):
        m = (a / F.pow(F.lit(2.0), e)).cast("long")
        powers = F.transform(F.sequence(F.lit(0), e, F.lit(13)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.lit(13), e - i)))
        limbs = F.aggregate(powers, F.array(m % limb, F.call_function("div", m, limb)), times)
        whole = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 14, "0")), "")
        return F.regexp_replace(whole, "^0+", "")

    return let((F.floor(F.log2(a)) - 53).cast("int"), digits)


def _whole_digits(a: Column) -> Column:
    """The digits of the whole part of a positive double, exactly; `inf` if it is infinite."""
    step = float(2**53)
    high = F.floor(a / step)
    wide = high.cast("decimal(19,0)") * F.lit(2**53).cast("decimal(16,0)") + F.floor(a - high * step).cast("decimal(16,0)")
    return (
        F.when(a < float(2**62), F.floor(a).cast("string"))
        .when(a < float(2**115), wide.cast("string"))
        .when(a < float("inf"), _huge_digits(a))
        .otherwise("inf")
    )


def _cents(a: Column) -> Column:
    """Whole cents of a positive double below 2^53, rounding its exact binary value half to even.

    The fraction is a count of 2^-52, and what a number below 1 has beyond.
    """
    scale = float(2**52)

    def count(x):
        return let(F.floor(x["f"] * scale), lambda m: settle(x["w"], m, x["f"] * scale - m))

    def settle(whole, m, beyond):
        total = m * 100 + F.floor(beyond * 100)
        cents, left = F.shiftright(total, 52), total.bitwiseAND(F.lit(2**52 - 1))
        tie = (left == 2**51) & ((beyond * 100 > F.floor(beyond * 100)) | (cents % 2 == 1))
        return whole * 100 + cents + F.when((left > 2**51) | tie, 1).otherwise(0)

    return let(F.struct(F.floor(a).alias("w"), (a - F.floor(a)).alias("f")), count)


def round_cents(c: Column) -> Column:
    """A double rounded to two decimals as Python does, as text such as -12.50.

    Exact for every finite double; from 2^53 on doubles are whole.
    """
    a = F.abs(c)
    sign = F.when(c < 0, "-").otherwise("")
    small = let(
        _cents(a),
        lambda n: F.when(n == 0, F.lit("0.00")).otherwise(
            F.concat(sign, F.regexp_replace(F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), "0"), r"(..)$", ".$1"))
        ),
    )
    return F.when(a < float(2**53), small).otherwise(F.concat(sign, _whole_digits(a), F.lit(".00")))


def _two_decimals(c: Column) -> Column:
    cents = c.try_cast("decimal(18,2)")
    # below 1e13 doubles lie closer than cents, so one that spells two decimals rounds to them
    plain = (cents.cast("double") == c) & (F.abs(c) < 1e13)
    return F.when(plain, cents.cast("string")).otherwise(round_cents(c))


def _group_thousands(s: Column) -> Column:
    return F.regexp_replace(s, r"(?<=\d)(?=(?:\d{3})+(?:\.|$))", ",")


def _exponential(a: Column) -> Column:
    sci = F.format_string("%.5e", a)
    mantissa = F.regexp_replace(F.regexp_extract(sci, r"^([^e]+)e", 1), r"\.?0+$", "")
    return F.concat(mantissa, F.regexp_extract(sci, r"(e[-+]\d+)$", 1))


def _millions(a: Column) -> Column:
    """%g of a double from a million on: six digits of the exact whole part, half to even."""

    def cut(w):
        head, tail = F.substr(w, F.lit(1), F.lit(6)), F.substr(w, F.lit(7))
        half = F.rpad(F.lit("5"), F.length(w) - 6, "0")
        tie = (tail == half) & ((a > F.floor(a)) | (head.cast("int") % 2 == 1))
        rounded = head.cast("int") + F.when((tail > half) | tie, 1).otherwise(0)
        grown = rounded == 1_000_000
        digits = F.when(grown, "1").otherwise(F.regexp_replace(rounded.cast("string"), "0+$", ""))
        power = F.length(w) - 1 + F.when(grown, 1).otherwise(0)
        point = F.when(F.length(digits) > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))).otherwise(digits)
        return F.concat(point, F.lit("e+"), F.lpad(power.cast("string"), F.greatest(F.lit(2), F.length(power.cast("string"))), "0"))

    return let(_whole_digits(a), cut)


def _six_digits(c: Column) -> Column:
    """The shortest form with six significant digits (C-style %g)."""
    a = F.abs(c)
    # places after the point that six significant digits leave
    places = F.when(a < 1e-3, 9).when(a < 1e-2, 8).when(a < 0.1, 7).when(a < 1, 6)
    for n in range(1, 7):
        places = places.when(a < 10**n, 6 - n)
    unit = F.pow(F.lit(10.0), places).cast("decimal(10,0)")
    value = (_rounded_units(a, places).cast("decimal(10,0)") / unit).cast("decimal(20,10)")
    sign = F.when(c < 0, "-").otherwise("")
    return (
        F.when(c == 0, "0")
        .when(a < 1e-4, F.concat(sign, _exponential(a)))
        .when(a >= 1e6, F.concat(sign, _millions(a)))
        .otherwise(
            let(
                value,
                lambda v: F.when(v >= 1_000_000, F.concat(sign, F.lit("1e+06"))).otherwise(
                    F.concat(sign, F.regexp_replace(v.cast("string"), r"\.?0+$", ""))
                ),
            )
        )
    )


def number_variants(c: Column) -> Column:
    """Spellings of an amount: two decimals, grouped, shortest, whole, and European.

    An infinite amount, which too many digits read as, and NaN have one spelling each.
    """

    def spell(s):
        fixed, whole = s["fixed"], F.regexp_extract(s["fixed"], r"^(.*)\.00$", 1)
        is_whole = c == F.rint(c)
        return F.array_compact(
            F.array(
                fixed,
                _group_thousands(fixed),
                s["short"],
                F.when(is_whole, whole),
                F.when(is_whole, _group_thousands(whole)),
            )
        )

    plain = let(F.struct(_two_decimals(c).alias("fixed"), _six_digits(c).alias("short")), spell)
    forms = let(
        plain,
        lambda p: F.array_distinct(F.concat(p, F.transform(p, lambda s: F.translate(s, ",.", ".,")))),
    )
    endless = F.when(F.isnan(c), "nan").when(c > 0, "inf").otherwise("-inf")
    return F.when(F.abs(c) < float("inf"), forms).when(c.isNotNull(), F.array(endless))
