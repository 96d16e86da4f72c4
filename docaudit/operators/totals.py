"""Sums of amounts that do not depend on the order of rows, for every double.

A double counts as the decimal number it is written as. Ordinary amounts are added as decimals
in one aggregation. Amounts of other sizes, which are rare, are added per power of ten of their
last digit, in an aggregation of their own that reads only them; infinities and NaN follow the
rules of floating point. A value of any size stays with its own key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAST, _SPLIT, _MOST = 1e-3, 1e6, 1e18
_SMALL, _LARGE = "decimal(28,20)", "decimal(31,11)"
"""An amount is written with 17 digits at most: from 0.001 on with 20 decimals, from 10^6 on with
11. Their sums have room for 10^10 amounts of 10^17."""
_SPECIAL = 400
"""Stands for the power of ten of infinities and NaN, above that of every number."""


def _near(c: Column) -> Column:
    return (c == 0) | ((F.abs(c) >= _LEAST) & (F.abs(c) < _MOST))


def _far(c: Column) -> Column:
    """The other values, in a form that Parquet's statistics can answer; NaN exceeds all numbers."""
    return (c >= _MOST) | (c <= -_MOST) | ((c > -_LEAST) & (c < _LEAST) & (c != 0))


def _ordinary(small: Column, large: Column) -> Column:
    both = small.isNotNull() & large.isNotNull()
    fits = (F.abs(small) < 10**16) & (F.abs(large) < 10**16)
    exact = (small.cast("decimal(37,20)") + large.cast("decimal(37,20)")).cast("double")
    apart = small.cast("double") + large.cast("double")
    return F.when(both & fits, exact).when(both, apart).otherwise(F.coalesce(small, large).cast("double"))


def _far_sums(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, a sum per name) of the keys that have far values.

    The sums of the powers of ten, of which there are some 650, are added from the largest down.
    """
    held = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("x")) for n in names])).alias("v")
    any_far = reduce(Column.__or__, [F.coalesce(_far(F.col(n)), F.lit(False)) for n in names])
    values = rows.filter(any_far).select(*keys, held).select(*keys, "v.name", "v.x").filter(_far(F.col("x")))
    written = F.regexp_extract(F.col("x").cast("string"), r"^(-?\d)\.(\d+)E(-?\d+)$", 0)
    part = lambda i: F.regexp_extract(F.col("x").cast("string"), r"^(-?\d)\.(\d+)E(-?\d+)$", i)
    number = written != ""
    values = values.select(
        *keys, "name", F.when(~number, F.col("x")).alias("special"),
        F.when(number, F.concat(part(1), part(2)).cast("decimal(20,0)")).alias("digits"),
        F.when(number, part(3).cast("int") - F.length(part(2))).otherwise(_SPECIAL).alias("power"),
    )
    powers = values.groupBy(*keys, "name", "power").agg(F.sum("digits").alias("digits"), F.sum("special").alias("special"))
    value = F.coalesce("special", F.concat(F.col("digits").cast("string"), F.lit("E"), F.col("power").cast("string")).cast("double"))
    listed = lambda n: F.sort_array(F.collect_list(F.when(F.col("name") == n, F.struct("power", value.alias("value")))), asc=False)
    total = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x["value"]))
    return powers.groupBy(*keys).agg(*[listed(n).alias(n) for n in names]).select(*keys, *[total(F.col(n)).alias(n) for n in names])


def exact_sums(rows: DataFrame, keys: list[str], amounts: dict[str, Column], *others: Column) -> DataFrame:
    """Per key the sums of double columns, by name, and further aggregates.

    A sum is NULL where all its values are. `rows` is read twice, the second time for the far
    values alone; without any, adaptive execution drops the join. Keys must not be NULL: rows
    with a NULL key are left out, so that the join keeps the partitioning of the sums.
    """
    names, hidden = list(amounts), {n: f"__{n}" for n in amounts}
    given = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    held = rows.filter(given).select("*", *[a.cast("double").alias(hidden[n]) for n, a in amounts.items()])
    parts = []
    for n in names:
        x = F.col(hidden[n])
        split = F.abs(x) < _SPLIT
        parts.append(F.sum(F.when(_near(x) & split, x.cast(_SMALL))).alias(f"{hidden[n]}_s"))
        parts.append(F.sum(F.when(_near(x) & ~split, x.cast(_LARGE))).alias(f"{hidden[n]}_l"))
    near = held.groupBy(*keys).agg(*others, *parts).alias("n")
    kept = [c for c in near.columns if not c.startswith("__") and c not in keys]
    far = _far_sums(held, keys, list(hidden.values())).alias("f")
    same = reduce(Column.__and__, [F.col(f"n.{k}") == F.col(f"f.{k}") for k in keys])

    def total(n: str) -> Column:
        ordinary = _ordinary(F.col(f"n.{hidden[n]}_s"), F.col(f"n.{hidden[n]}_l"))
        beyond = F.col(f"f.{hidden[n]}")
        return F.coalesce(ordinary + beyond, ordinary, beyond).alias(n)

    return near.join(far, same, "left").select(*[f"n.{k}" for k in [*keys, *kept]], *[total(n) for n in names])
