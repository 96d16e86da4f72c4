"""Row numbers that stay exact and spread out when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled


def number_rows(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Number the rows 1..n per key, ascending by `order` (a total order).

    The rows are dealt by ranges of (keys, order) into as many partitions as the shuffle
    settings say and written with their place there. A row's number is its place among the
    rows of its key in its partition, and the key's rows in the partitions before. Only a key
    that goes on from one partition to the next has such rows, so that the shifts are fewer
    than the partitions. Every size and every share of a key takes this one path; the input
    is read twice, to sample the ranges and to deal.
    """
    sort_cols = [f"__s{i}" for i in range(len(order))]
    key_cols = [f"__k{i}" for i in range(len(keys))]
    base = df.select(
        "*",
        *[F.col(k).alias(n) for k, n in zip(keys, key_cols)],
        *[c.alias(s) for c, s in zip(order, sort_cols)],
    )
    by = [*key_cols, *sort_cols]
    dealt = base.repartitionByRange(*by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id()
    rows = settled(dealt.select(*df.columns, *key_cols, place.alias("__at")), "numbered")
    rows = rows.withColumn("__part", F.shiftright("__at", 33))

    sizes = rows.groupBy(*key_cols, "__part").agg(F.count("*").alias("__m"))
    before = W.partitionBy(*key_cols).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.withColumn("__shift", F.sum("__m").over(before)).filter("__shift is not null")
    shifts = settled(
        shifts.select(*[F.col(k).alias(f"b{k}") for k in key_cols], F.col("__part").alias("b__part"), "__shift"), "shifts"
    )
    match = F.col("__part") == F.col("b__part")
    for k in key_cols:
        match = match & F.col(k).eqNullSafe(F.col(f"b{k}"))
    if keys:
        own = F.row_number().over(W.partitionBy("__part", *key_cols).orderBy("__at"))
    else:
        own = F.col("__at") - F.shiftleft("__part", 33) + 1
    return rows.withColumn("__own", own).join(shifts, match, "left").select(
        *df.columns, (F.col("__own") + F.coalesce("__shift", F.lit(0))).cast("long").alias(out)
    )
