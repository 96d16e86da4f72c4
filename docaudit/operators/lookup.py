"""Look-ups of few keys in large tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOKUP_KEYS = 1000
"""Keys of one look-up; `spark.sql.parquet.pushdown.inFilterThreshold` is set to as many."""


def rows_of(table: DataFrame, column: str, keys: list) -> DataFrame:
    """The rows of at most LOOKUP_KEYS keys.

    On tables written for look-ups, row groups that cannot hold any of the keys are not read.
    """
    if len(keys) > LOOKUP_KEYS:
        raise ValueError(f"{len(keys)} keys in one look-up; join beyond {LOOKUP_KEYS}")
    return table.filter(F.col(column).isin(list(keys)))
