"""Stored tables laid out for the joins and look-ups that the engine runs most (IO2, IO4).

`write_dealt` deals the three tables by document into the same number of sorted buckets, so that
a join or a sum per document reads bucket beside bucket and moves no rows. `write_clustered`
keeps neighbouring ids together and adds Bloom filters, so that a call for a few documents or
hashes reads a few row groups.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import TABLES

c = F.col
KEYS = {"documents": "id", "line_items": "document_id", "validation_errors": "document_id"}


def _typed(name: str, df: DataFrame) -> DataFrame:
    return df.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])


# --- dealt by document ----------------------------------------------------------------

def _register(spark: SparkSession, folder: str, name: str, buckets: int) -> str:
    """The folder of a dealt table under a fresh name of the session's catalog."""
    table = f"dealt_{name}_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[name])
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet OPTIONS (path '{folder}/{name}')"
        f" CLUSTERED BY ({KEYS[name]}) SORTED BY ({KEYS[name]}) INTO {buckets} BUCKETS"
    )
    return table


def write_dealt(tables: dict[str, DataFrame], folder: str, buckets: int | None = None) -> None:
    """Write the tables, or add to them, dealt by document; one file per bucket and call.

    `buckets` counts when the folder is new, by default as the shuffle settings say; later calls
    keep its number, which is stored beside the tables. All rows of a document lie in one bucket,
    so a document of very many rows makes one large bucket.
    """
    folder = folder.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    known = _buckets(spark, folder)
    if known is None:
        known = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.range(1).select(F.lit(known).cast("int").alias("buckets")).write.parquet(f"{folder}/layout")
    for name, df in tables.items():
        key = KEYS[name]
        table = _register(spark, folder, name, known)
        # partition and bucket numbers come from the same hash: a task writes one bucket
        dealt = _typed(name, df).repartition(known, key).sortWithinPartitions(key)
        dealt.write.format("parquet").bucketBy(known, key).sortBy(key).mode("append").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")


def _buckets(spark: SparkSession, folder: str) -> int | None:
    """The number of buckets of a folder, None where nothing is written yet."""
    try:
        return spark.read.schema("buckets int").parquet(f"{folder}/layout").first()["buckets"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_dealt(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder with their layout known: joins and sums by document need no exchange."""
    folder = folder.rstrip("/")
    buckets = _buckets(spark, folder)
    if buckets is None:
        raise ValueError(f"{folder} holds no dealt tables")
    return {name: spark.table(_register(spark, folder, name, buckets)) for name in TABLES}


# --- clustered for look-ups -----------------------------------------------------------

def write_clustered(
    df: DataFrame, path: str, by: str = "id", looked_up: tuple[str, ...] = (), mode: str = "append", group_bytes: int = 16 << 20
) -> None:
    """Write a table in ranges of `by`, with Bloom filters for the columns that are looked up.

    Row groups hold about `group_bytes`. The statistics of `by` and the filters tell a reader
    which of them can hold a key.
    """
    writer = df.repartitionByRange(by).sortWithinPartitions(by).write.mode(mode).option("parquet.block.size", group_bytes)
    for name in looked_up:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    if looked_up:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(path)


def write_for_lookups(tables: dict[str, DataFrame], folder: str, mode: str = "append", group_bytes: int = 16 << 20) -> None:
    """The three tables clustered by document; documents can be found by their hash, too."""
    for name, df in tables.items():
        looked_up = ("file_hash",) if name == "documents" else ()
        write_clustered(_typed(name, df), f"{folder.rstrip('/')}/{name}", KEYS[name], looked_up, mode, group_bytes)
