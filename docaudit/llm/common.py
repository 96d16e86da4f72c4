"""What several operators share: reading tables, words, hashes, joins on hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..session import settled

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = "\\x20\\x09-\\x0D"
"""The characters that part words, as inside of a character class."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Words of a text: runs of characters other than 0x20 and 0x09-0x0D."""
    return F.array_remove(F.split(text, "[" + BLANK + "]+"), "")


def held_out(key: Column, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves `remainder` by 5; a null key is never held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == remainder, F.lit(False))


def placed(docs: DataFrame) -> DataFrame:
    """The rows with `__place`, their file (64 bits of its name) and place there.

    It tells rows apart whatever their keys, and is the same whenever the files are read. Rows
    that are not read from Parquet files as they are get written first.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("__place")
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.children().isEmpty():
        try:
            return docs.select("*", place)
        except AnalysisException:
            pass
    return settled(docs, "placed").select("*", place)


def rows_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of `placed` whose place is among the given ones, as they were."""
    wanted = places.select(F.col(places.columns[0]).alias("__wanted"))
    return rows.join(wanted, F.col("__place") == F.col("__wanted"), "left_semi").drop("__place")


def small_batches(spark: SparkSession, rows: int = 256) -> SparkSession:
    """Arrow batches of few rows, so that long texts fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark
