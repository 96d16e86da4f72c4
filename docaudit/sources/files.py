"""Uploaded files and ticket folders (IO1, IO5, IO6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators.tickets import OPEN
from ..schemas import TICKET

c = F.col


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def accepted(name: Column) -> Column:
    """The name ends in one of the accepted extensions."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(V.UPLOAD_EXTENSIONS)


def as_uploads(files: DataFrame) -> DataFrame:
    """IO1 on a binaryFile frame: accepted, non-empty files with the hash of their bytes."""
    name = file_name(c("path"))
    return files.filter(accepted(name) & (c("length") > 0)).select(
        "path", name.alias("filename"), F.sha2("content", 256).alias("file_hash"),
        c("length").alias("size"), "modificationTime", "content",
    )


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """IO1: extension and size are tested before a file's bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return as_uploads(files)


def parse_tickets(raw: DataFrame) -> DataFrame:
    """Ticket rows of (path, modified, value); a broken one becomes a placeholder."""
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    record = F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", TICKET))
    rows = raw.withColumn("r", record).withColumn("folder", folder)
    broken = c("r").isNull()
    stand_in = {
        "number": F.lit(0), "slug": c("folder"), "status": F.lit(OPEN),
        "created_at": F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        "section": F.lit("(unreadable)"), "document_id": F.lit(None).cast("long"),
        "message": F.lit("context.json could not be read"), "images": F.array().cast("array<string>"),
    }
    context = F.when(~broken, F.get_json_object("value", "$.context"))
    return rows.select(
        *[F.when(broken, stand_in[n]).otherwise(c(f"r.{n}")).alias(n) for n in TICKET.fieldNames()],
        context.alias("context"), c("folder"),
    )


def read_tickets(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """IO5: every context.json below the folder, or with `lines` what `write_tickets` wrote; newest first."""
    text = spark.read.text(folder) if lines else spark.read.text(f"{folder.rstrip('/')}/*/context.json", wholetext=True)
    raw = text.select("value", c("_metadata.file_path").alias("path"), c("_metadata.file_modification_time").alias("modified"))
    return parse_tickets(raw).orderBy(F.desc(F.coalesce(c("created_at"), F.lit(""))), "slug")


def write_tickets(tickets: DataFrame, folder: str, mode: str = "append") -> None:
    """IO6: one JSON record per line, for `read_tickets` with `lines`. A folder each would be one file per row."""
    tickets.write.mode(mode).json(folder)
