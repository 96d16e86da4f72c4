"""Stored tables: Parquet and JDBC, schema growth, inventories, legacy import (IO2-IO4, IO7-IO11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..operators.lifecycle import assign_ids
from ..operators.ranking import number_rows
from ..session import settled
from ..schemas import DOCUMENTS, HEADER, HEADER_FIELDS, LINE_ITEMS, VALIDATION_ERRORS, check_header

c = F.col
TABLES = {"documents": DOCUMENTS, "line_items": LINE_ITEMS, "validation_errors": VALIDATION_ERRORS}


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """IO2: the three tables with their declared layout."""
    return {n: spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{n}") for n, schema in TABLES.items()}


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "append") -> None:
    """IO4: write in the declared column order and types."""
    for name, df in tables.items():
        typed = df.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])
        typed.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def database_options(
    host: str, database: str, table: str, user: str | None = None, password: str | None = None, *,
    lower: int = 0, upper: int = 1_000_000, partitions: int = 32, encrypt: bool = True, trust: bool = True,
) -> dict[str, str]:
    """IO3: options of a partitioned SQL Server read; without a user, integrated login."""
    login = "" if user else ";integratedSecurity=true"
    flag = lambda x: "true" if x else "false"
    options = {
        "url": f"jdbc:sqlserver://{host};databaseName={database};encrypt={flag(encrypt)};trustServerCertificate={flag(trust)}{login}",
        "dbtable": table,
        "partitionColumn": "id",
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
    }
    if user:
        options |= {"user": user, "password": password or ""}
    return options


def read_database(spark: SparkSession, *, lower: int, upper: int, **kwargs) -> DataFrame:
    """IO3: needs the JDBC driver on the classpath.

    The bounds are the table's least and largest id; ids beyond them would all lie in the
    first or last partition, so there is no default.
    """
    return spark.read.format("jdbc").options(**database_options(lower=lower, upper=upper, **kwargs)).load()


def write_database(df: DataFrame, mode: str = "append", **kwargs) -> None:
    options = {k: v for k, v in database_options(**kwargs).items() if k in ("url", "dbtable", "user", "password")}
    df.write.format("jdbc").options(batchsize="10000", **options).mode(mode).save()


def evolve_schema(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """IO7: add the columns the layout gained, as NULL; other columns stay."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in wanted if f.name not in df.columns]
    if set(HEADER_FIELDS) <= {f.name for f in wanted}:
        check_header([f.name for f in wanted if f.name in set(HEADER_FIELDS)])
    return df.select("*", *missing)


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """IO10: rows and columns per table."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(n).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count")
        )
        for n, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("table_name")


def column_inventory(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """IO11: place, name, type and nullability of every column (from the schemas alone)."""
    rows = [
        (n, i, f.name, f.dataType.simpleString(), f.nullable)
        for n, df in tables.items() for i, f in enumerate(df.schema, start=1)
    ]
    return spark.createDataFrame(rows, "table_name string, place int, column_name string, type string, nullable boolean")


# --- IO8, IO9 -----------------------------------------------------------------------

_OLD_FIELDS = (
    "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in HEADER)
    + ",line_items:array<struct<position:int,description:string,quantity:double,unit_price:double,amount:double,tax:double>>>"
)


def _old_fields(docs: DataFrame) -> DataFrame:
    docs = evolve_schema(docs, DOCUMENTS)
    if "fields_json" not in docs.columns:
        docs = docs.withColumn("fields_json", F.lit(None).cast("string"))
    return docs.withColumn("f", F.when(c("fields_json") != "", F.from_json("fields_json", _OLD_FIELDS)))


def legacy_import(
    old_docs: DataFrame, old_items: DataFrame, old_errors: DataFrame, existing: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """IO8: rows to append to the tables for legacy documents whose filename is new.

    Headers and items come from `fields_json` where a document has it, else from the
    columns and the item table. Only unresolved errors move; they count as resolved when
    the document is validated.
    """
    fresh = _old_fields(old_docs).join(existing["documents"].select("filename").distinct(), "filename", "left_anti")
    numbered = settled(
        assign_ids(fresh.withColumnRenamed("id", "old_id"), existing["documents"], [c("old_id")]), "imported"
    )
    header = [F.when(c("f").isNotNull(), c(f"f.{n}")).otherwise(c(n)).alias(n) for n in HEADER_FIELDS]
    blank = lambda n, v: F.coalesce(c(n), F.lit(v)).alias(n)
    given = {
        "file_hash": blank("file_hash", ""), "stored_path": blank("stored_path", ""), "markdown": blank("markdown", ""),
        "docling_json": blank("docling_json", "{}"), "model": blank("model", ""), "page_count": blank("page_count", 0),
    } | dict(zip(HEADER_FIELDS, header))
    docs = numbered.select(*[given.get(n, c(n)) for n in DOCUMENTS.fieldNames()])

    keys = numbered.select("old_id", c("id").alias("document_id"), c("f").isNotNull().alias("nested"), "status")
    shape = ["document_id", "place", "description", "quantity", "unit_price", "amount"]
    nested = (
        numbered.select(c("id").alias("document_id"), F.posexplode_outer("f.line_items").alias("place", "x"))
        .filter(c("x").isNotNull())
        .select("document_id", (c("place") + 1).cast("long").alias("place"), "x.position", "x.description", "x.quantity",
                "x.unit_price", "x.amount", "x.tax")
    )
    plain = (
        old_items.withColumnRenamed("document_id", "old_id").drop("id", "tax")
        .join(keys.filter(~c("nested")), "old_id")
        .withColumn("place", c("position").cast("long"))
        .withColumn("position", F.lit(None).cast("int")).withColumn("tax", F.lit(None).cast("double"))
        .select(*shape, "position", "tax")
    )
    ordered = number_rows(settled(nested.unionByName(plain), "lines"), ["document_id"], [c("place")], "ord")
    gaps = ordered.filter(c("position").isNull()).select("document_id").distinct().withColumn("gap", F.lit(True))
    items = (
        ordered.join(gaps, "document_id", "left")
        .withColumn("position", F.when(c("gap"), c("ord").cast("int")).otherwise(c("position")))
        .withColumn("description", F.coalesce(c("description"), F.lit("")))
    )
    items = assign_ids(items, existing["line_items"], [c("document_id"), c("ord")]).select(*LINE_ITEMS.fieldNames())
    errors = (
        old_errors.filter(~F.coalesce(c("resolved"), F.lit(False))).withColumnRenamed("document_id", "old_id")
        .withColumnRenamed("id", "old_error").drop("status").join(keys, "old_id")
        .withColumn("field", F.coalesce(F.when(c("field") != "", c("field")), F.lit("document")))
        .withColumn("resolved", c("status") == V.VALIDATED)
    )
    errors = assign_ids(errors, existing["validation_errors"], [c("document_id"), c("old_error")])
    return {"documents": docs, "line_items": items, "validation_errors": errors.select(*VALIDATION_ERRORS.fieldNames())}


def legacy_import_plan(old_docs: DataFrame, old_items: DataFrame, old_errors: DataFrame) -> DataFrame:
    """IO9: what an import would look at, per document."""
    count = lambda df, n: df.groupBy(c("document_id").alias("id")).agg(F.count("*").alias(n))
    return (
        old_docs.select("id", "filename", "status")
        .join(count(old_items, "items"), "id", "left").join(count(old_errors, "errors"), "id", "left")
        .withColumn("items", F.coalesce(c("items"), F.lit(0))).withColumn("errors", F.coalesce(c("errors"), F.lit(0)))
    )
