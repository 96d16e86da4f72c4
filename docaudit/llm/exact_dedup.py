"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own characters say so, hence equal stretches of different texts give
equal chunks. Each distinct chunk moves once, to verify that its digest stands for one text
only; whole documents are then compared as ordered lists of verified identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .common import lower_ascii, placed, rows_at, whole

LONGEST_CHUNK = 16_384
FIRST, NEXT = "\x00+", "\x00-"
"""Lead the parts of a piece that is cut further. No other piece starts with this character."""


def _bit_class(bit: int) -> str:
    """Printable ASCII characters whose scrambled code has the given bit set."""
    picked = [chr(c) for c in range(33, 127) if (c * 37 + 11) >> bit & 1]
    return "[" + "".join("\\" + c if not c.isalnum() else c for c in picked) + "]"


def _cut_pattern() -> str:
    """A blank whose three neighbours on each side fall in their classes."""
    before, after = ("".join(_bit_class(bit) for bit in bits) for bits in ((1, 2, 3), (4, 1, 2)))
    return f" (?<={before} )(?={after})"


def chunks(text: Column) -> Column:
    """The text in pieces, cut at blanks that its own characters pick.

    A piece of more than LONGEST_CHUNK characters is cut further, its parts led by marks.
    Parts joined, and pieces joined by blanks, give the text, so equal texts and no others give
    equal lists. The empty text is one empty piece.
    """
    long = f"(?s).{{1,{LONGEST_CHUNK}}}"
    return F.flatten(
        F.transform(
            F.split(text, _cut_pattern()),
            lambda p: F.when((F.length(p) <= LONGEST_CHUNK) & ~p.startswith("\x00"), F.array(p)).otherwise(
                F.transform(
                    F.regexp_extract_all(p, F.lit(long), F.lit(0)),
                    lambda x, i: F.concat(F.when(i == 0, FIRST).otherwise(NEXT), x),
                )
            ),
        )
    )


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, recipe, text_sha256): per row the digests of its chunks in order.

    Texts are normalised by lower-casing A-Z; null counts as empty.
    """
    norm = docs.select(F.col(key), lower_ascii(whole(F.col(text))).alias("__norm"))
    return norm.select(
        key,
        F.transform(chunks(F.col("__norm")), lambda c: F.sha2(c, 256)).alias("recipe"),
        F.sha2("__norm", 256).alias("text_sha256"),
    )


def chunk_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, chunk): every distinct chunk of the normalised texts, each once."""
    each = docs.select(F.explode(chunks(lower_ascii(whole(F.col(text))))).alias("chunk"))
    return each.select(F.sha2("chunk", 256).alias("digest"), "chunk").distinct()


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of equal texts: (key, keep_id, group_size, kept, text_sha256), a row per input row.

    Rows are compared by their recipes. Where rows share one, each of its chunks is looked up
    among the distinct chunks of such rows: a digest that stood for two chunks would end the
    run with an error. Texts that are alone with their recipe never move.

    Of equal texts the row with the largest key stays. Null texts count as empty, and so form
    one class with the empty ones. A null key never wins against another; where a class has
    null keys only, keep_id is null and all its rows stay. Where the largest key occurs on
    several rows with equal text, each of them is `kept`. An empty table gives no rows; extra
    columns are ignored.
    """
    listed = settled(recipes(docs, key, text).withColumnRenamed(key, "__key"), "recipes")
    whole_list = F.sha2(F.array_join("recipe", ""), 256).alias("__class")
    groups = settled(
        listed.groupBy("recipe")
        .agg(F.max("__key").alias("keep_id"), F.count("*").alias("group_size"))
        .select(whole_list, "keep_id", "group_size"),
        "classes",
    )
    rows = listed.select("__key", whole_list, "text_sha256")
    shared = rows.join(groups.filter("group_size > 1"), "__class", "left_semi")
    shared = settled(shared.select(F.col("__key").alias("__shared")).distinct(), "shared")
    doubtful = docs.join(shared, F.col(key).eqNullSafe(F.col("__shared")), "left_semi")
    texts = chunk_store(doubtful, text).groupBy("digest").agg(F.count("*").alias("n"))
    most = texts.agg(F.max("n").alias("n")).scalar()
    verified = F.when(F.coalesce(most, F.lit(1)) > 1, F.raise_error(F.lit("two chunks share a digest")))
    return rows.join(groups, "__class").select(
        F.col("__key").alias(key),
        F.coalesce(verified.cast(docs.schema[key].dataType), "keep_id").alias("keep_id"),
        "group_size",
        F.coalesce(F.col("__key") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of equal texts, with all its columns.

    It is the row with the largest key; null keys come last, and places in the files part equal ones.
    """
    rows = placed(docs)
    rank = F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key"), F.col("__place").alias("place"))
    kept = exact_groups(rows.withColumn("__rank", rank), "__rank", text).filter("kept")
    return rows_at(rows, kept.select("__rank.place"))
