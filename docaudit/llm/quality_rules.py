"""Quality rules: plain text statistics and robust multivariate outliers.

Every document is described by a vector of transformed statistics. Per language and source the
minimum covariance determinant gives a centre and a covariance that bad documents cannot pull
away; a document far from the centre by Mahalanobis distance is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .common import BLANK, placed, rows_at, whole, words

SYMBOLS = "#*$%&|<>"  # in a character class
FEATURES = ["word_length", "symbols", "dup_lines", "repeats", "capitals", "other"]
FLOORS = [0.05, 0.05, 0.2, 0.2, 0.05, 0.05]
"""Added to the spread of each feature: differences smaller than this are of no account."""
SUBSET = 0.75
"""Share of a group's rows that the estimate rests on."""
STEPS = 3
SMALL_GROUP = 100
CUTOFF = 60.0
"""Largest squared distance that is kept; see `outliers`."""
CHI2_MEDIAN = 5.348
"""Median of the chi-squared distribution with six degrees of freedom."""


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every text: key, lang, source and what it counts.

    Null texts count as empty. A document of fewer than three words has no window. Windows count
    as equal if their hashes agree in 64 bits.
    """
    n = F.col("n_words")
    base = docs.select(
        F.col(key).alias("__key"),
        F.col("lang").alias("__lang"),
        F.col("source").alias("__source"),
        whole(F.col(text)).alias("__text"),
    ).withColumn("__w", words(F.col("__text")))
    hashes = F.transform("__w", lambda x: F.xxhash64(x))
    counted = base.select(
        "__key", "__lang", "__source",
        F.size("__w").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("__text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("__text", r"[^!-@\[-`{-~]+", "")).cast("long").alias("n_other"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{BLANK}]")).alias("__lines"),
        hashes.alias("__h"),
    )
    h = F.col("__h")
    windows = F.transform(
        F.slice(h, 1, n - 2),
        lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("hash"), i.alias("at")),
    )
    # sorting brings equal windows together
    none = F.array().cast("array<struct<hash:bigint,at:int>>")
    sorted_ = counted.withColumn("__s", F.when(n >= 3, F.sort_array(windows)).otherwise(none))
    s = F.col("__s")

    def same(x, i):
        return F.coalesce(x["hash"] == F.get(s, i)["hash"], F.lit(False))

    twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
    places = sorted_.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["at"])))
    p = F.col("__p")
    # windows cover three words each; neighbours share some
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return places.select(
        F.col("__key").alias(key), F.col("__lang").alias("lang"), F.col("__source").alias("source"),
        n.cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"), "n_capitals", "n_other",
        (
            (n < 50) | (100 * covered > 50 * n)
        ).alias("base_failed"),
    )


def _vector(rows: DataFrame) -> DataFrame:
    """The statistics as shares whose spread hardly depends on the document's size."""

    def share(part, of):
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(of), F.lit(1)))))

    return (
        rows.withColumn("word_length", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest("n_words", F.lit(1))))
        .withColumn("symbols", share("n_symbols", "n_words"))
        .withColumn("dup_lines", share("n_dup_lines", "n_lines"))
        .withColumn("repeats", share("n_repeat_words", "n_words"))
        .withColumn("capitals", share("n_capitals", "word_chars"))
        .withColumn("other", share("n_other", "word_chars"))
    )


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the figures of their group. Groups are few against rows but not bounded, so
    the side to broadcast is left to Spark, which knows the size of the written table."""
    named = groups.withColumnsRenamed({"lang": "__gl", "source": "__gs", "level": "__gv"})
    match = (
        F.col("lang").eqNullSafe(F.col("__gl")) & F.col("source").eqNullSafe(F.col("__gs"))
        & (F.col("level") == F.col("__gv"))
    )
    return rows.join(named, match).drop("__gl", "__gs", "__gv")


def _levels(rows: DataFrame) -> DataFrame:
    """Rows under their estimate: (lang, source), else small sources of a language, else the rest.

    Level 3 holds what is too little even together; it gets no estimate.
    """
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("small", F.col("n") < SMALL_GROUP)
    by_lang = sizes.filter("small").groupBy("lang").agg(F.sum("n").alias("n_lang"))
    rest = by_lang.filter(F.col("n_lang") < SMALL_GROUP).agg(F.coalesce(F.sum("n_lang"), F.lit(0))).scalar()
    both = sizes.join(by_lang.withColumnRenamed("lang", "__bl"), F.col("lang").eqNullSafe(F.col("__bl")), "left")
    level = (
        F.when(~F.col("small"), 0)
        .when(F.col("n_lang") >= SMALL_GROUP, 1)
        .when(rest >= SMALL_GROUP, 2)
        .otherwise(3)
    )
    places = settled(both.select("lang", "source", level.alias("level")), "levels")
    named = places.withColumnsRenamed({"lang": "__gl", "source": "__gs"})
    match = F.col("lang").eqNullSafe(F.col("__gl")) & F.col("source").eqNullSafe(F.col("__gs"))
    return (
        rows.join(named, match)
        .withColumn("lang", F.when(F.col("level") <= 1, F.col("lang")))
        .withColumn("source", F.when(F.col("level") == 0, F.col("source")))
        .drop("__gl", "__gs")
    )


GROUP = ["lang", "source", "level"]


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of the covariance of the rows of each group."""
    d = range(len(FEATURES))
    moments = rows.groupBy(*GROUP).agg(
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)],
        *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i in d for j in d if j <= i],
    )
    for i in d:
        for j in range(i + 1):
            left = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l{j}{j}")
            moments = moments.withColumn(f"l{i}{j}", value)
    return moments.drop(*[f"c{i}{j}" for i in d for j in d])


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance `d2` by forward substitution."""
    total = F.lit(0.0)
    for i, f in enumerate(FEATURES):
        y = F.col(f) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"__y{k}")
        rows = rows.withColumn(f"__y{i}", y / F.col(f"l{i}{i}"))
        total = total + F.col(f"__y{i}") * F.col(f"__y{i}")
    return rows.withColumn("d2", total).select("__key", *GROUP, *FEATURES, "d2")


def outliers(stats: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, distance) of the rows of `statistics`, by robust estimates per language and source.

    The estimate starts from medians and median deviations, then takes STEPS concentration
    steps: the mean and covariance of the SUBSET of rows nearest by the estimate before. The
    distances are scaled so that their median is that of a Gaussian cloud. Sources of fewer
    than SMALL_GROUP rows are estimated together with the other small sources of their
    language, or of all languages; if even those are few, the distance is 0. Null languages
    and sources are groups of their own. Equal rows get equal distances.
    """
    vectors = _vector(stats).select(F.col(key).alias("__key"), "lang", "source", *FEATURES)
    rows = settled(_levels(vectors), "vectors")
    judged = rows.filter("level < 3")
    centre = settled(
        judged.groupBy(*GROUP).agg(*[F.percentile_approx(f, 0.5, 1000).alias(f"m{i}") for i, f in enumerate(FEATURES)]),
        "medians",
    )
    spread = _joined(judged, centre).groupBy(*GROUP).agg(
        *[F.percentile_approx(F.abs(F.col(f) - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i, f in enumerate(FEATURES)],
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(len(FEATURES))],
    )
    # 1.4826 turns a median deviation into the standard deviation of a Gaussian
    for i in range(len(FEATURES)):
        for k in range(i + 1):
            spread = spread.withColumn(f"l{i}{k}", F.col(f"s{i}") * 1.4826 + FLOORS[i] if i == k else F.lit(0.0))
    estimate = settled(spread.drop(*[f"s{i}" for i in range(len(FEATURES))]), "spread")
    for _ in range(STEPS):
        far = _distance(_joined(judged, estimate))
        reach = settled(
            far.groupBy(*GROUP).agg(F.percentile_approx("d2", SUBSET, 1000).alias("reach")), "reach"
        )
        estimate = settled(_estimate(_joined(far, reach).filter("d2 <= reach")), "estimate")
    far = _distance(_joined(judged, estimate))
    middle = settled(far.groupBy(*GROUP).agg(F.percentile_approx("d2", 0.5, 1000).alias("middle")), "middle")
    scaled = _joined(far, middle).select(
        F.col("__key").alias(key),
        (F.col("d2") * CHI2_MEDIAN / F.greatest(F.col("middle"), F.lit(CHI2_MEDIAN))).alias("distance"),
    )
    return scaled.unionByName(rows.filter("level = 3").select(F.col("__key").alias(key), F.lit(0.0).alias("distance")))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of every row with `base_failed` and `kept`.

    Rows that fail the base (under 50 words, or over half of the words in repeated windows)
    are dropped and have no part in the estimates. The others are kept up to CUTOFF of the
    squared distance. An empty table gives no rows; extra columns are ignored; repeated rows
    are judged alike, under a row number of their own.
    """
    stats = statistics(docs, key, text)
    stats = settled(stats.withColumn("__row", F.monotonically_increasing_id()), "statistics")
    far = outliers(stats.filter(~F.col("base_failed")), "__row")
    far = far.filter(F.col("distance") > CUTOFF).select(F.col("__row").alias("__far"))
    return (
        stats.join(far, F.col("__row") == F.col("__far"), "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("__far").isNull())
        .drop("__row", "__far")
    )


def without_rejected(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that `judge` keeps, with all their columns; each is judged by itself, whatever its key."""
    rows = placed(docs)
    return rows_at(rows, judge(rows, "__place", text).filter("kept").select("__place"))
