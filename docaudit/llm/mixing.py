"""Mixing sources to target weights by balanced sampling (cube method).

Every source gets a target in words. A document's inclusion probability is the part of its
source's ratio of target to size beyond whole repeats. A flight moves the probabilities
through the null-space of two constraints, documents and words taken, until all but two of a
block are 0 or 1. What is left of the blocks flies again, level by level; at the end at most two
documents of a source are landed.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..session import settled
from .common import BLANK, placed, whole

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_ROWS = 1024
POOL = 64
"""Units that a flight moves at once."""


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(f"[^{BLANK}]+")).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n, target): shares of all words by weight.

    Sources in code point order, null last, weigh WEIGHTS in turn. A target stops at
    MOST_REPEATS times the source's size; the excess is shared again by weight until no
    target is above. Each round is one aggregate over the sources.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = number_rows(settled(sums, "sources"), [], [F.col("source").isNull(), F.col("source")], "__rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.col("__rank") - 1, F.lit(len(WEIGHTS))).cast("int"))
    weighed = settled(ranked.select("source", "source_size", "n", weight.alias("weight")), "weights")
    total, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total or 0) / (weights or 1.0), -1
    most = MOST_REPEATS * F.col("source_size")
    while True:
        above = most < level * F.col("weight")
        full, free, now = weighed.agg(
            F.coalesce(F.sum(F.when(above, most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.count_if(above),
        ).first()
        if now == capped or not free:
            break
        level, capped = (total - full) / free, now
    target = F.least(most.cast("double"), level * F.col("weight"))
    return weighed.select("source", "source_size", "n", target.alias("target"))


def _direction(size: np.ndarray) -> np.ndarray:
    """A way to move the units that keeps their number and their words, most for the first unit.

    It is the first unit's axis projected on the null-space of both constraints. Where that
    vanishes, as for one large unit among equal ones, the last three move among themselves.
    """
    off = size - size.mean()
    u = np.full(len(size), -1.0 / len(size))
    u[0] += 1.0
    if spread := off @ off:
        u -= off * (off[0] / spread)
    if np.abs(u).max() < 1e-9:
        u[:] = 0.0
        a, b, c = size[-3:]
        u[-3:] = (b - c, c - a, a - b) if a != c else (1.0, -1.0, 0.0)
        u /= np.abs(u).max()
    u[np.abs(u) < 1e-12] = 0.0
    return u


def fly(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all but two are 0 or 1, sums of pi and pi * size as before.

    Units come from the largest on and wait in a pool, where the largest moves most, so that
    the two that are left over are small.
    """
    pi, size = np.array(pi, float), np.asarray(size, float)
    coming = iter(np.argsort(-size, kind="stable").tolist())
    pool: list[int] = []
    while True:
        pool.extend(islice(coming, POOL - len(pool)))
        if len(pool) < 3:
            return pi
        p, u = pi[pool], _direction(size[pool])
        moves = u != 0
        q, v = p[moves], u[moves]
        up = np.where(v > 0, (1 - q) / v, -q / v).min()
        down = np.where(v > 0, q / v, (q - 1) / v).min()
        p = p + u * (up if rng.random() * (up + down) < down else -down)
        p[p < 1e-9], p[p > 1 - 1e-9] = 0.0, 1.0
        pi[pool] = p
        pool = [k for k, x in zip(pool, p) if 0 < x < 1]


def land(pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settle at most two open probabilities, keeping each as the chance of its unit.

    Both are taken together as rarely as the probabilities allow, which of all such designs
    strays least from the sums.
    """
    out = pi.copy()
    left = np.flatnonzero((pi > 0) & (pi < 1))
    if len(left):
        a, b = pi[left[0]], pi[left[1]] if len(left) > 1 else 0.0
        both, x = max(0.0, a + b - 1), rng.random()
        out[left[0]] = float(x < a)
        if len(left) > 1:
            out[left[1]] = float(x < both or a <= x < a + b - both)
    return out


def _fly_block(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["size", "draw", "key_text"], ascending=[False, True, True], kind="stable")
    rng = np.random.default_rng([int(frame["seed"].iloc[0]) & 0xFFFFFFFF, int(frame["block"].iloc[0])])
    pi = fly(frame["size"].to_numpy(), frame["pi"].to_numpy(), rng)
    if frame["blocks"].iloc[0] == 1:
        pi = land(pi, rng)
    return frame.assign(pi=pi)


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carried: tuple[str, ...] = ()
) -> DataFrame:
    """How often each document enters the mix: (key, size, source_size, target, times, taken).

    A row per input row; `taken` is `size * times`. All documents of a source have the same
    expected number of repeats, at most MOST_REPEATS, so that its words come to its target but
    for what is landed at the end. Draws depend on keys and sources alone, so reruns agree;
    rows of equal key and size may change places. Null texts count as empty and may be taken,
    at no words; a null source is one source; an empty table gives no rows; extra columns but
    those `carried` are ignored. A source without words has the target 0 and is not taken.
    """
    sizes = docs.select(F.col(key).alias("__key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *carried)
    sizes = settled(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    goals = settled(source_targets(sizes), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole_times = F.floor(ratio + 1e-9).cast("int")
    rows = sizes.join(
        goals.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))
    ).withColumn("repeats", whole_times).withColumn("pi", F.greatest(F.lit(0.0), ratio - F.col("repeats")))
    keyed = rows.withColumn("key_text", F.col("__key").cast("string"))
    open_ = keyed.filter("pi > 0").select(
        "row", "key_text", "size", "pi",
        F.xxhash64(F.lit("draw"), "key_text").alias("draw"),
        F.xxhash64(F.lit("seed"), "source").alias("seed"),
        F.ceil(F.col("n") / BLOCK_ROWS).cast("long").alias("blocks"),
    )
    levels, deepest = [], goals.agg(F.ceil(F.max("n") / BLOCK_ROWS)).first()[0] or 0
    while deepest:
        # dealt by number, so that no block exceeds BLOCK_ROWS whatever the keys are
        numbered = number_rows(open_, ["seed"], [F.col("draw"), F.col("key_text"), F.col("size"), F.col("row")], "number")
        blocked = numbered.withColumn("block", F.pmod("number", F.col("blocks"))).drop("number")
        flown = blocked.groupBy("seed", "block").applyInPandas(_fly_block, blocked.schema)
        flown = settled(flown, "flown")
        levels.append(flown.filter("pi = 0 or pi = 1").select(F.col("row").alias("__row"), (F.col("pi") == 1).alias("drawn")))
        # two documents of each block are left
        fewer = F.ceil(2 * F.col("blocks") / BLOCK_ROWS).cast("long")
        open_ = flown.filter("pi > 0 and pi < 1").drop("block").withColumn("blocks", fewer)
        deepest = -(-2 * deepest // BLOCK_ROWS) if deepest > 1 else 0
    drawn = levels[0] if levels else open_.select(F.col("row").alias("__row"), F.lit(False).alias("drawn"))
    for level in levels[1:]:
        drawn = drawn.unionByName(level)
    drawn = drawn.filter("drawn")
    times = F.col("repeats") + F.when(F.col("__row").isNotNull(), 1).otherwise(0)
    return rows.join(drawn, F.col("row") == F.col("__row"), "left").select(
        F.col("__key").alias(key), "size", "source_size", "target", times.alias("times"),
        (F.col("size") * times).cast("long").alias("taken"), "source", *carried,
    )


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix, each as many times as it is taken, with all their columns."""
    rows = placed(docs)
    times = mix_sources(rows, key, text, source, ("__place",)).filter("times > 0")
    times = times.select(F.col("__place").alias("__taken"), F.col("times").alias("__times"))
    taken = rows.join(times, F.col("__place") == F.col("__taken"))
    copies = F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")
    return taken.select(*[F.col(c) for c in docs.columns], copies).drop("__copy")


