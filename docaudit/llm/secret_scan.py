"""Secret scans: fixed patterns and character Markov models.

Two first-order models of characters are counted from labelled samples: random strings (the
values that the fixed patterns find) and ordinary identifiers (other long tokens). A token is
reported when the random model explains it much better, by its log-likelihood ratio.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .common import whole

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a longer tail never starts a match that a shorter one lacks
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET) + 1
"""Place 0 stands for the token's start."""
MARGIN = 0.6
"""Least mean log-likelihood ratio per character, in nats."""
BACKOFF = 4.0
"""Transitions that the character's own frequency counts for."""
BLOCK = 512
"""Elements of an array that are merged one by one."""

SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
KINDS = ["assign", "access", "hex", "model"]


def _let(value: Column, body) -> Column:
    """What `body` makes of a value that is computed once, however often it is used in lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, merge) -> Column:
    """For each element of an array of numbers, all up to it merged (their sum, say).

    Appending copies an array, so elements are merged within blocks first, and then blocks.
    """

    def fold(part):
        return F.aggregate(
            part, F.array().cast("array<int>"),
            lambda a, x: F.array_append(a, F.coalesce(merge(F.get(a, F.size(a) - 1), x), x)),
        )

    def join(blocks):
        return _let(
            fold(F.transform(blocks, lambda x: F.get(x, F.size(x) - 1))),
            lambda sums: F.flatten(F.transform(
                blocks,
                lambda x, i: F.transform(x, lambda y: F.when(i > 0, merge(F.get(sums, i - 1), y)).otherwise(y)),
            )),
        )

    def blocked(v):
        starts = F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))
        return _let(F.transform(starts, lambda at: fold(F.slice(v, at, BLOCK))), join)

    return _let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(v))


def _places(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points.

    What lies between the matches and the matches themselves take turns, so that a match
    ends behind all pieces up to its own and all matches up to itself.
    """
    match, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    pieces = F.arrays_zip(F.split(text, pattern).alias("piece"), match.alias("match"), value.alias("value"))
    # the last piece has no match behind it
    found = F.filter(pieces, lambda x: x["match"].isNotNull())

    def spans(found):
        ends = _running(
            F.transform(found, lambda x: F.length(x["piece"]) + F.length(x["match"])), lambda a, x: a + x
        )
        return F.zip_with(
            found, ends,
            lambda x, end: F.struct(
                (end - F.length(x["match"])).alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                end.alias("end"),
                F.lit(kind).alias("kind"),
                x["value"].alias("value"),
            ),
        )

    return F.when(text.rlike(pattern), _let(found, spans)).otherwise(F.array()).cast(SPANS)


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no span of the base.

    Base spans by their start and tokens by their end are put in order; a token is apart if all
    base spans that start before its end also end before its start.
    """

    def event(at, is_base, reach):
        return lambda x: F.struct(
            x[at].alias("at"), F.lit(is_base).alias("is_base"), (x["end"] if reach else F.lit(0)).alias("reach"), x.alias("span")
        )

    events = F.sort_array(F.concat(F.transform(tokens, event("end", 0, False)), F.transform(base, event("start", 1, True))))

    def clear(events):
        reach = _running(F.transform(events, lambda x: x["reach"]), lambda a, x: F.when(a > x, a).otherwise(x))
        kept = F.zip_with(
            events, reach, lambda x, r: F.when((x["is_base"] == 0) & (r <= x["span"]["start"]), x["span"])
        )
        return F.filter(kept, lambda x: x.isNotNull())

    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), _let(events, clear)).otherwise(tokens)


def _spelled(spans: Column) -> Column:
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, tokens): spans of the fixed patterns, and the long tokens apart from them.

    The base is what the three patterns find; an assignment needs a value of 6 characters.
    """
    read = docs.select(F.col(key).alias("__key"), whole(F.col(text)).alias("__text"))
    t = F.col("__text")
    found = read.select(
        "__key",
        F.filter(_places(t, ASSIGN, "assign", 2), lambda x: F.length(x["value"]) >= 6).alias("__assign"),
        _places(t, ACCESS, "access").alias("__access"),
        _places(t, HEX, "hex").alias("__hex"),
        _places(t, TOKEN, "model").alias("__tokens"),
    ).withColumn("base", F.concat("__assign", "__access", "__hex"))
    return found.select("__key", "base", _apart(F.col("__tokens"), F.col("base")).alias("tokens"))


def _places_of(token: Column) -> Column:
    """A cell of the transition table for each character of a token: its predecessor and itself."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return _let(codes, lambda v: F.transform(v, lambda c, i: F.when(i > 0, F.get(v, i - 1)).otherwise(0) * WIDTH + c))


def log_ratios(scanned: DataFrame) -> list[float]:
    """Log-likelihood ratio of every transition, random against ordinary.

    Samples are labelled by the fixed patterns: their values are random strings, long tokens
    apart from them are ordinary. The table has WIDTH * WIDTH cells whatever the corpus holds,
    and only these counts reach the driver. Rare transitions lean on the frequency of their
    character alone.
    """
    samples = scanned.select(F.explode("base").alias("x"), F.lit(1).alias("random")).unionByName(
        scanned.select(F.explode("tokens").alias("x"), F.lit(0).alias("random"))
    )
    known = samples.select("random", F.regexp_replace("x.value", "[^A-Za-z0-9+/_=-]", "").alias("value"))
    counts = (
        known.filter(F.length("value") > 0)
        .select("random", F.explode(_places_of(F.col("value"))).alias("cell"))
        .groupBy("random", "cell").agg(F.count("*").alias("n")).collect()
    )
    n = np.zeros((2, WIDTH, WIDTH))
    for row in counts:
        n[row["random"]].flat[row["cell"]] = row["n"]
    n[0] = np.maximum(n[0] - 1, 0)  # a token that is judged must not vouch for itself
    single = (n.sum(1) + 0.5) / (n.sum((1, 2)) + 0.5 * WIDTH)[:, None]
    chance = (n + BACKOFF * single[:, None, :]) / (n.sum(2, keepdims=True) + BACKOFF)
    return (np.log(chance[1]) - np.log(chance[0])).ravel().tolist()


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of every row: counts and spans of the base, and all spans with the model's.

    Spans are in code points, `kind:start:end` by start then kind, joined by commas. A token
    is reported as `model` if its mean log-likelihood ratio per character is over MARGIN; it
    never overlaps a span of the base, and base spans always stay. Null texts count as empty
    and have no spans; an empty table gives no rows; repeated rows are scanned each; extra
    columns are ignored. Without samples of either kind the models agree and report nothing.
    The work grows with the length of a text, and with n log n of its matches.
    """
    scanned = settled(candidates(docs, key, text), "candidates")
    table = F.split(F.lit(",".join(map(repr, log_ratios(scanned)))), ",").cast("array<double>")
    found = F.filter(
        "tokens",
        lambda x: F.aggregate(_places_of(x["value"]), F.lit(0.0), lambda a, c: a + F.get(table, c))
        > MARGIN * F.length(x["value"]),
    )

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        F.col("__key").alias(key), count("assign"), count("access"), count("hex"),
        F.sha2(_spelled(F.col("base")), 256).alias("base_sha256"),
        _spelled(F.concat("base", found)).alias("spans"),
        F.size(found).cast("long").alias("n_model"),
    )
