"""Ranked lexical search, term at a time, with a limit on its accumulators.

Documents are read once into term vectors, the index. A task takes its vectors in shards of
bounded size, turns each into posting lists, and answers every query on it: terms from the
rarest to the most frequent, partial scores in accumulators. As soon as what the remaining terms
can add at most is less than the kth best partial score, no new accumulator can get among the
best k; from then on only documents that have one are updated, and these get their exact scores.
The best k of all documents are among the best k of the shards.

Queries go to the tasks in blocks of a bounded number of terms, each with one pass over the index.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..session import settled
from .common import small_batches

TOP = 20
SHARD_POSTINGS = 1 << 21
"""Postings of a shard; a document is never split, so a shard may exceed this by one document."""
QUERY_TERMS = 1 << 18
"""Terms (with repeats over queries) of a block of queries; a query is never split."""
VECTORS = "terms array<string>, tfs array<int>, n_terms long"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
"""Of each byte: lower-cased if A-Z, itself if part of a term, else a blank. Bytes from 128 on
only occur in characters beyond ASCII, which are all parts of terms."""


def terms_of(text: str | None) -> Counter:
    """Terms with their occurrences, as UTF-8."""
    return Counter((text or "").encode().translate(_TABLE).split())


def term_vectors(rows: DataFrame, text: str) -> DataFrame:
    """The rows with their distinct terms, how often each occurs, and all terms with repeats.

    The text itself is left out. Null and empty texts have no terms.
    """
    others = [f for f in rows.schema.fields if f.name != text]
    names = [f.name for f in others]

    def run(batches):
        for b in batches:
            counted = [terms_of(t) for t in b.column(len(names)).to_pylist()]
            ends = np.cumsum([0, *map(len, counted)]).astype(np.int32)
            flat = pa.array([t for c in counted for t in c], pa.binary()).cast(pa.string())
            tfs = pa.array([n for c in counted for n in c.values()], pa.int32())
            total = pa.array([c.total() for c in counted], pa.int64())
            columns = [pa.ListArray.from_arrays(pa.array(ends), flat), pa.ListArray.from_arrays(pa.array(ends), tfs), total]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *columns], names=[*names, "terms", "tfs", "n_terms"])

    small_batches(rows.sparkSession)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], VECTORS])
    return rows.select(*names, text).mapInArrow(run, schema)


@dataclass(frozen=True)
class Queries:
    """A block of queries: the terms, their weights, and per query its terms from the rarest on."""

    words: pa.Array
    weights: np.ndarray
    numbers: list[int]
    ids: list[int | None]
    terms: list[np.ndarray]
    times: list[np.ndarray]


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def _queries(entries: pa.Table, found: dict[str, int], total: int) -> Queries:
    words = sorted(set(entries["term"].to_pylist()))
    place = {w: i for i, w in enumerate(words)}
    df = [found.get(w, 0) for w in words]
    by: dict[int, list] = {}
    for number, key, term, times in zip(*(entries[c].to_pylist() for c in ("number", "item_id", "term", "times"))):
        by.setdefault(number, [key]).append((df[place[term]], place[term], times))
    listed = [sorted(x[1:]) for x in by.values()]
    return Queries(
        pa.array(words, pa.string()), np.array([weight(total, n) for n in df], np.int64), list(by), [x[0] for x in by.values()],
        [np.array([t for _, t, _ in x]) for x in listed], [np.array([n for *_, n in x], np.int64) for x in listed],
    )


def best_of_shard(q: Queries, term, doc, tf, slack, order, top: int):
    """For each query: (its place in the block, documents, scores), at most `top` of them.

    `term`, `doc` and `tf` are the shard's postings, `slack` each document's length norm m;
    documents are numbered in the `order` that decides between equal scores.
    """
    by_term = np.argsort(term, kind="stable")
    term, doc, tf = term[by_term], doc[by_term], tf[by_term]
    gain = q.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * slack[doc]))
    ends = np.searchsorted(term, np.arange(len(q.words) + 1))
    most = np.zeros(len(q.words), np.int64)
    here = np.flatnonzero(ends[1:] > ends[:-1])
    if len(here):
        most[here] = np.maximum.reduceat(gain, ends[here])
    score = np.zeros(len(slack), np.int64)
    for i, (terms, times) in enumerate(zip(q.terms, q.times)):
        score[:] = 0
        rest = np.cumsum((times * most[terms])[::-1])[::-1]
        held = None  # the documents with accumulators, once no more are made
        for at, (t, n) in enumerate(zip(terms.tolist(), times.tolist())):
            docs, add = doc[ends[t] : ends[t + 1]], gain[ends[t] : ends[t + 1]]
            if not len(docs):
                continue
            if held is None and rest[at] < _kth(score, top):
                held = score > 0
            if held is not None:
                reached = held[docs]
                docs, add = docs[reached], add[reached]
            score[docs] += n * add
        limit = max(_kth(score, top), 1)
        docs = np.flatnonzero(score >= limit)
        docs = docs[np.lexsort((order[docs], -score[docs]))][:top]
        if len(docs):
            yield i, docs, score[docs]


def _kth(score: np.ndarray, k: int) -> int:
    """The kth best of the scores above 0; 0 if there are fewer."""
    found = score[score > 0]
    return int(np.partition(found, len(found) - k)[len(found) - k]) if len(found) >= k else 0


def _shards(batches, words: pa.Array):
    """Shards of batches (doc_id, n_terms, terms, tfs): keys, lengths and the postings of the words."""
    parts, docs, postings = [], 0, 0
    for b in batches:
        lists, tfs = b.column(2), b.column(3)
        sizes = np.diff(lists.offsets.to_numpy())
        found = pc.index_in(lists.flatten(), value_set=words)
        known = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
        term = found.drop_null().to_numpy().astype(np.int32)
        owner = np.repeat(np.arange(docs, docs + len(sizes)), sizes)[known]
        parts.append((b.column(0), b.column(1).to_numpy(), term, owner, tfs.flatten().to_numpy()[known].astype(np.int64)))
        docs, postings = docs + len(sizes), postings + len(term)
        if postings >= SHARD_POSTINGS:
            yield [list(x) for x in zip(*parts)]
            parts, docs, postings = [], 0, 0
    if parts:
        yield [list(x) for x in zip(*parts)]


def _scorer(shared, total: int, length: int, top: int):
    schema = [("number", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]

    def run(batches):
        q: Queries = shared.value
        for keys, n_terms, term, doc, tf in _shards(batches, q.words):
            keys = pa.concat_arrays(keys)
            n_terms, term, doc, tf = (np.concatenate(x) for x in (n_terms, term, doc, tf))
            slack = 100 - 25 + (25 * n_terms * total) // length
            # ascending keys, null last
            order = np.empty(len(keys), np.int64)
            order[pc.sort_indices(keys, null_placement="at_end").to_numpy()] = np.arange(len(keys))
            for i, docs, scores in best_of_shard(q, term, doc, tf, slack, order, top):
                columns = [[q.numbers[i]] * len(docs), [q.ids[i]] * len(docs), keys.take(pa.array(docs)), scores]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])

    return run


def _blocks(items: DataFrame, key: str, text: str) -> DataFrame:
    """(number, item_id, term, times, block) of all queries; a row of `items` is a query."""
    rows = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    rows = number_rows(rows, [], [F.col("item_id"), F.col("text")], "number")
    counted = term_vectors(rows, "text")
    entries = counted.select("number", "item_id", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    entries = entries.select("number", "item_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times"))
    placed = settled(number_rows(entries, [], [F.col("number"), F.col("term")], "place"), "query-terms")
    first = placed.groupBy(F.col("number").alias("query")).agg(F.floor(F.min("place") / QUERY_TERMS).alias("block"))
    return settled(placed.join(first, F.col("number") == F.col("query")).drop("query", "place"), "query-blocks")


def _best(candidates: DataFrame, top: int) -> DataFrame:
    """The best rows of each query, ranked; equal scores by ascending doc_id, null last."""
    order: list[Column] = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    few = candidates.withColumn("rank", F.row_number().over(W.partitionBy("number", "shard").orderBy(*order)))
    few = few.filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", top: int = TOP,
) -> DataFrame:
    """The `top` documents of each query: item_id, rank (int, from 1), doc_id, score.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. With N
    documents that have a term, L terms in all, n in a document and df documents with a term, a
    term weighs floor(1000 ln((2N+2)/(2df+1))), and a document scores for it, tf times in it and
    with m = 75 + 25nN div L, its weight times 10^9 tf div (1000 tf + 12 m); repeats in a query count.
    Documents with score 0 are left out.

    Every row of `items` is a query of its own, also with a null or repeated key; null and empty
    texts find nothing. Every row of `docs` is a document of its own; among equal scores keys
    ascend, and null comes last. Texts are read whole. Empty tables give no rows, extra columns
    are ignored.

    Index and queries are written to the shared folder. What a task is sent and the driver reads
    is one block of queries, of at most 2^18 terms and one query more, and the counts of its terms.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index = settled(term_vectors(read, "text").filter("n_terms > 0"), "term-vectors")
    total, length = index.agg(F.count("*"), F.sum("n_terms")).first()
    blocks = _blocks(items, item_key, item_text)
    count = (blocks.agg(F.max("block")).first()[0] if total else None)
    best = spark.createDataFrame([], "number long, item_id long, doc_id long, score long, shard int, rank int")
    for block in range(0 if count is None else count + 1):
        entries = blocks.filter(F.col("block") == block)
        wanted = entries.select("term").distinct()
        listed = index.select(F.explode("terms").alias("term")).join(wanted, "term").groupBy("term").count()
        found = dict(zip(*listed.toArrow().to_pydict().values()))
        shared = spark.sparkContext.broadcast(_queries(entries.drop("block").toArrow(), found, total))
        scored = index.select("doc_id", "n_terms", "terms", "tfs").mapInArrow(
            _scorer(shared, total, length, top), "number long, item_id long, doc_id long, score long"
        )
        scored = scored.withColumn("shard", F.spark_partition_id() % 64)
        best = best.unionByName(_best(scored, top))
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
