"""Quality classifier: a factorisation machine.

Hashed words, structure statistics and the metadata `n_chars` are the features. Every pair of
features interacts through low-rank vectors; the sum over pairs is taken in linear time as half
of the squared sum less the sum of squares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .hashing import text_bytes, word_hashes

WORD_BITS = 15
RANK = 8
TRAIN_ROWS = 10_000
"""Bound on the labelled rows that the model is fitted on."""
EPOCHS = 6
VISITS = 40_000
"""Training goes on for EPOCHS rounds, and further until it has visited so many rows."""
RATE = 0.05
DENSE = [
    "words", "word_length", "distinct_words", "distinct_runs", "capitals", "digits", "points", "symbols",
    "line_words", "lines", "wide", "characters",
]
_CLASSES = {
    "capitals": [(65, 90)],
    "digits": [(48, 57)],
    "points": [(33, 34), (39, 41), (44, 46), (58, 59), (63, 63)],
    "symbols": [(35, 38), (42, 43), (47, 47), (60, 62), (64, 64), (91, 96), (123, 126)],
    "wide": [(128, 255)],
}


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[offsets])


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different values each owner has."""
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    fresh = np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])])
    return np.bincount(o[fresh], minlength=n).astype(float)


def features(texts: pa.Array, n_chars: np.ndarray):
    """(text of each entry, word cell, value), and the dense statistics, for a batch of texts.

    Words enter with the logarithm of their count, scaled to length one per text.
    """
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    words, bounds = word_hashes(data, offsets)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(n), count)
    cell = (words & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    entries, times = np.unique((owner << WORD_BITS) | cell, return_counts=True)
    row, cell = entries >> WORD_BITS, entries & ((1 << WORD_BITS) - 1)
    value = 1.0 + np.log(times)
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = value / np.maximum(norm, 1e-9)[row]

    size = np.maximum(np.diff(offsets), 1)
    runs = words[:-2] + words[1:-1] * np.uint64(3) + words[2:] * np.uint64(5) if len(words) > 2 else words[:0]
    inner = owner[:-2] == owner[2:] if len(words) > 2 else np.zeros(0, bool)
    lines = _per_text(data == 10, offsets) + 1.0
    share = {}
    for name, ranges in _CLASSES.items():
        table = np.zeros(256, bool)
        for low, high in ranges:
            table[low : high + 1] = True
        share[name] = _per_text(table[data], offsets) / size
    some = np.maximum(count, 1)
    run_count = np.maximum(np.bincount(owner[:-2][inner], minlength=n) if len(words) > 2 else np.zeros(n), 1)
    dense = np.stack(
        [
            np.log1p(count),
            _per_text(data > 32, offsets) / some,
            np.bincount(row, minlength=n) / some,
            _distinct(runs[inner], owner[:-2][inner], n) / run_count if len(words) > 2 else np.zeros(n),
            share["capitals"], share["digits"], share["points"], share["symbols"],
            np.log1p(count / lines),
            lines / some,
            share["wide"],
            np.log1p(np.maximum(n_chars, 0)),
        ],
        axis=1,
    )
    return row, cell, value, dense


class Machine:
    """A fitted factorisation machine over 2^WORD_BITS word cells and the dense statistics."""

    def __init__(self, seed: int = 7):
        cells = (1 << WORD_BITS) + len(DENSE)
        self.bias = 0.0
        self.linear = np.zeros(cells)
        self.vectors = np.random.default_rng(seed).normal(0, 0.02, (cells, RANK))
        self.mean, self.scale = np.zeros(len(DENSE)), np.ones(len(DENSE))

    def entries(self, row, cell, value, dense):
        """Word entries and dense entries as one sorted list."""
        n = len(dense)
        scaled = np.clip((dense - self.mean) / self.scale, -4, 4) * 0.5
        rows = np.concatenate([row, np.repeat(np.arange(n), len(DENSE))])
        cells = np.concatenate([cell, np.tile(np.arange(len(DENSE)) + (1 << WORD_BITS), n)])
        values = np.concatenate([value, scaled.ravel()])
        order = np.argsort(rows, kind="stable")
        return rows[order], cells[order], values[order]

    def raw(self, rows, cells, values, n):
        """Score before the logistic function, and the sums of vectors that a gradient needs."""
        at = np.searchsorted(rows, np.arange(n))
        weighed = self.vectors[cells] * values[:, None]
        sums = np.add.reduceat(weighed, at)
        squares = np.add.reduceat((weighed * weighed).sum(1), at)
        line = np.add.reduceat(self.linear[cells] * values, at)
        return self.bias + line + 0.5 * ((sums * sums).sum(1) - squares), sums

    def predict(self, row, cell, value, dense):
        if not len(dense):
            return np.zeros(0)
        raw, _ = self.raw(*self.entries(row, cell, value, dense), len(dense))
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, row, cell, value, dense, label, seed: int = 11):
        """Logistic loss by adaptive gradient steps over small batches."""
        if not len(label):
            return self
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-6
        rows, cells, values = self.entries(row, cell, value, dense)
        at = np.searchsorted(rows, np.arange(len(label) + 1))
        good = min(max(label.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(good / (1 - good)))
        grown_linear, grown_vectors = np.full(self.linear.shape, 1e-6), np.full(self.vectors.shape, 1e-6)
        draw = np.random.default_rng(seed)
        for _ in range(max(EPOCHS, -(-VISITS // len(label)))):
            for chosen in np.array_split(draw.permutation(len(label)), max(1, len(label) // 64)):
                sizes = at[chosen + 1] - at[chosen]
                pick = np.repeat(at[chosen], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                own, c, v = np.repeat(np.arange(len(chosen)), sizes), cells[pick], values[pick]
                raw, sums = self.raw(own, c, v, len(chosen))
                slope = 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - label[chosen]
                self.bias -= 0.2 * RATE * float(slope.mean())
                touched, where = np.unique(c, return_inverse=True)
                pull = slope[own] * v
                step = np.bincount(where, pull) + 1e-3 * self.linear[touched]
                grown_linear[touched] += step * step
                self.linear[touched] -= RATE * step / np.sqrt(grown_linear[touched])
                bend = pull[:, None] * (sums[own] - self.vectors[c] * v[:, None])
                step = np.stack([np.bincount(where, bend[:, f]) for f in range(RANK)], 1) + 1e-3 * self.vectors[touched]
                grown_vectors[touched] += step * step
                self.vectors[touched] -= RATE * step / np.sqrt(grown_vectors[touched])
        return self


def _extract(batches):
    for b in batches:
        row, cell, value, dense = features(b.column("text"), _numbers(b.column("n_chars")))
        cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
        lists = [
            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(cell.astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(value.astype(np.float32))),
            pa.array(list(dense.astype(np.float32)), pa.list_(pa.float32())),
        ]
        yield pa.RecordBatch.from_arrays([b.column("label"), *lists], names=["label", "cell", "value", "dense"])


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most `rows` labelled documents that are not held out.

    The sample is by the keys' hashes; it is broadcast, being bounded, to the scan of the texts.
    """
    small_batches(docs.sparkSession)
    free = labels.filter(~held_out(F.col(key), 0) & F.col("quality").isNotNull())
    sample = free.orderBy(F.xxhash64(key), key, "quality").limit(rows).select(
        F.col(key).alias("__key"), F.col("quality").cast("double").alias("label")
    )
    read = docs.select(
        F.col(key).alias("__own"), F.col(text).alias("text"), F.col("n_chars").cast("long").alias("n_chars")
    )
    got = (
        read.join(F.broadcast(sample), F.col("__own") == F.col("__key"))
        .select("label", "text", "n_chars")
        .mapInArrow(_extract, "label double, cell array<int>, value array<float>, dense array<float>")
        .toArrow()
        .combine_chunks()
    )
    machine = Machine()
    if not got.num_rows:
        return machine
    cells, values, dense = (got.column(c).combine_chunks() for c in ("cell", "value", "dense"))
    sizes = np.diff(np.asarray(cells.offsets))
    label = got.column("label").to_numpy()
    flat = np.asarray(dense.flatten(), float).reshape(-1, len(DENSE))
    # the order of rows from the cluster is arbitrary
    order = np.lexsort((*flat.T, label))
    starts = np.asarray(cells.offsets)[:-1][order] - cells.offsets[0].as_py()
    sizes = sizes[order]
    pick = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(label)), sizes)
    return machine.fit(
        row, np.asarray(cells.flatten(), np.int64)[pick], np.asarray(values.flatten(), float)[pick], flat[order], label[order]
    )


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row.

    `predicted` is 1 from a score of 0.3 on. Null and empty texts are scored by their
    statistics; a null `n_chars` counts as 0; repeated rows get equal scores; an empty table
    gives no rows. Labels, languages, sources and keys are no inputs; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def run(batches):
        for b in batches:
            got = sent.value.predict(*features(b.column("text"), _numbers(b.column("n_chars"))))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(got, pa.float64())], names=["key", "score"])

    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    kind = read.schema["key"].dataType.simpleString()
    scored = read.mapInArrow(run, f"key {kind}, score double")
    return scored.select(
        F.col("key").alias(key), held_out(F.col("key"), 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )
