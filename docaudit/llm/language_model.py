"""Hidden Markov language model.

Words fall into classes by their hash; latent states emit classes, and a class emits its words
by their smoothed counts. Baum-Welch counts, aggregated across partitions, train the states.
The scaled forward recursion then gives the exact probability of a whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .common import held_out, small_batches
from .hashing import mix, text_bytes, word_hashes

STATES = 8
CLASSES = 2048
"""Classes of words; one more class holds the end of a text."""
ROUNDS = 4
SEGMENT = 64
"""Tokens that Baum-Welch sees as one sequence; later segments of a text have their own start."""
GROUP_TOKENS = 1 << 21
"""Tokens that a task holds at once."""
LONG_TEXT = 1 << 15
"""Tokens from which on a text is scored by products of the transfer matrices of its stretches."""
FREQUENT = 1 << 20
"""A word is broadcast, at 16 bytes, if it makes at least one in so many of the training tokens, so that
there are at most so many of them; the others are joined, and none of them is a hot key."""
END = np.uint64(0)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token of each place, bounds of the texts): word hashes, then END once per text."""
    words, bounds = word_hashes(*text_bytes(texts))
    words[words == END] = np.uint64(1)
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def _classes(tokens: np.ndarray) -> np.ndarray:
    return np.where(tokens == END, CLASSES, (mix(tokens) >> np.uint64(53)).astype(np.int64)).astype(np.uint16)


def prepare(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, held_out, classes): the class of every token of each text, as 16-bit integers."""

    def run(batches):
        for b in batches:
            tokens, bounds = _tokens(b.column("text"))
            body = pa.py_buffer(_classes(tokens).tobytes())
            classes = pa.Array.from_buffers(
                pa.binary(), b.num_rows, [None, pa.py_buffer((bounds * 2).astype(np.int32).tobytes()), body]
            )
            yield pa.RecordBatch.from_arrays([b.column("held_out"), classes], names=["held_out", "classes"])

    read = docs.select(held_out(F.col(key), 1).alias("held_out"), F.col(text).alias("text"))
    return read.mapInArrow(run, "held_out boolean, classes binary")


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, n): how often each token occurs in the texts that are not held out.

    Words stand as 64-bit hashes, END as 0. Each batch is counted before the shuffle.
    """

    def run(batches):
        for b in batches:
            word, n = np.unique(_tokens(b.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    read = docs.filter(~held_out(F.col(key), 1)).select(F.col(text).alias("text"))
    return read.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """Start, transition and emission probabilities of the states, of fixed size."""

    def __init__(self, class_counts: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        share = (class_counts + 0.5) / (class_counts + 0.5).sum()
        self.emit = share * rng.uniform(0.2, 1.8, (STATES, CLASSES + 1))
        self.emit /= self.emit.sum(1, keepdims=True)
        self.move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        self.start = np.full((2, STATES), 1.0 / STATES)

    def expect(self, observed: np.ndarray, real: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Expected counts of segments (time x segment), as one vector; `real` marks tokens."""
        steps, n = observed.shape
        seen = self.emit.T[observed]
        alpha = np.empty((steps, n, STATES))
        scale = np.ones((steps, n))
        now = self.start[inner] * seen[0]
        for t in range(steps):
            if t:
                now = np.where(real[t][:, None], (alpha[t - 1] @ self.move) * seen[t], alpha[t - 1])
            scale[t] = now.sum(1)
            alpha[t] = now / scale[t][:, None]
        beta = np.ones((n, STATES))
        moves, emits = np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))
        for t in range(steps - 1, -1, -1):
            gamma = alpha[t] * beta
            gamma /= gamma.sum(1, keepdims=True)
            gamma *= real[t][:, None]
            for k in range(STATES):
                emits[:, k] += np.bincount(observed[t], gamma[:, k], CLASSES + 1)
            if t:
                ahead = seen[t] * beta / scale[t][:, None]
                use = real[t]
                moves += alpha[t - 1][use].T @ ahead[use]
                beta = np.where(use[:, None], ahead @ self.move.T, beta)
        starts = np.zeros((2, STATES))
        np.add.at(starts, inner, gamma)
        return np.concatenate([starts.ravel(), (moves * self.move).ravel(), emits.T.ravel()])

    def learn(self, counts: np.ndarray) -> None:
        cut = 2 * STATES, 2 * STATES + STATES * STATES
        parts = counts[: cut[0]], counts[cut[0] : cut[1]], counts[cut[1] :]
        self.start, self.move, self.emit = (
            (p.reshape(-1, width) + least) / (p.reshape(-1, width) + least).sum(1, keepdims=True)
            for p, width, least in zip(parts, (STATES, STATES, CLASSES + 1), (0.1, 0.1, 0.01))
        )

    def log10(self, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence of classes, by the scaled forward recursion."""
        sizes = np.diff(bounds)
        out = np.zeros(len(sizes))
        for i in np.flatnonzero(sizes > LONG_TEXT):
            out[i] = self._long(classes[bounds[i] : bounds[i + 1]])
        order = np.flatnonzero(sizes <= LONG_TEXT)
        order = order[np.argsort(-sizes[order], kind="stable")]
        at, left = bounds[:-1][order], sizes[order]
        alive, now, emit = len(order), None, self.emit.T.copy()
        for t in range(int(left[0]) if len(left) else 0):
            alive = int(np.searchsorted(-left[:alive], -t))  # those longer than t come first
            seen = emit[classes[at[:alive] + t]]
            now = self.start[0] * seen if t == 0 else (now[:alive] @ self.move) * seen
            total = now.sum(1)
            now /= total[:, None]
            out[order[:alive]] += np.log10(total)
        return out

    def _long(self, classes: np.ndarray) -> float:
        """The same for one very long text: all stretches advance at once from every state."""
        head, tail = classes[0], classes[1:]
        steps = max(1, int(np.sqrt(len(tail))))
        n = -(-len(tail) // steps)
        padded = np.zeros(n * steps, np.int64)
        padded[: len(tail)] = tail
        real = (np.arange(n * steps) < len(tail)).reshape(n, steps)
        padded = padded.reshape(n, steps)
        carry, logs = np.broadcast_to(np.eye(STATES), (n, STATES, STATES)).copy(), np.zeros(n)
        for t in range(steps):
            use = real[:, t]
            ahead = (carry[use] @ self.move) * self.emit.T[padded[use, t]][:, None, :]
            total = ahead.sum((1, 2))
            carry[use] = ahead / total[:, None, None]
            logs[use] += np.log10(total)
        now = self.start[0] * self.emit[:, head]
        log = np.log10(now.sum())
        now = now / now.sum()
        for i in range(n):
            now = now @ carry[i]
            log += logs[i] + np.log10(now.sum())
            now = now / now.sum()
        return float(log)


def _segments(classes: np.ndarray, bounds: np.ndarray):
    """Texts cut into segments: (observed, real, inner) with time first, a few thousand at once."""
    sizes = np.diff(bounds)
    pieces = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = bounds[:-1][text] + number * SEGMENT
    length = np.minimum(SEGMENT, bounds[1:][text] - start)
    for low in range(0, len(start), 4096):
        s, n = start[low : low + 4096], length[low : low + 4096]
        place = np.arange(SEGMENT)[:, None]
        real = place < n
        yield classes[np.minimum(s + place, len(classes) - 1)], real, (number[low : low + 4096] > 0).astype(int)


def train(prepared: DataFrame, class_counts: np.ndarray) -> Model:
    """A model after ROUNDS of Baum-Welch over all texts that are not held out.

    Each partition adds its expected counts to one vector of fixed size; the vectors are summed
    on the cluster.
    """
    model = Model(class_counts)
    context = prepared.sparkSession.sparkContext
    learnt = prepared.filter(~F.col("held_out")).select("classes")
    for _ in range(ROUNDS):
        sent = context.broadcast(model)

        def run(batches, sent=sent):
            total = None
            for b in batches:
                column = b.column("classes").cast(pa.large_binary())
                body, offsets = text_bytes(column)
                for part in _segments(body.view(np.uint16), offsets // 2):
                    counts = sent.value.expect(*part)
                    total = counts if total is None else total + counts
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "n"])

        sums = learnt.mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        if not sums.num_rows:
            break
        counts = np.zeros(sums.num_rows)
        counts[sums.column("i").to_numpy()] = sums.column("n").to_numpy()
        model.learn(counts)
    return model


def _by_class(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct tokens of each class, as learnt."""

    def run(batches):
        for b in batches:
            of = _classes(b.column("word").to_numpy().view(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(of), b.column("n")], names=["class", "n"])

    rows = counts.mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    tokens, distinct = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in rows.collect():
        tokens[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    return tokens, distinct


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The base is a unigram model with half a count added to every token and to the unknown one.
    The score is the hidden Markov model's: the probability of the text's classes by the
    forward recursion, times that of each word within its class, smoothed in the same way; the
    words unknown to a class share its half count.

    Counts of words that make one in `frequent` training tokens are broadcast, and those of all
    other words joined with the distinct words of each text. Null and empty texts are the end alone. If nothing is learnt from, all
    counts are 0. A null key is never held out; repeated rows are scored each; an empty table
    gives no rows; extra columns are ignored.
    """
    spark = small_batches(docs.sparkSession, 1024)
    counts = settled(word_counts(docs, key, text), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    in_class, words_of = _by_class(counts)
    model = train(settled(prepare(docs, key, text), "classes"), in_class)
    sent = spark.sparkContext.broadcast((model, in_class, words_of))
    least = max(1, -(-total // frequent))
    often = counts.filter(F.col("n") >= least).toArrow()
    words, n = often.column("word").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(words)
    table = spark.sparkContext.broadcast((words[order], n[order]))

    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = read.schema["key"].dataType.simpleString()
    base_unit = total + 0.5 * (distinct + 1)

    def within(word, n):
        """Logarithms of a word's share of all tokens, and of its class."""
        model, in_class, words_of = sent.value
        of = _classes(word)
        inner = np.log10((n + 0.5) / (in_class[of] + 0.5 * (words_of[of] + 1)))
        return np.log10((n + 0.5) / base_unit), np.where(of == CLASSES, 0.0, inner)

    def states(batches):
        """Forward scores, scores of the frequent words, and what other words a text holds how often."""
        for group in _grouped(batches):
            tokens, bounds = _tokens(group.column("text"))
            size, text_of = np.diff(bounds), np.repeat(np.arange(group.num_rows), np.diff(bounds))
            hidden = sent.value[0].log10(_classes(tokens), bounds)
            word, back = np.unique(tokens, return_inverse=True)
            words, n = table.value
            at = np.minimum(np.searchsorted(words, word), max(len(words) - 1, 0))
            met = words[at] == word if len(words) else np.zeros(len(word), bool)
            base, inner = within(word, n[at] if len(words) else np.zeros(len(word)))
            sums = [np.bincount(text_of, np.where(met, x, 0)[back], group.num_rows) for x in (met, base, inner)]
            rare = np.flatnonzero(~met[back])
            pair, times = np.unique(text_of[rare] * len(word) + back[rare], return_counts=True)
            parts = pa.array(np.searchsorted(pair, np.arange(group.num_rows + 1) * len(word)).astype(np.int32))
            columns = [group.column("key").combine_chunks(), pa.array(size), pa.array(hidden), pa.array(sums[0]).cast(pa.int64())]
            columns += [pa.array(x) for x in sums[1:]]
            columns.append(pa.ListArray.from_arrays(parts, pa.array(word[pair % len(word)].view(np.int64))))
            columns.append(pa.ListArray.from_arrays(parts, pa.array(times)))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in found.split(", ")])

    def rate(batches):
        for b in batches:
            n, times = b.column("n").to_numpy(), b.column("times").to_numpy()
            base, inner = within(b.column("word").to_numpy().view(np.uint64), n)
            columns = [b.column("row"), *(pa.array(x * times) for x in ((n > 0).astype(np.int64), base, inner))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "known", "base", "within"])

    found = f"key {kind}, n_tokens long, hidden double, n_known long, base_score double, inner double, words array<long>, times array<long>"
    scored = settled(read.mapInArrow(states, found).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.words", "x.times")
    rare = rare.withColumnRenamed("words", "word").join(counts.filter(F.col("n") < least), "word", "left")
    rated = rare.select("row", "word", "times", F.coalesce("n", F.lit(0)).alias("n")).mapInArrow(
        rate, "row long, known long, base double, within double"
    )
    sums = rated.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "base", "within")])
    whole = scored.drop("words", "times").join(sums, "row", "left")

    def both(own, joined):
        return F.col(own) + F.coalesce(joined, F.lit(0))

    return whole.select(
        F.col("key").alias(key), held_out(F.col("key"), 1).alias("held_out"), "n_tokens", both("n_known", "known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), both("base_score", "base").alias("base_score"),
        (F.col("hidden") + both("inner", "within")).alias("score"),
    )


def _grouped(batches):
    """Batches put together up to GROUP_TOKENS or so, by their bytes."""
    waiting, size = [], 0
    for b in batches:
        waiting.append(b)
        size += b.nbytes
        if size >= 6 * GROUP_TOKENS:
            yield pa.Table.from_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)
