"""Cost-balanced packing of tokenised documents into sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n^2, the work of a layer whose attention
stays inside of the document. Pieces are taken from the longest down, each for the sequence of
lowest cost that has room. Packing needs no shuffle: each partition packs its own documents, in
blocks of bounded size.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

CAPACITY = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
BLOCK_TOKENS = 1 << 20
SLICE = 1 << 20
"""Texts of more characters are tokenised in slices, cut where two words of letters meet."""
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"
_SPECIAL = "<|endoftext|>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoders(path: str):
    """(the tokenizer, the same vocabulary as a byte-pair encoder with and without look-ahead)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    pattern = public_tokenizers.PATTERN
    exact, plain = (
        tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
        for name, p in (("exact", pattern), ("plain", pattern.replace(r"|\s+(?!\S)", "")))
    )
    return Tokenizer.from_file(path), exact, plain


def encode(text: str, path: str) -> np.ndarray:
    """Token ids of the whole text and END_ID, as unsigned 32-bit integers.

    The byte-pair encoder gives the ids of the tokenizer, only faster. Without runs of white
    space the look-ahead of its pattern never decides, so the pattern without it serves. A
    text that spells a special token goes to the tokenizer itself.
    """
    tokenizer, exact, plain = _encoders(path)
    if _SPECIAL in text:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return np.array([*ids, END_ID], "<u4")
    parts, at = [], 0
    while at < len(text):
        to = len(text)
        if to - at > SLICE and (cut := re.compile("[A-Za-z] [A-Za-z]").search(text, at + SLICE)):
            to = cut.start() + 1
        piece = text[at:to]
        single = len(" ".join(piece.split())) == len(piece)
        parts.append(np.array((plain if single else exact).encode_ordinary(piece), "<u4"))
        at = to
    return np.concatenate([*parts, np.array([END_ID], "<u4")])


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) for each piece.

    There are as many full sequences as the tokens fill; the rest goes to sequences of powers
    of two, which need no padding either. Items go from the longest down to the sequence of
    lowest cost with room for them; where none has room, the cheapest open one takes what it
    can, and the rest goes on.
    """
    total = sum(lengths)
    room = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length())[::-1] if total % capacity >> b & 1]
    room, cost = np.array(room, np.int64), np.zeros(len(room))
    used, out = np.zeros(len(room), np.int64), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start = 0
        while start < lengths[item]:
            left = lengths[item] - start
            fits = room >= left
            to = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            n = min(left, int(room[to]))
            out.append((item, start, n, to, int(used[to])))
            room[to] -= n
            used[to] += n
            cost[to] += LINEAR * n + QUADRATIC * n * n
            start += n
    return out


def _packer(path: str, capacity: int):
    def batch(rows):
        columns = list(zip(*rows))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def row(key, start, ids, doc_tokens, sequence, offset):
        n = len(ids)
        return key, start, n, ids.tobytes(), doc_tokens, sequence, offset, LINEAR * n + QUADRATIC * n * n

    def pack(batches):
        sequence = TaskContext.get().partitionId() << 33
        pool, waiting, ready = [], 0, []

        def flush():
            nonlocal sequence
            places = assign([len(ids) for _, _, ids, _ in pool], capacity)
            for item, start, n, to, offset in places:
                key, first, ids, doc_tokens = pool[item]
                ready.append(row(key, first + start, ids[start : start + n], doc_tokens, sequence + to, offset))
            sequence += 1 + max((p[3] for p in places), default=-1)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py() or "", path)
                full = len(ids) // capacity * capacity
                for at in range(0, full, capacity):
                    ready.append(row(key, at, ids[at : at + capacity], len(ids), sequence, 0))
                    sequence += 1
                    if len(ready) >= 2048:
                        yield batch(ready)
                        ready = []
                if full < len(ids):
                    pool.append((key, full, ids[full:], len(ids)))
                    waiting += len(ids) - full
                if waiting >= BLOCK_TOKENS:
                    flush()
                    pool, waiting = [], 0
                    yield batch(ready)
                    ready = []
        flush()
        if ready:
            yield batch(ready)

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents in sequences: SCHEMA, with the token ids as little-endian bytes.

    `tokenizer` is the path of a byte-level tokenizer file beside its ranks file, on every
    machine. A document's tokens are its ids and END_ID; each lies in exactly one piece.
    Pieces of `capacity` are sequences by themselves; the rest of each document is packed.
    Every sequence holds `capacity` tokens or a power of two, so none is padded; offsets in it
    run on from 0. `sequence_id` is the partition's number and a counter. The result follows
    the order of the input's files; a partition that is run again gives the same pieces.

    Null and empty texts are one token. Null keys are allowed, repeated rows are packed each;
    an empty table gives no rows; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(_packer(tokenizer, capacity), SCHEMA)

