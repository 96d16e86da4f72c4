"""Encoding and decoding by the merges of a SentencePiece model, in vectorised rounds.

A text is a flat numpy array of symbols, one per character at first. It falls apart into words
where no piece of the vocabulary holds the two characters that meet. In each round every word
finds the least rank of its neighbouring pairs (a segmented minimum) and merges, from the left,
all places of that pair at once; the array is then compacted, and words without a pair leave it.
Words of a block are merged once however often they occur.
"""

from __future__ import annotations

import codecs
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLOCK = 1 << 21
"""Characters that are merged together; longer texts go through in slices."""
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
"""Fixed values: the types of pieces in a model file."""
UNKNOWN_TEXT = " ⁇ "
NEVER = np.int32(2**31 - 1)
SCHEMA = "doc_id long, n_tokens long, ids binary"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Model:
    begin: int
    end: int
    byte_ids: np.ndarray
    """Id of the piece of each byte."""
    ranks: np.ndarray
    """Of each entry of `pairs`: its place among the scores, best first; equal scores share it."""
    pairs: np.ndarray
    """Sorted left * n_symbols + right of all pairs that a piece is made of."""
    merged: np.ndarray
    n_symbols: int
    """Pieces, then characters that only occur inside of pieces."""
    n_pieces: int
    place: np.ndarray
    """Of each code point: its place among the characters of the vocabulary, the last if none."""
    symbol: np.ndarray
    """Of each of these places: its symbol, -1 if it has none."""
    meet: np.ndarray
    """Whether a piece holds two characters side by side, by their places."""
    space_run: int
    """Length that runs of spaces may be cut to beforehand, 0 if they may not."""
    decoded: np.ndarray
    """The bytes of all pieces on end, and where each starts."""
    starts: np.ndarray
    led: np.ndarray
    """Whether a piece starts with a space."""
    silent: np.ndarray
    """Whether a piece stands for no text."""


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    """The tables of a BPE model with byte fallback, without normalisation, with a space in front.

    Other models are refused with a ValueError rather than encoded wrongly.
    """
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    norm, trained = proto.normalizer_spec, proto.trainer_spec
    kinds = [p.type for p in proto.pieces]
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces
    plain = plain and not norm.remove_extra_whitespaces and not trained.treat_whitespace_as_suffix
    if not plain or trained.model_type != 2 or not trained.byte_fallback or {USER_DEFINED, UNUSED} & set(kinds):
        raise ValueError("only BPE models with byte fallback, a leading space and no normalisation are supported")

    ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
    chars = sorted({c for piece in ids for c in piece})
    symbols = dict(ids)
    for c in chars:
        symbols.setdefault(c, len(kinds) + len(symbols) - len(ids))
    n = len(kinds) + len(symbols) - len(ids)
    order = {s: r for r, s in enumerate(sorted({proto.pieces[i].score for i in ids.values()}, reverse=True))}
    pairs = {}
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
            if left is not None and right is not None:
                pairs[left * n + right] = (order[proto.pieces[i].score], i)
    keys = np.array(sorted(pairs), np.int64)
    values = np.array([pairs[k] for k in keys.tolist()], np.int32).reshape(-1, 2)

    place = np.full(0x110000, len(chars), np.int32)
    place[[ord(c) for c in chars]] = np.arange(len(chars))
    meet = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    for piece in ids:
        at = place[[ord(c) for c in piece]]
        meet[at[:-1], at[1:]] = True

    surface = [_surface(p, i) for i, p in enumerate(proto.pieces)]
    model = Model(
        begin=trained.bos_id, end=trained.eos_id,
        byte_ids=np.array([i for i, k in enumerate(kinds) if k == BYTE], np.int32),
        pairs=keys, ranks=values[:, 0], merged=values[:, 1], n_symbols=n, n_pieces=len(kinds),
        place=place, symbol=np.array([symbols[c] for c in chars] + [-1], np.int32), meet=meet, space_run=0,
        decoded=np.frombuffer(b"".join(surface), np.uint8), starts=np.cumsum([0, *map(len, surface)]),
        led=np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces]),
        silent=np.array([k == CONTROL for k in kinds]),
    )
    return Model(**{**model.__dict__, "space_run": _space_run(model, ids, order, proto)})


def _surface(piece, i: int) -> bytes:
    if piece.type == BYTE:
        return bytes([int(piece.piece[1:-1], 16)])
    if piece.type == CONTROL:
        return b""
    return (UNKNOWN_TEXT if piece.type == UNKNOWN else piece.piece.replace(SPACE, " ")).encode()


def _space_run(model: Model, ids: dict, order: dict, proto) -> int:
    """The longest piece of spaces alone, if a long run of spaces starts with such pieces.

    That holds where these pieces share the last rank, which makes them join from the left
    after everything else, no other piece ends or goes on with a space, and a run of that
    length becomes one piece.
    """
    runs = {p for p in ids if len(p) > 1 and set(p) == {SPACE}}
    others = [p for p in ids if len(p) > 1 and p not in runs]
    last = max(order.values())
    if not runs or any(SPACE in p[1:] for p in others) or any(order[proto.pieces[ids[p]].score] == last for p in others):
        return 0
    if any(order[proto.pieces[ids[p]].score] != last for p in runs):
        return 0
    longest = max(map(len, runs))
    alone = merge(model, np.array([ord(SPACE)] * longest, np.uint32), np.zeros(longest, np.int64))[0]
    return longest if len(alone) == 1 else 0


def _rank(model: Model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, merged piece) of pairs of symbols; NEVER where no piece is made of them."""
    key = left.astype(np.int64) * model.n_symbols + right
    at = np.minimum(np.searchsorted(model.pairs, key), len(model.pairs) - 1)
    known = (model.pairs[at] == key) & (left >= 0) & (right >= 0)
    return np.where(known, model.ranks[at], NEVER), model.merged[at]


def merge(model: Model, points: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their word) of words given as code points; `word` ascends from 0 without a gap.

    Merging all places of a pair at once equals merging them one by one from the left, unless
    a merge makes a pair that comes before the next place: one of equal or better rank. Words
    where that happens only merge their first place in that round.
    """
    sym = model.symbol[model.place[points]]
    origin = np.arange(len(sym))
    rank, piece = _next_pairs(model, sym, word, np.arange(len(sym)))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[first, len(word)])
        best = np.minimum.reduceat(rank, first)
        if (best == NEVER).any():
            leave = np.repeat(best == NEVER, sizes)
            done.append((word[leave], sym[leave], origin[leave]))
            sym, word, origin, rank, piece = (x[~leave] for x in (sym, word, origin, rank, piece))
            continue
        lead = np.repeat(best, sizes)
        hit = rank == lead
        where = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], where, 0))
        chosen = np.flatnonzero(hit & ((where - run) % 2 == 0))
        chosen = chosen[_unhurried(model, sym, word, piece, lead, chosen)]

        sym[chosen] = piece[chosen]
        keep = np.ones(len(sym), bool)
        keep[chosen + 1] = False
        moved = np.cumsum(keep) - 1
        sym, word, origin, rank, piece = (x[keep] for x in (sym, word, origin, rank, piece))
        at = moved[chosen]
        changed = np.unique(np.r_[at, np.maximum(at - 1, 0)])
        rank[changed], piece[changed] = _next_pairs(model, sym, word, changed)
    if not done:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    words, syms, origins = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(origins)
    return _spell(model, syms[order], words[order], points[origins[order]])


def _next_pairs(model: Model, sym, word, at):
    """(rank, piece) of the pairs that begin at the given places."""
    after = np.minimum(at + 1, len(sym) - 1)
    rank, piece = _rank(model, sym[at], sym[after])
    same = (at + 1 < len(sym)) & (word[at] == word[after])
    return np.where(same, rank, NEVER), piece


def _unhurried(model: Model, sym, word, piece, lead, chosen) -> np.ndarray:
    """Which of the chosen places may be merged in this round."""
    group = word[chosen]
    first = np.r_[True, group[1:] != group[:-1]]
    several = ~first | ~np.r_[first[1:], True]
    if not several.any():
        return np.ones(len(chosen), bool)
    at = chosen[several]
    new, n = piece[at], len(sym)
    after = np.minimum(at + 2, n - 1)
    follows = _rank(model, new, sym[after])[0]
    hurried = (at + 2 < n) & (word[after] == word[at]) & (follows <= lead[at])
    # the symbol in front, merged already if it was the second half of the place before
    before = np.maximum(at - 1, 0)
    front = sym[before].copy()
    joined = np.r_[False, at[1:] == at[:-1] + 2]
    front[joined] = new[np.flatnonzero(joined) - 1]
    leads = _rank(model, front, new)[0]
    hurried |= (at > 0) & (word[before] == word[at]) & (leads <= lead[at])
    stop = np.isin(group, np.unique(word[at[hurried]]))
    return first | ~stop


def _spell(model: Model, sym, word, points) -> tuple[np.ndarray, np.ndarray]:
    """Symbols as ids: characters that are no piece become the pieces of their bytes."""
    odd = np.flatnonzero((sym < 0) | (sym >= model.n_pieces))
    if not len(odd):
        return sym, word
    spelt = [np.frombuffer(chr(p).encode(), np.uint8) for p in points[odd].tolist()]
    times = np.ones(len(sym), np.int64)
    times[odd] = [len(b) for b in spelt]
    ids, words = np.repeat(sym, times), np.repeat(word, times)
    ids[np.repeat(np.isin(np.arange(len(sym)), odd), times)] = model.byte_ids[np.concatenate(spelt)]
    return ids, words


def _cuts(model: Model, points: np.ndarray) -> np.ndarray:
    """Places where a word starts."""
    place = model.place[points]
    cut = np.r_[True, ~model.meet[place[:-1], place[1:]]]
    if model.space_run and len(points) > model.space_run:
        space = points == ord(SPACE)
        begins = np.flatnonzero(space & ~np.r_[False, space[:-1]])
        ends = np.flatnonzero(space & ~np.r_[space[1:], False]) + 1
        for a, b in zip(begins.tolist(), ends.tolist()) if (ends - begins > model.space_run).any() else ():
            cut[a + model.space_run : a + (b - a - 1) // model.space_run * model.space_run + 1 : model.space_run] = True
    return np.flatnonzero(cut)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _slices(model: Model, text: str):
    """A text with spaces as the vocabulary spells them, in slices of about BLOCK characters."""
    if not text:
        return
    text, at = SPACE + text.replace(" ", SPACE), 0
    while len(text) - at > BLOCK:
        size = BLOCK
        while True:
            part = _points(text[at : at + size])
            place = model.place[part]
            ends = np.flatnonzero(~model.meet[place[:-1], place[1:]])
            if len(ends) or at + size >= len(text):
                break
            size *= 2
        to = at + (int(ends[-1]) + 1 if len(ends) else len(part))
        yield text[at:to]
        at = to
    if at < len(text):
        yield text[at:]


def _block(model: Model, parts: list[str]) -> list[np.ndarray]:
    """The ids of each part; equal words are merged once."""
    numbers: dict[str, int] = {}
    listed, counts = [], []
    for part in parts:
        cut = _cuts(model, _points(part)).tolist()
        cut.append(len(part))
        listed.extend([numbers.setdefault(part[a:b], len(numbers)) for a, b in zip(cut, cut[1:])])
        counts.append(len(cut) - 1)
    lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
    points = _points("".join(numbers))
    ids, word = merge(model, points, np.repeat(np.arange(len(numbers)), lengths))
    sizes = np.bincount(word, minlength=len(numbers))
    begins = np.cumsum(sizes) - sizes
    flat = np.array(listed, np.int64)
    size = sizes[flat]
    ends = np.cumsum(size)
    gathered = ids[np.repeat(begins[flat] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    borders = np.r_[0, ends][np.cumsum(counts)]
    return np.split(gathered, borders[:-1])


def encode_all(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text with the begin and end ids, as unsigned 32-bit integers."""
    model = load(path)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    parts, owners, waiting = [], [], 0

    def flush():
        for owner, ids in zip(owners, _block(model, parts)):
            out[owner].append(ids)

    for i, text in enumerate(texts):
        for part in _slices(model, text):
            parts.append(part)
            owners.append(i)
            waiting += len(part)
            if waiting >= BLOCK:
                flush()
                parts, owners, waiting = [], [], 0
    if parts:
        flush()
    return [np.concatenate([[model.begin], *ids, [model.end]]).astype("<u4") for ids in out]


def _each_wrong_byte(error: UnicodeDecodeError):
    return "�" * (error.end - error.start), error.end


def decode(ids: np.ndarray, path: str) -> str:
    """The text of ids: pieces on end without the space in front; a wrong byte becomes U+FFFD.

    Bytes on both sides of a begin or end id are not read as one character.
    """
    codecs.register_error("each_wrong_byte", _each_wrong_byte)
    model = load(path)
    ids = ids.astype(np.int64)
    silent = model.silent[ids]
    run = np.cumsum(silent)[~silent]
    ids = ids[~silent]
    if not len(ids):
        return ""
    size = model.starts[ids + 1] - model.starts[ids]
    ends = np.cumsum(size)
    flat = model.decoded[np.repeat(model.starts[ids] - ends + size, size) + np.arange(ends[-1])]
    borders = [int(model.led[ids[0]]), *ends[:-1][run[1:] != run[:-1]].tolist(), len(flat)]
    return "".join(flat[a:b].tobytes().decode("utf-8", "each_wrong_byte") for a, b in zip(borders, borders[1:]))


def encode_texts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its key, its number of ids and the ids as little-endian unsigned 32-bit integers.

    The ids are those of the sentencepiece library with begin and end ids and without sampling,
    for the model file at the path `model` on every machine. There is no shuffle: a task encodes
    its own rows, in blocks of 2^21 characters, and long texts in slices.

    Null and empty texts have the begin and end id alone. Null and repeated keys are allowed,
    each row is encoded; an empty table gives no rows; extra columns are ignored.
    """

    def run(batches):
        for b in batches:
            ids = encode_all([t or "" for t in b.column(1).to_pylist()], model)
            columns = [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def decode_texts(encoded: DataFrame, model: str) -> DataFrame:
    """The encoded rows (`encode_texts`) with their text, `decoded`; null ids give a null text."""

    def run(batches):
        for b in batches:
            texts = [None if x is None else decode(np.frombuffer(x, "<u4"), model) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, SCHEMA + ", decoded string")
