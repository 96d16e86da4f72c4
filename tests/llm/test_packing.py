from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docaudit.llm import packing

PATH = packing.default_tokenizer()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_every_id_lies_in_one_piece(odd, odd_rows, tokenizer, monkeypatch):
    got = packing.pack_documents(odd, PATH).collect()
    texts = [(k, ids_of(tokenizer, t)) for k, t, *_ in odd_rows]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for key in {k for k, _ in texts}:
        want = sorted(x for k, ids in texts if k == key for x in ids)
        assert sorted(x for r in pieces[key] for x in np.frombuffer(r.ids, "<u4").tolist()) == want
    for key, ids in texts:
        if sum(k == key for k, _ in texts) == 1:
            assert [x for r in sorted(pieces[key], key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
            assert all(r.doc_tokens == len(ids) for r in pieces[key])
    for places in sequences.values():
        places.sort()
        ends = [o + n for o, n in places]
        assert [o for o, _ in places] == [0, *ends[:-1]]
        assert ends[-1] == packing.CAPACITY or ends[-1] & (ends[-1] - 1) == 0


def test_empty_table(none):
    assert packing.pack_documents(none, PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\tab'sé1.  ", max_size=60))
def test_encoder_agrees_with_the_tokenizer(text):
    text = text.encode("utf-8", "ignore").decode()
    assert packing.encode(text, PATH).tolist() == ids_of(_shared(), text)


_made = []


def _shared():
    if not _made:
        _made.append(Tokenizer.from_file(PATH))
    return _made[0]


def test_slices_do_not_change_ids(tokenizer, monkeypatch):
    text = "Some words, it's 12 more  words\n and " * 200
    want = ids_of(tokenizer, text)
    monkeypatch.setattr(packing, "SLICE", 50)
    assert packing.encode(text, PATH).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_assignment_fills_every_sequence(lengths):
    places = packing.assign(lengths, 64)
    taken, filled = defaultdict(list), defaultdict(int)
    for item, start, n, to, offset in places:
        assert n > 0
        taken[item].append((start, n))
        filled[to] += n
    for i, n in enumerate(lengths):
        spans = sorted(taken[i])
        assert [s for s, _ in spans] == list(np.cumsum([0] + [m for _, m in spans])[:-1]) and sum(m for _, m in spans) == n
    assert all(n == 64 or n & (n - 1) == 0 for n in filled.values())
    assert len(filled) <= sum(lengths) // 64 + 6


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = rng.integers(20, 400, 600).tolist()
    cost = defaultdict(float)
    for _, _, n, to, _ in packing.assign(lengths, 2048):
        cost[to] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = sorted(cost.values())[-(sum(lengths) // 2048) :]
    assert max(full) / min(full) < 1.35
