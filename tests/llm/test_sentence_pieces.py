import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from docaudit.llm import sentence_pieces

PATH = sentence_pieces.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(texts):
    for text, ids in zip(texts, sentence_pieces.encode_all(texts, PATH)):
        want = LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, text[:100]
        assert sentence_pieces.decode(ids, PATH) == LIBRARY.decode(want)


def test_chosen_texts():
    same([
        "", " ", "  ", "   a", "a ", "▁", "a▁▁b ▁", "\x00", "\n\n \t", "a" * 5000, "=" * 100, "ab" * 500, "日本語 テキスト", "🙂🙃",
        "é́", "<s></s><unk><0x0A>", "includegraphics" * 3, "x" * 15 + " " * 15 + "y", *(" " * n + "w" for n in range(14, 68)),
        " " * 1000 + "word" + " " * 333,
    ])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet=" ▁e\nthainos=-0é日", max_size=80), max_size=5))
def test_any_texts(texts):
    same([t.encode("utf-8", "ignore").decode() for t in texts])


def test_pieces_on_end():
    """Texts made of pieces hold pairs that compete with one another."""
    rng = random.Random(2)
    pieces = [LIBRARY.id_to_piece(i) for i in range(300, 32000)]
    same(["".join(rng.choices(pieces, k=25)).replace("▁", rng.choice([" ", ""])) for _ in range(1500)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 300), max_size=12))
def test_decodes_any_ids(ids):
    assert sentence_pieces.decode(np.array(ids, "<u4"), PATH) == LIBRARY.decode(ids)


def test_slices_do_not_show(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("etaoin  shrdlu\n日ab=", k=3000)), " " * 700, "x" * 900, "ab " * 400]
    monkeypatch.setattr(sentence_pieces, "BLOCK", 64)
    same(texts)


def test_equal_ranks_join_from_the_left():
    """Where a merge makes a pair as good as the next place, places are merged one by one."""
    model = sentence_pieces.load(PATH)
    for n in range(1, 60):
        ids, _ = sentence_pieces.merge(model, np.full(n, ord("▁"), np.uint32), np.zeros(n, np.int64))
        want = [i for i in LIBRARY.encode("a" + " " * n)][1:] if n else []
        assert ids.tolist() == want


def test_odd_rows(odd, odd_rows, none):
    encoded = sentence_pieces.encode_texts(odd, PATH)
    got = sentence_pieces.decode_texts(encoded, PATH).collect()
    want = []
    for key, text, *_ in odd_rows:
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        want.append((key, len(ids), np.array(ids, "<u4").tobytes(), LIBRARY.decode(ids)))
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got), key=order) == sorted(want, key=order)
    assert sentence_pieces.decode_texts(sentence_pieces.encode_texts(none, PATH), PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(PATH, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    other = tmp_path / "other.model"
    other.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        sentence_pieces.load(str(other))
