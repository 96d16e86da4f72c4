import math
import re
import zlib
from collections import Counter

import numpy as np

from docaudit.llm import language_model as lm


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def test_base_against_brute_force_and_both_ways(odd, odd_rows, none):
    got = lm.score_texts(odd).collect()
    joined = lm.score_texts(odd, frequent=1).collect()
    some = lm.score_texts(odd, frequent=20).collect()
    held = lambda key: key is not None and zlib.crc32(str(key).encode()) % 5 == 1
    c = Counter(w for k, t, *_ in odd_rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for key, text, *_ in odd_rows:
        w = tokens(text)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((str(key), held(key), len(w), sum(c[x] > 0 for x in w), n, round(base, 4)))
    for rows in (got, joined, some):
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == sorted(want)
    a, b = (sorted((str(r.doc_id), r.n_tokens, r.score) for r in rows) for rows in (got, joined))
    assert all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 * abs(x[2]) + 1e-9 for x, y in zip(a, b))
    assert lm.score_texts(none).count() == 0


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    model = lm.Model(rng.integers(0, 50, lm.CLASSES + 1).astype(float), seed)
    model.move = rng.dirichlet(np.ones(lm.STATES), lm.STATES)
    model.start = rng.dirichlet(np.ones(lm.STATES), 2)
    return model


def forward(model, seq):
    p = model.start[0] * model.emit[:, seq[0]]
    log = 0.0
    for o in seq[1:]:
        log, p = log + math.log10(p.sum()), (p / p.sum()) @ model.move * model.emit[:, o]
    return log + math.log10(p.sum())


def test_forward_recursion_is_exact(monkeypatch):
    model, rng = small_model(), np.random.default_rng(1)
    seqs = [rng.integers(0, lm.CLASSES + 1, n).astype(np.uint16) for n in (1, 2, 7, 300, 40, 3)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    want = [forward(model, s) for s in seqs]
    assert np.allclose(model.log10(np.concatenate(seqs), bounds), want)
    monkeypatch.setattr(lm, "LONG_TEXT", 2)
    assert np.allclose(model.log10(np.concatenate(seqs), bounds), want)


def test_probabilities_of_all_short_texts_add_up(monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 3)
    model = lm.Model(np.array([5.0, 1.0, 2.0, 4.0]), 2)
    pairs = np.array([[a, b] for a in range(4) for b in range(4)], np.uint16)
    assert np.isclose((10 ** model.log10(pairs.ravel(), np.arange(0, 33, 2))).sum(), 1.0)


def test_baum_welch_never_lowers_the_likelihood(monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 20)
    rng = np.random.default_rng(4)
    seqs = [np.r_[rng.integers(0, 10, 30) + 10 * (i % 2), 20].astype(np.uint16) for i in range(40)]
    flat, bounds = np.concatenate(seqs), np.arange(0, 40 * 31 + 1, 31)
    model, seen = lm.Model(np.bincount(flat, minlength=21).astype(float)), []
    for _ in range(8):
        model.learn(sum(model.expect(*part) for part in lm._segments(flat, bounds)))
        seen.append(model.log10(flat, bounds).sum())
    assert all(b > a - 1.0 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0] + 5


def test_better_than_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score_texts(docs).filter("held_out").toPandas()
    assert len(got) > 100 and got.score.sum() > got.base_score.sum() + 0.02 * abs(got.base_score.sum())
