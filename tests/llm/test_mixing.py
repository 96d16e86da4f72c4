import re
from collections import Counter

import numpy as np

from docaudit.llm import mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        out = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        above = {s for s in free if out[s] > 3 * sizes[s]}
        if not above:
            return out
        capped |= above


def test_targets_and_bounds(odd, odd_rows):
    got = mixing.mix_sources(odd).collect()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in odd_rows]
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(k), n) for (k, *_), n in zip(odd_rows, words))
    sizes = Counter()
    for (_, _, _, source, _), n in zip(odd_rows, words):
        sizes[source] += n
    want = brute_targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source] for r in got)
    assert all(0 <= r.taken <= 3 * r["size"] and r.taken == r["size"] * r.times for r in got)


def test_a_large_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(n), "big" if i % 3 else f"s{i % 7}") for i, n in enumerate(rng.lognormal(3.5, 1, 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).toPandas()
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), n=("times", "sum"), size=("source_size", "first"), rows=("size", "size"))
    assert (abs(sums.taken - sums.target) <= 0.01 * sums.target + 20).all()
    assert (abs(sums.n - sums.rows * sums.target / sums["size"]) <= 3).all()
    again = mixing.mix_sources(docs.repartition(5)).toPandas()
    assert (got.sort_values("doc_id").taken.values == again.sort_values("doc_id").taken.values).all()
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns and mixed.count() == got.times.sum()


def test_the_flight_keeps_both_sums():
    rng = np.random.default_rng(0)
    for size in (rng.integers(0, 900, 300), np.full(200, 7), np.zeros(50), np.array([5, 5, 900]), np.array([3])):
        pi = rng.uniform(0.05, 0.95, len(size))
        out = mixing.fly(size, pi, rng)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert np.isclose(out.sum(), pi.sum()) and np.isclose(out @ size, pi @ size)


def test_inclusion_probabilities_hold():
    rng = np.random.default_rng(1)
    size, pi = np.array([900, 50, 40, 30, 20, 10, 5, 5]), np.linspace(0.2, 0.8, 8)
    drawn = [mixing.land(mixing.fly(size, pi, rng), rng) for _ in range(4000)]
    assert np.abs(np.mean(drawn, 0) - pi).max() < 0.04 and set(np.unique(drawn)) == {0.0, 1.0}


def test_empty_table(none):
    assert mixing.mix_sources(none).count() == 0 and mixing.mixture(none).count() == 0
