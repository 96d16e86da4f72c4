import random
import re
from collections import Counter

import numpy as np

from docaudit.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(odd, odd_rows):
    got = q.judge(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = []
    for key, text, *_ in odd_rows:
        n = counts(text)
        want.append((key, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, (r[:-1] for r in rows))) == sorted(map(repr, want))
    assert all(not r[-1] for r in rows if r[-2])


def test_empty_table(none):
    assert q.judge(none).count() == 0 and q.without_rejected(none).columns == none.columns


def clean(rng, n=120):
    return " ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 9))) for _ in range(n)).capitalize() + "."


def test_outliers_cannot_hide_behind_one_another(spark):
    rng = random.Random(1)
    rows = [(i, clean(rng), "en", "s", 1) for i in range(300)]
    # a fifth of the source is junk of one kind: plain means and covariances would follow it
    rows += [(1000 + i, " ".join(w + "***" for w in clean(rng).split()), "en", "s", 1) for i in range(70)]
    got = {r.doc_id: r.kept for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not any(got[1000 + i] for i in range(70))
    assert sum(got[i] for i in range(300)) >= 297


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(q.FEATURES))) @ rng.normal(size=(len(q.FEATURES),) * 2)
    rows = spark.createDataFrame([("l", "s", 0, i, *map(float, r)) for i, r in enumerate(x)], ["lang", "source", "level", "__key", *q.FEATURES])
    fitted = q._distance(q._joined(rows, q._estimate(rows)))
    got = np.array([r.d2 for r in fitted.orderBy("__key").collect()])
    cov = np.cov(x.T, bias=True) + np.diag(np.square(q.FLOORS))
    off = x - x.mean(0)
    assert np.allclose(got, np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off), rtol=1e-6)
