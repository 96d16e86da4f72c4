import hashlib
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from docaudit.llm import exact_dedup
from pyspark.sql import functions as F


def normal(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_classes_against_brute_force(odd, odd_rows):
    groups = defaultdict(list)
    for key, text, *_ in odd_rows:
        groups[normal(text)].append(key)
    want = []
    for key, text, *_ in odd_rows:
        keys = [k for k in groups[normal(text)] if k is not None]
        keep = max(keys, default=None)
        want.append((key, keep, len(groups[normal(text)]), key == keep, hashlib.sha256(normal(text).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(odd).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_the_kept_rows_keep_all_columns(odd, none):
    kept = exact_dedup.without_copies(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {3, 8, 15} and 1 not in {r.doc_id for r in kept.collect()}
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.without_copies(none).count() == 0


def test_chunks_give_the_text_back(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LONGEST_CHUNK", 40)
    texts = [t or "" for _, t, *_ in odd_rows] + ["x" * 40, "x" * 41, "\x00+" + "y" * 100, "\x00- z", "ab " * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    lists = [r.c for r in rows.select(exact_dedup.chunks(F.col("t")).alias("c")).collect()]

    def joined(pieces):
        out = []
        for p in pieces:
            if p.startswith(exact_dedup.NEXT):
                out[-1] += p[2:]
            else:
                out.append(p[2:] if p.startswith(exact_dedup.FIRST) else p)
        return " ".join(out)

    assert [joined(x) for x in lists] == texts
    assert max(len(p) for x in lists for p in x) <= 42


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab \x00+-", max_size=12), min_size=2, max_size=6))
def test_equal_lists_mean_equal_texts(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(rows).collect()}
    assert got == {i: max(j for j, x in enumerate(texts) if x == t) for i, t in enumerate(texts)}
