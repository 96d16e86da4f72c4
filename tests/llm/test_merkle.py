import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docaudit.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    key, _, lang, source, n = row
    return h(*map(enc, (key, source, lang, n, text)))


def tree(nodes):
    """(root, per leaf its (digit, others) from the lowest level up)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for path, i in zip(paths, at):
            path.append((i % 8, [x for j, x in enumerate(runs[i // 8]) if j != i % 8]))
        at = [i // 8 for i in at]
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def fold(node, path):
    for digit, others in path:
        node = h(*others[:digit], node, *others[digit:])
    return node


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for x in langs}
    trees = {x: tree([leaf(r, r[1]) for r in members[x]]) for x in langs}
    root, top = tree([trees[x][0] for x in langs])
    out = []
    for x, above in zip(langs, top):
        for row, path in zip(members[x], trees[x][1]):
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            siblings = h(*[s for _, others in path + above for s in others])
            folded = fold(leaf(row, text), path + above)
            out.append((row[0], leaf(row, row[1]), trees[x][0], root, siblings, folded, folded == root))
    return sorted(out, key=str)


def verified(docs):
    return sorted(map(tuple, merkle.verify_documents(docs).collect()), key=str)


def test_odd_rows(odd, odd_rows, none):
    assert verified(odd) == brute(odd_rows)
    assert verified(none) == []


@pytest.mark.parametrize("rows", [
    [(1, "ABC", "en", "a", 3)],
    [(i, f"T{i}", None, None, None) for i in range(8)],
    [(i, f"T{i}", "en", "a", i) for i in range(9)],
    [(i, "Same", f"l{i}", "a", 0) for i in range(70)],
    [(i if i % 3 else None, "Same É", "en" if i % 3 else "é", "a", 0) for i in range(600)] + [(4, None, "zz", "a", 1)],
], ids=["one", "full run", "run of one", "many groups", "repeated"])
def test_any_shape(spark, rows):
    rows = list(rows)
    random.Random(1).shuffle(rows)
    assert verified(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_shelves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SHELF_BITS", 2)
    rows = [(None, "Same", "en", None, 0)] * 300 + [(i, f"T{i}", "de", "a", i) for i in range(90)]
    assert verified(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_some_leaves_are_requested(spark):
    rows = [(i, f"T{i}", "en" if i % 4 else "de", "a", i) for i in range(400)]
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    asked = [("en", 0, "x"), ("en", 299, "y"), ("de", 64, "z"), ("de", 64, "again"), ("de", 100, "not there"), ("fr", 0, "no")]
    got = merkle.prove(made, spark.createDataFrame(asked, "group string, rank long, note string"))
    got = got.withColumn("folded", merkle.fold(F.col("found"), F.col("proof"))).collect()
    assert sorted(r.note for r in got) == ["again", "x", "y", "z"]
    members = {g: [r for r in rows if r[2] == g] for g in ("en", "de")}
    for r in got:
        row = members[r.group][r.rank]
        assert r.found == leaf(row, row[1]) and r.folded == r.root
