"""The pipeline's stages decide by row: null and repeated keys neither keep nor lose a row."""

import random
from collections import Counter

import pytest

from docaudit.llm import exact_dedup, jaccard_join, mixing, quality_rules, substring_dedup
from docaudit.session import settled

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijk", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(params=["files", "rows"])
def table(request, spark, tmp_path):
    """A table of files, which are read as they are, or other rows, which are written first."""

    def made(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        if request.param == "rows":
            return df
        df.repartition(3).write.parquet(str(tmp_path / "docs"))
        return spark.read.parquet(str(tmp_path / "docs"))

    return made


def test_rejected_rows_go_with_null_and_repeated_keys(table):
    rng = random.Random(1)
    good, bad = [prose(rng, 80) for _ in range(3)], ["too short", "also short", None]
    rows = [(k, t, "en", "a") for k in (None, 7) for t in good + bad]
    got = quality_rules.without_rejected(table(rows)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((k, t) for k in (None, 7) for t in good)


def test_one_copy_of_each_class_stays(table):
    rows = [(None, "A b c", "en", "a"), (None, "a B c", "en", "b"), (5, "x y", "en", "a"), (5, "X y", "en", "a"), (5, "x y", "en", "a"),
            (None, "x y", "en", "a"), (5, "other", "en", "a"), (3, "a", None, None), (None, "A", None, None), (None, None, "en", "a"), (None, "", "en", "a")]
    got = exact_dedup.without_copies(table(rows)).collect()
    assert sorted((r.text or "").lower() for r in got) == ["", "a", "a b c", "other", "x y"]
    assert {r.text: r.doc_id for r in got}["a"] == 3 and [r.doc_id for r in got if r.text and r.text.lower() == "x y"] == [5]


def test_one_row_of_each_component_stays(table):
    rng = random.Random(2)
    base, other, alone = prose(rng, 100), prose(rng, 100), prose(rng, 100)
    near = lambda t: t + " more"
    rows = [(None, near(base)), (1, base), (9, near(base)), (None, other), (None, near(other)), (1, near(other)), (1, alone), (None, near(alone)), (None, alone)]
    got = jaccard_join.one_of_each(table([(k, t, "en", "a") for k, t in rows])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, base), (1, near(other)), (1, alone)])


def test_null_keyed_copies_leave_one(table):
    rng = random.Random(5)
    base = prose(rng, 100)
    got = jaccard_join.one_of_each(table([(None, base + " x" * (i % 2), "en", "a") for i in range(6)] + [(None, None, "en", "a")])).collect()
    assert len(got) == 2 and sum(r.text is None for r in got) == 1


def test_each_row_is_taken_as_often_as_it_is_drawn(table):
    rng = random.Random(3)
    rows = [(None if i % 2 else i % 4, prose(rng, 20), "en", "b") for i in range(200)] + [(None, prose(rng, 20), "en", "a") for _ in range(20)]
    docs = table(rows)
    times = mixing.mix_sources(docs).toPandas()
    mixed = mixing.mixture(docs)
    taken = Counter(r.source for r in mixed.collect())
    assert mixed.columns == docs.columns
    assert taken == Counter(times.groupby("source").times.sum().to_dict())
    # a row of an undrawn half never rides on a drawn one of the same key
    assert taken["b"] < 200


def test_repeats_are_cut_from_their_own_row(table):
    rng = random.Random(6)
    line = "This very line stands in more than one document of the table."
    texts = [prose(rng, 60), prose(rng, 60) + "\n" + line + "\nend", line + "\n" + prose(rng, 60), prose(rng, 60)]
    rows = [(None, texts[0], "en", "a"), (None, texts[1], "en", "a"), (7, texts[2], "en", "a"), (7, texts[3], "en", "a")]
    got = {r.text: r.removed for r in substring_dedup.without_repeats(table(rows)).collect()}
    cut = texts[1].replace(line, "")
    assert set(got) == {texts[0], cut, texts[2], texts[3]}
    assert [k for k, v in got.items() if v] == [cut]


def test_blocks_are_bounded_whatever_the_keys(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(mixing, "settled", lambda df, label: _noted(df, label, sizes))
    rows = spark.range(5000).selectExpr("cast(null as bigint) as doc_id", "concat('some words ', id) as text", "'en' as lang", "if(id % 5 = 0, 'b', 'a') as source")
    got = mixing.mix_sources(rows)
    assert got.count() == 5000 and max(sizes) <= mixing.BLOCK_ROWS
    for r in got.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 10


def _noted(df, label, sizes):
    made = settled(df, label)
    if label == "flown":
        sizes.append(made.groupBy("seed", "block").count().agg({"count": "max"}).first()[0])
    return made
