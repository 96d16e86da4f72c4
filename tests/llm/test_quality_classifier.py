import zlib

import numpy as np
import pyarrow as pa

from docaudit.llm import quality_classifier as qc


def test_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    machine = qc.Machine()
    machine.bias, machine.linear = 0.3, rng.normal(size=machine.linear.shape)
    machine.vectors = rng.normal(size=machine.vectors.shape)
    rows, cells, values = np.repeat([0, 1], 6), rng.integers(0, 1000, 12), rng.normal(size=12)
    got, _ = machine.raw(rows, cells, values, 2)
    for r in (0, 1):
        c, v = cells[rows == r], values[rows == r]
        want = 0.3 + machine.linear[c] @ v
        want += sum(machine.vectors[c[i]] @ machine.vectors[c[j]] * v[i] * v[j] for i in range(6) for j in range(i))
        assert np.isclose(got[r], want)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = qc.score(docs, qc.train(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    test = got[got.held_out]
    assert (test.predicted == test.quality).mean() > 0.95 and test.score.between(0, 1).all()


def test_odd_rows(odd, none, spark, odd_rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 0), (8, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        machine = qc.train(odd, known)
        got = qc.score(odd, machine).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert len({r.score for r in got if r.doc_id == 15}) == 1
    assert qc.score(none, machine).count() == 0


def test_features_of_a_batch_equal_those_alone():
    texts = ["One two two.\nTHREE 4!", None, "", "one two two", "é ü"]
    n = np.array([5.0, 0, 0, 3, 3])
    row, cell, value, dense = qc.features(pa.array(texts), n)
    for i, t in enumerate(texts):
        _, c, v, d = qc.features(pa.array([t], pa.string()), n[i : i + 1])
        assert np.allclose(dense[i], d[0]) and cell[row == i].tolist() == c.tolist() and np.allclose(value[row == i], v)
