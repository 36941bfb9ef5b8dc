from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hard_negatives as h
from tests.llm.cases import clashing
from tests.llm.test_vectors import SCHEMA


def vectors(spark, n=900, dim=12, seed=2):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, dim))
    label = r.integers(0, 5, n)
    label[n // 2 :] = 3  # a label that most rows have
    data = (centres[label] + 0.9 * r.standard_normal((n, dim))).astype(np.float32)
    data[60:80] = data[60]  # ties
    rows = [(k, v.tolist(), int(x)) for k, (v, x) in enumerate(zip(data, label))]
    rows += [rows[20], rows[20], rows[200], (100, rows[3][1], 1), (100, rows[100][1], 4), (300, [0.0] * dim, 2)]
    rows += [(None, rows[0][1], 1), (n, None, 1), (n + 100, [], 1), (n + 200, [float("nan")] * dim, 1), (n + 300, [None] + [1.0] * (dim - 1), 1), (n + 400, rows[1][1], None), (n + 500, [1.0, 2.0], 1), (n + 1, [1.0, 2.5], 1), (n + 2, [1.0, 0.5], 2)]
    rows += [(k, (-data[k % 50]).tolist(), 9) for k in range(1000, 1110)]  # positives below zero
    return spark.createDataFrame(rows, SCHEMA)


def brute(df, every, n_pos=5, n_neg=10):
    rows = [(r.vec_id, [int(np.floor(256 * x)) for x in r.embedding], r.label) for r in df.collect() if r.vec_id is not None and r.label is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]
    out, done = [], set()
    for n, (a, v, label) in enumerate(rows):
        if a % every or (a, tuple(v), label) in done:
            continue
        done.add((a, tuple(v), label))
        scored = sorted((-int(np.dot(np.array(v, dtype=object), np.array(w, dtype=object))), i, x) for m, (i, w, x) in enumerate(rows) if m != n and len(w) == len(v))
        for s, i, _ in [x for x in scored if x[2] == label][:n_pos]:
            inside = [(-t, j) for t, j, x in scored if x != label and 30 * -s <= 100 * -t <= 90 * -s][:n_neg]
            out += [(a, i, k + 1, j, -s, t) for k, (t, j) in enumerate(inside)]
    return Counter(out)


@pytest.mark.parametrize("rows", [16384, 100])
def test_equals_brute_force(spark, rows):
    df = vectors(spark)
    got = h.hard_negatives(clashing(df, "score", "rank", "key", "times", "bucket"), F.col("vec_id") % 20 == 0, block_rows=rows, sample_rows=200)
    want = brute(df, 20)
    assert len(want) > 500 and Counter(map(tuple, got.collect())) == want


def test_large_values(spark):
    df = spark.createDataFrame([(k, [float(1 << 18) * (k % 7 + 1), 3.5, (2.0**15) * k], k % 3) for k in range(120)], SCHEMA)
    assert Counter(map(tuple, h.hard_negatives(df, F.col("vec_id") % 20 == 0).collect())) == brute(df, 20)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert h.hard_negatives(df, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0], 1)], SCHEMA)
    assert h.hard_negatives(one, F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold_and_leave_rows_out():
    r = np.random.default_rng(4)
    data = np.floor(256 * (r.standard_normal((8, 32))[r.integers(0, 8, 3000)] + 0.1 * r.standard_normal((3000, 32))))
    book = h.ProductQuantiser(data[:500])
    low, high = book.bounds(data[:20], *book.encode(data))
    true = data[:20] @ data.T
    assert (low <= true).all() and (true <= high).all()
    assert np.mean([(high[q] >= h.kth(low[q], 5)).mean() for q in range(20)]) < 0.3
