from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from quire.llm import collisions, kd_search
from tests.llm.cases import clashing

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def vectors(spark, n=600, dim=12, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, dim))
    data = (centres[r.integers(0, 6, n)] + 0.7 * r.standard_normal((n, dim))).astype(np.float32)
    data[50:60] = data[50]  # ties
    rows = [(k, v.tolist(), 0) for k, v in enumerate(data)]
    rows += [rows[20], rows[20], (100, rows[3][1], 1), (None, rows[0][1], 1), (n, None, 1), (n + 20, [], 1), (n + 40, [0.0] * dim, 1), (n + 60, [float("nan")] * dim, 1), (n + 80, [None] + [1.0] * (dim - 1), 1), (n + 100, [float("inf")] * dim, 1), (n + 120, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, SCHEMA)


def usable(df, zero):
    out = []
    for r in df.collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out.append((r.vec_id, np.array(v, dtype=np.float64)))
    return out


def brute(df, every, k, zero, measure):
    """Equal queries once; every row but the query's own."""
    of = usable(df, zero)
    out, done = [], set()
    for n, (q, v) in enumerate(of):
        if q % every or (q, v.tobytes()) in done:
            continue
        done.add((q, v.tobytes()))
        found = sorted((-measure(v, w), i) for m, (i, w) in enumerate(of) if m != n and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows", [100, 5000])
def test_exact_search(spark, rows):
    df = clashing(vectors(spark), "score", "block", "query_id")
    got = kd_search.exact_top(df, df.filter("vec_id % 50 = 0"), 5, block_rows=rows)
    want = brute(df, 50, 5, True, lambda a, b: int(np.floor(256 * a).astype(int) @ np.floor(256 * b).astype(int)))
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want


def test_exact_search_of_large_values(spark):
    df = spark.createDataFrame([(k, [float(1 << 17) * (k % 7), 3.5, -(2.0**15) * k], 0) for k in range(60)], SCHEMA)
    got = kd_search.exact_top(df, df.filter("vec_id % 50 = 0"), 5, block_rows=16)
    want = brute(df, 50, 5, True, lambda a, b: sum(int(x) * int(y) for x, y in zip(np.floor(256 * a), np.floor(256 * b))))
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want


def test_approximate_search_recall(spark, sf):
    for df, rows in ((clashing(vectors(spark), "score", "rank"), 200), (spark.read.parquet(f"{sf}/embeddings.parquet"), 5000)):
        got = collisions.nearest(df, df.filter("vec_id % 20 = 0"), 20, block_rows=rows).collect()
        want = brute(df, 20, 20, False, lambda a, b: float(a @ b))
        found, right = Counter((r.query_id, r.vec_id, round(r.score, 9)) for r in got), Counter((q, i, round(s, 9)) for q, _, i, s in want)
        assert (found & right).total() >= 0.9 * right.total()
        true = Counter((q, i, round(s, 9)) for q, _, i, s in brute(df, 20, 10**9, False, lambda a, b: float(a @ b)))
        assert not found - true
        by = defaultdict(list)
        for r in got:
            by[r.query_id, r.query_key].append(r)
        assert {q for q, _ in by} == {q for q, *_ in right}
        for mine in by.values():
            mine.sort(key=lambda r: r.rank)
            assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
            assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)


def test_no_vectors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert kd_search.exact_top(df, df, 5).count() == 0
    assert collisions.nearest(df, df, 5).count() == 0


def test_collisions_are_counted_by_windows():
    data = np.random.default_rng(3).standard_normal((700, 9))
    index = collisions.CollisionIndex(data, 40)
    query = data[5] * 0.7
    at = np.append(query, 0.0) @ index.directions
    norms = (data * data).sum(axis=1)
    values = np.hstack([data, np.sqrt(norms.max() - norms)[:, None]]) @ index.directions
    got, width = [], index.first
    while width < 2 * index.first:
        counts = index.collisions(at, width)
        # a window may be wider by its end cells, which hold three vectors at most
        exact = (np.abs(values - at) <= width).sum(axis=1)
        assert (counts >= exact).all() and counts.sum() <= exact.sum() + 2 * 3 * 40
        got.append(int((counts >= 24).sum()))
        width *= collisions.WIDER
    assert got == sorted(got)
    # the level is the first that gives enough, from whichever one the search for it begins
    wanted = got[len(got) // 2]
    found = []
    for hint in range(0, 60, 7):
        index.hint = hint
        found.append(index.candidates(query, wanted, 0.6).tolist())
    assert all(f == found[0] for f in found) and len(found[0]) == next(n for n in got if n >= wanted)


def test_a_level_is_searched_for_not_climbed_to(monkeypatch):
    data = np.random.default_rng(4).standard_normal((3000, 16))
    index = collisions.CollisionIndex(data, 64)
    counted, count = [], index.collisions
    monkeypatch.setattr(index, "collisions", lambda *a: counted.append(1) or count(*a))
    for q in data[:50]:
        index.candidates(q, 300, 0.6)
    assert len(counted) < 5 * 50
