"""Stretches, segments' hashes and merged spans of many texts at once."""

import random

import numpy as np
import pyarrow as pa

from quire.llm import suffixes


def test_stretches_of_texts_at_once_are_those_of_each():
    r = random.Random(5)
    texts = [bytes(r.choice(b"ab") for _ in range(n)) for n in (0, 49, 50, 51, 300, 0, 7, 50, 120)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = [v.tolist() for v in suffixes.stretches(np.frombuffer(b"".join(texts), np.uint8), at)]
    alone = []
    for k, t in enumerate(texts):
        least, start, n, _ = suffixes.stretches(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert int(n.sum()) == max(0, len(t) - 49)
        alone += [(m, s + int(at[k]), c, k) for m, s, c in zip(least.tolist(), start.tolist(), n.tolist())]
    assert list(zip(*found)) == alone


def test_digests_differ_with_place_and_length():
    raw = np.frombuffer(b"x" * 60 + b"abcdefgh" * 9 + b"x" * 60 + b"hgfedcba" * 9, np.uint8)
    same = suffixes.digests(raw, np.array([0, 132, 0, 3, 60]), np.array([50, 50, 51, 50, 50]))
    assert same[0] == same[1] == same[3] and len(set(same.tolist())) == 3


def test_spans_of_rows_are_merged_apart():
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    spans = [[(5, 3), (0, 5), (20, 2)], None, [], [(0, 50), (4, 2), (50, 1), (52, 1)]]
    column = pa.array([s and [{"start": a, "length": n} for a, n in s] for s in spans], kind)
    a, b, of = suffixes.merged(column)
    got = [list(zip(a[i:j].tolist(), b[i:j].tolist())) for i, j in zip(of, of[1:])]
    assert got == [[(0, 8), (20, 22)], [], [], [(0, 51), (52, 53)]]


def test_repeated_minimizers_are_found_across_batches():
    r = random.Random(6)
    rows = sorted(((r.randint(0, 30), r.choice([1, 1, 1, 2, 3])) for _ in range(90)), key=lambda x: x[0])
    docs_of = {}
    for m, d in rows:
        docs_of.setdefault(m, set()).add(d)
    want = {(m, d) for m, d in rows if len(docs_of[m]) > 1}
    for size in (1, 2, 7, 90):
        batches = [pa.RecordBatch.from_arrays([pa.array([m for m, _ in rows[k : k + size]], pa.int64()), pa.array([d for _, d in rows[k : k + size]], pa.int64())], ["minimizer", "doc_id"]) for k in range(0, 90, size)]
        got = {tuple(x.values()) for b in suffixes.repeated(iter([*batches, batches[0].slice(0, 0)])) for x in b.to_pylist()}
        assert got == want


def test_minimizers_with_one_segment_are_left_out_of_shards(spark):
    rows = [(m, h, h, bytes([65 + h]) * 60) for m in range(40) for h in range(1 + m % 3)]
    df = spark.createDataFrame(rows, "minimizer long, segment_hash long, owner long, segment binary")
    got = suffixes.resolved(df, 50)
    assert sorted(tuple(r) for r in got.collect()) == [(m, h, h, [], []) for m, h, *_ in rows]
    same = spark.createDataFrame([(1, 5, 3, b"x" * 30 + b"ab" * 30), (1, 6, 2, b"ab" * 40)], df.schema)
    assert [tuple(r) for r in suffixes.resolved(same, 50).sort("owner").collect()] == [(1, 6, 2, [], []), (1, 5, 3, [30], [11])]


def test_segments_meet_their_owners_in_one_join(spark, monkeypatch):
    """Whole and partial runs come from one join, and distinct segments are found by halves of the minimizers."""
    names, joins, keep = [], [], suffixes.written

    def written(df, name, *rest):
        names.append(name)
        if name == "spans":
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner"))
        return keep(df, name, *rest)

    monkeypatch.setattr(suffixes, "written", written)
    text = "".join(chr(97 + k * k % 23) for k in range(200))
    df = spark.createDataFrame([(1, text), (2, "?" + text), (3, text)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.deduplicated(df).collect()}
    assert got == {1: (0, 0), 2: (200, 1), 3: (200, 1)}
    assert names.count("distinct") == 2 and joins == [1]
