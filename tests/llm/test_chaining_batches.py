"""Alignment and chaining of many stretches at once, against one at a time."""

import numpy as np

from quire.llm import chaining
from tests.llm.cases import docs


def test_extensions_are_those_of_single_stretches():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 3, 4000), r.integers(0, 3, 4000)
    b[500:2500] = a[500:2500]
    b[r.integers(500, 2500, 60)] = 9
    at = np.concatenate([r.integers(0, 4000, 300), np.full(20, 500), np.full(20, 2499)])
    for way in (1, -1):
        m = np.minimum(4000 - at if way == 1 else at + 1, r.integers(0, 2500, len(at)))
        got = zip(*(v.tolist() for v in chaining.extensions(a, at, b, at, m, way)))
        for x, n, found in zip(at, m, got):
            if way == 1:
                one = chaining.extension(a[x : x + n], b[x : x + n])
            else:
                one = chaining.extension(a[x - n + 1 : x + 1][::-1], b[x - n + 1 : x + 1][::-1])
            assert found == one


def test_texts_that_end_are_not_aligned_again():
    a, b = np.arange(60), np.concatenate([np.arange(100, 160), np.arange(60)])
    chain = [0], [60], [57]
    # the first text really ends at both ends, so words before and after the second one's change nothing
    assert chaining.accepted(*chain, a, b, 40, 0.8, (False, True, False, True)) == ([(0, 60, 60, 60, 60)], False)
    assert chaining.accepted(*chain, a, b, 40, 0.8, (True, True, True, True))[1]


def test_seeds_meet_their_first_document_over_batches(spark):
    rows = [(seed, doc, pos) for seed in range(4) for doc in range(seed * 40 + 1) for pos in (7, 3)]
    found = spark.createDataFrame(rows, "seed long, doc_id long, pos int")
    rule = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = chaining.with_first(found).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rule)
    assert sorted((x.seed, x.doc_id, x.pos, x.source_id, x.source_pos) for x in got) == sorted((s, d, p, 0, 3) for s, d, p in rows if s)


def test_one_table_of_seeds_is_dealt_once(spark):
    plan = chaining.with_first(chaining.seeds(docs(spark, ["a b c d e f g"]), 5, 6))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lists_of_documents_over_batches(spark):
    rows = [(doc, pos, 7 * pos, 0, pos) for doc in range(9) for pos in range(5 * doc + 1) for _ in range(2)]
    found = spark.createDataFrame(rows, "doc_id long, pos int, seed long, source_id long, source_pos int")
    rule = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {x.doc_id: (x.pos, x.seed) for x in chaining.of_documents(found).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rule)
    assert got == {d: (list(range(5 * d + 1)), list(range(0, 35 * d + 1, 7))) for d in range(9)}


def test_whole_texts_are_aligned_in_small_batches(spark, monkeypatch):
    sizes, write = {}, chaining.written

    def noted(df, name, batch_rows=None):
        sizes[name] = batch_rows
        return write(df, name, batch_rows)

    monkeypatch.setattr(chaining, "written", noted)
    text = " ".join(f"w{k}" for k in range(80))
    assert [tuple(x)[:4] for x in chaining.passages(docs(spark, [text, text])).collect()] == [(1, 0, 0, 80)]
    # both texts of a row have up to their 20,000 words of eight bytes
    assert sizes["whole"] * 2 * 20_000 * 8 <= 12 << 20
