import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import postings
from quire.sources.shared import new_path

ROWS = [(1, 1, "One", "the cat of the house"), (1, 2, None, "THE dog, the Dog; über Straße"), (2, 1, "", None), (2, 2, "x", ""), (3, 1, "cat", "cat"), (3, 2, "the", "of cat of the of"), (None, 1, "the", "cat of")]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame(ROWS, "work long, position long, subtitle string, body string")
    return postings.build(rows, ["work", "position"], ["subtitle", "body"], new_path(spark, "index"), parts=8)


def brute(terms, every):
    texts = {(w, p): Counter(re.findall(r"\w+", f"{s or ''} {b or ''}".lower())) for w, p, s, b in ROWS}
    texts = {k: c for k, c in texts.items() if c}
    mean = sum(sum(c.values()) for c in texts.values()) / len(texts)
    out = []
    for k, c in texts.items():
        held = [t for t in terms if c[t]]
        if held and (not every or len(held) == len(terms)):
            score = 0
            for t in held:
                df = sum(1 for x in texts.values() if x[t])
                score += math.log((len(texts) - df + 0.5) / (df + 0.5) + 1) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            out.append((round(score, 6), k))
    return sorted(out, key=lambda x: (-x[0], x[1][0] is not None, x[1]))


@pytest.mark.parametrize(("terms", "every"), [(["the", "of"], True), (["THE", "cat", "cat"], False), (["über"], True), (["none"], True), ([], True)])
def test_search_equals_brute_force(index, terms, every):
    got = [(r.score, (r.work, r.position)) for r in postings.search(index, terms, 10, every).orderBy("rank").collect()]
    assert got == brute(sorted({t.lower() for t in terms}), every)


def test_search_in_one_work_and_limit(index):
    assert [(r.rank, r.work) for r in postings.search(index, ["cat"], 1, where=F.col("work") == 3).collect()] == [(1, 3)]


def test_only_the_folders_of_the_terms_are_read(index):
    found = postings.search(index, ["the", "of"], 5)
    files = {f for f in index.table("postings").inputFiles()}
    hits = index.table("postings").filter(postings._only(index, ["the", "of"]))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((part" in plan and "PushedFilters: [In(term, [of,the])]" in plan
    opened = {r.f for r in hits.select(F.input_file_name().alias("f")).collect()}
    assert len(opened) < len(files) and found.count() == 3


def test_many_queries_at_once(spark, index):
    asked = spark.createDataFrame([(1, "the"), (1, "Of"), (1, "of"), (2, "cat"), (3, "none"), (4, None), (None, "cat")], "query long, term string")
    got = postings.search_many(index, asked, 2).collect()
    for q, terms in ((1, ["the", "of"]), (2, ["cat"])):
        mine = sorted((r.rank, r.score, (r.work, r.position)) for r in got if r.query == q)
        assert [x[1:] for x in mine] == brute(terms, False)[:2]
    assert {r.query for r in got} == {1, 2}


def test_hot_terms_have_several_files(spark):
    rows = spark.range(20000).select(F.col("id").alias("k"), F.concat(F.lit("hot "), F.sha2(F.col("id").cast("string"), 256)).alias("t"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        index = postings.build(rows, ["k"], ["t"], new_path(spark, "hot"), parts=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    hot = index.table("postings").filter("term = 'hot'")
    assert hot.select(F.input_file_name()).distinct().count() > 2
    assert postings.search(index, ["hot"], 3).count() == 3


def test_no_texts(spark):
    index = postings.build(spark.createDataFrame([], "k long, t string"), ["k"], ["t"], new_path(spark, "none"))
    assert postings.search(index, ["a"], 3).count() == 0


def test_many_queries_are_summed_by_text(spark, monkeypatch):
    """Whatever is worked on at once, and with many equal texts, the rows are those of the join; only a few of each task are ranked."""
    import random

    pick = random.Random(5)
    words = "the of cat dog a b c d e f".split()
    rows = [(pick.choice("xyz"), k, " ".join(pick.choices(words, k=pick.randint(0, 6)))) for k in range(300)] + [("z", 1000 + k, "the cat of") for k in range(200)] + [(None, 5, "cat"), ("x", None, "dog cat")]
    df = spark.createDataFrame(rows, "work string, place long, text string")
    index = postings.build(df, ["work", "place"], ["text"], new_path(spark, "many"), parts=4)
    monkeypatch.setattr(postings, "SLICED_BYTES", 0)
    sliced = postings.build(df, ["work", "place"], ["text"], new_path(spark, "sliced"), parts=4)
    for name in ("postings", "terms", "totals"):
        assert sorted(map(repr, sliced.table(name).collect())) == sorted(map(repr, index.table(name).collect()))
    asked = spark.createDataFrame([(f"q{q}", t) for q in range(40) for t in pick.sample([*words, "none", "the\0"], 4)], "query string, term string")
    got = []
    for most, at_once, cells in ((0, 1, 1), (10**6, 7, 100), (10**6, 10**6, 10**6)):
        monkeypatch.setattr(postings, "MOST_ASKED", most)
        monkeypatch.setattr(postings, "ROWS_AT_ONCE", at_once)
        monkeypatch.setattr(postings, "CELLS_AT_ONCE", cells)
        got.append(sorted(map(repr, postings.search_many(index, asked, 3).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 120
    asked = asked.withColumn("part", postings.part_of(F.col("term"), 4))
    assert postings._best_by_text(index, asked, 3).count() <= 4 * 40 * 3 + 200
