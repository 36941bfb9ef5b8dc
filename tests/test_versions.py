import datetime
import random

from pyspark.sql import functions as F

from quire.sources import versions as V
from quire.sources.shared import new_path

SCHEMA = "work long, chapter string, at timestamp_ntz, seq long, content string"
START = datetime.datetime(2024, 1, 1)


def day(k):
    return START + datetime.timedelta(days=k)


def history():
    r = random.Random(4)
    return [(r.randrange(3), r.choice("ab"), day(r.randrange(30)), n, r.choice([None, "x", "y", "z"])) for n in range(150)]


def state(rows, at):
    out = {}
    for w, c, t, n, x in sorted(rows, key=lambda r: (r[2], r[3])):
        if t <= at:
            out[w, c] = x
    return {k: x for k, x in out.items() if x is not None}


def test_batches_equal_the_whole_history(spark):
    rows, path = history(), new_path(spark, "versions")
    for k, (a, b) in enumerate([(0, 10), (10, 11), (11, 30)]):
        V.store_versions(spark.createDataFrame([r for r in rows if day(a) <= r[2] < day(b)], SCHEMA), path, first=k == 0, parts=4)
    found = V.read_versions(spark, path)
    whole = V.intervals(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, found.select(*V.NAMES).collect()), key=repr) == sorted(map(tuple, whole.select(*V.NAMES).collect()), key=repr)
    for k in (-1, 0, 9, 10, 17, 40):
        got = {(r.work, r.chapter): r.content for r in V.as_of(found, F.lit(day(k)).cast("timestamp_ntz")).collect()}
        assert got == state(rows, day(k))
    asked = spark.createDataFrame([(w, c, day(k)) for w in range(4) for c in "ab" for k in (3, 12)], "work long, chapter string, moment timestamp_ntz")
    got = {(r.work, r.chapter, r.moment): r.content for r in V.as_of_rows(asked, found, "moment").collect()}
    assert got == {(w, c, day(k)): state(rows, day(k)).get((w, c)) for w in range(4) for c in "ab" for k in (3, 12)}
    changes = {(r.work, r.chapter): (r.old, r.new, r.state) for r in V.snapshot_changes(found, F.lit(day(9)).cast("timestamp_ntz")).collect()}
    now = state(rows, day(99))
    assert changes == {k: (x, now.get(k), "gone" if k not in now else "same" if now[k] == x else "changed") for k, x in state(rows, day(9)).items()}


def test_untouched_folders_are_not_rewritten(spark):
    path = new_path(spark, "folders")
    V.store_versions(spark.createDataFrame([(w, "a", day(0), 0, "x") for w in range(20)], SCHEMA), path, first=True, parts=8)
    before = set(V.read_versions(spark, path).inputFiles())
    V.store_versions(spark.createDataFrame([(1, "a", day(1), 1, "y"), (1, "b", day(1), 2, "n")], SCHEMA), path, parts=8)
    found = V.read_versions(spark, path)
    assert len(before & set(found.inputFiles())) == len(before) - 1 and found.count() == 22


def test_equal_contents_are_one_version(spark):
    rows = [(1, "a", day(0), 0, "x"), (1, "a", day(1), 1, "x"), (1, "a", day(2), 2, None), (1, "a", day(3), 3, None), (1, "a", day(4), 4, "x"), (1, "a", day(4), 5, "y"), (2, "a", day(0), 0, None)]
    got = sorted(map(tuple, V.intervals(spark.createDataFrame(rows, SCHEMA)).select(*V.NAMES).collect()))
    assert got == [(1, "a", "x", day(0), day(2)), (1, "a", "y", day(4), None)]
