import datetime

from quire.sources.shared import new_path
from quire.streaming import watch

DAY = datetime.datetime(2024, 1, 1)
ROWS = [
    [("a", 1, "A", 3, None), ("a", 2, "A", 3, None), ("b", 1, "B", None, "no answer"), ("c", 1, "C", 0, None), (None, 1, "N", 2, None)],
    [("a", 4, "A2", 6, None), ("a", 3, "A", 5, None), ("b", 5, "B", 2, None), ("c", 4, "C", 4, None), ("d", 1, "D", 9, None)],
    [("a", 5, "A3", None, "gone"), ("a", 6, "A3", 4, None), ("b", 6, "B", None, None), ("d", 7, "D", 10, None), ("d", 7, "D", 11, None)],
]


def batch(spark, k):
    return spark.createDataFrame([(a, DAY + datetime.timedelta(hours=h), 10 * k + n, t, x, e) for n, (a, h, t, x, e) in enumerate(ROWS[k])], watch.CHECKS)


def test_three_batches_and_a_restart_equal_the_table(spark):
    source, path, state = (new_path(spark, n) for n in ("checks", "results", "state"))
    for k in range(3):
        batch(spark, k).coalesce(1).write.mode("append").parquet(source)
        # a new query each time: it starts from what the one before has kept
        checks = spark.readStream.schema(watch.CHECKS).parquet(source)
        watch.store(watch.watched(checks), path, state).awaitTermination()
    columns = ["address", "at", "seq", "status", "total", "new", "known"]
    got = spark.read.schema(watch.RESULT).parquet(path)
    whole = batch(spark, 0).union(batch(spark, 1)).union(batch(spark, 2))
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(map(tuple, watch.watched_table(whole).select(columns).collect()), key=repr)
    by = {(r.address, r.seq): (r.status, r.new, r.known, r.title) for r in got.collect()}
    assert by["a", 0] == ("init", 0, 3, "A") and by["a", 1][0] == "uptodate" and by["a", 11] == ("updated", 2, 5, "A") and by["a", 10] == ("updated", 1, 6, "A2")
    assert by["a", 20] == ("error", 0, 6, "A2") and by["a", 21] == ("uptodate", 0, 6, "A2")
    assert by["b", 2][0] == "error" and by["b", 12] == ("init", 0, 2, "B") and by["b", 22][0] == "error"
    assert by["c", 3] == ("init", 0, 0, "C") and by["c", 13] == ("init", 0, 4, "C")
    assert by["d", 23] == ("updated", 1, 10, "D") and by["d", 24] == ("updated", 1, 11, "D")


def test_no_checks(spark):
    assert watch.watched_table(spark.createDataFrame([], watch.CHECKS)).count() == 0
