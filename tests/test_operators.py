import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalogue, changes
from quire.sources import tables
from quire.streaming import tasks


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_unknown_state_and_sort_column(spark):
    with pytest.raises(ValueError):
        catalogue.in_states(["frozen", "melted"])
    with pytest.raises(ValueError):
        catalogue.page(spark.range(3), "no_such", 0, 1)


def test_filter_words(spark):
    df = spark.createDataFrame([(1, "A Tale", "s", "x", ["Fantasy", "end"]), (2, "Other", "s", "x", None)], "id int, title string, sitename string, status string, tags array<string>")
    ids = lambda text: [r.id for r in df.filter(catalogue.compile_filter(text)).orderBy("id").collect()]
    assert ids("") == [1, 2]
    assert ids("TAG:fan|zzz") == [1] and ids("-tag:fan") == [2] and ids("^tag:none") == [1, 2]
    assert ids("tale") == [1] and ids("tale tag:404") == [] and ids("end") == [1]


def test_upsert_keeps_what_the_batch_leaves_empty(spark):
    stored = spark.createDataFrame([(1, "old", 5), (2, "kept", 6)], "id int, title string, n int")
    batch = spark.createDataFrame([(1, "", 7), (3, "new", None)], "id int, title string, n int")
    assert sorted(map(tuple, changes.upsert(stored, batch, "id").collect())) == [(1, "old", 7), (2, "kept", 6), (3, "new", None)]


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, t string")
    assert sorted(map(tuple, changes.latest(df, ["k"], [-F.col("v")]).collect())) == [("a", 2, "y"), ("b", 1, "z")]


def test_text_functions(spark):
    assert one(spark, T.html_to_text(F.lit("<p>a&amp;lt;<script>x</script> b<!-- c\n --></p>\n"))) == "a&lt; b"
    assert one(spark, T.kanji_digits(F.lit("1０9"))) == "一〇九"
    assert one(spark, T.integer_with_commas(F.lit("1,234"))) == 1234 and one(spark, T.integer_with_commas(F.lit("x"))) is None
    assert one(spark, T.work_id(F.lit("https://www.Example.com/a/b/?q#f"))) == "example.com:/a/b"
    assert one(spark, T.indent_ratio(F.lit(""))) is None
    assert one(spark, changes.content_signature(F.lit(None).cast("string"), F.lit("b"), F.lit(""))).startswith("sha256:")
    assert one(spark, changes.needs_refresh(F.lit("s"), F.lit("s"), F.lit(True))) is False
    assert one(spark, changes.needs_refresh(F.lit("s"), F.lit("t"), F.lit(True))) is True
    assert one(spark, changes.needs_refresh(F.lit("s"), F.lit(""), F.lit(True))) is False


def test_text_sources(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("; comment\na\tb\tc\nalone\n")
    assert [tuple(r) for r in tables.text_pairs(spark, str(tmp_path / "pairs.txt")).collect()] == [("a", "b\tc")]
    (tmp_path / "watch.txt").write_text("# all\nhttps://x/1 | title=A b | auto=yes # note\nftp://no\n")
    (row,) = tables.watch_list(spark, str(tmp_path / "watch.txt")).collect()
    assert row.url == "https://x/1" and row.options == {"title": "A b", "auto": "yes"}


def test_arrivals_stream_keeps_each_key_once(spark, tmp_path):
    source, stored = str(tmp_path / "in"), str(tmp_path / "stored")
    schema = "work int, position int, body string"
    for part in ([(1, 1, "a"), (1, 2, "b"), (1, 2, "b")], [(1, 2, "again"), (2, 1, "c")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    query = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(lambda b, _: tasks.store_arrivals(b, stored, ["work", "position"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.work, r.position) for r in spark.read.parquet(stored).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_streamed_states_equal_the_table(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k % 3, at + datetime.timedelta(minutes=k), k, "done" if k % 2 else "running") for k in range(20)]
    df = spark.createDataFrame(rows, "task int, ts timestamp, event_id int, status string")
    df.write.parquet(str(tmp_path / "e"))
    stream = tasks.latest_state(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(spark.table("states").collect()) == sorted(tasks.latest_state(df).collect())
